import hashlib
import struct

import pytest
import zstandard

from contentfit.llm import warc


def pages_frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.fixture(scope="module")
def rows(prose_of):
    pages = [(i, f"http://h.example/{i}", f"<html><body>{prose_of(i, 60)}é</body></html>") for i in range(60)]
    pages += [(100 + i, None, pages[3][2]) for i in range(5)] + [(200, "x\r\ny", None), (201, "u", ""), (202, "u", "")]
    return pages + [(300, "u", "short"), (301, "u", "short"), (None, "u", prose_of(99, 40))]


def test_round_trip(spark, rows):
    got = warc.round_trip(pages_frame(spark, rows)).collect()
    assert len(got) == len(rows) and all(r["error"] is None for r in got)
    by_id = {r["page_id"]: r for r in got}
    for i, _, html in rows:
        payload = (html or "").encode()
        r = by_id[i]
        assert r["payload_bytes"] == len(payload) and r["payload_digest"] == hashlib.sha256(payload).hexdigest()
        copy = i is not None and 100 <= i < 105
        assert (r["record_type"], r["refers_to"]) == (("revisit", 3) if copy else ("response", None))


def test_files_are_archives_of_the_convention(spark, rows, tmp_path):
    pages = pages_frame(spark, rows).repartition(3)
    dictionary = warc.train_dictionary(pages, size=2048)
    warc.write_archives(pages, str(tmp_path / "a"), dictionary)
    files = [p for p in (tmp_path / "a").iterdir() if p.name.startswith("part-") and p.stat().st_size]
    plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    n = 0
    for p in files:
        data = p.read_bytes()
        assert struct.unpack_from("<II", data) == (warc.DICTIONARY_FRAME, len(dictionary))
        with plain.stream_reader(data[8 + len(dictionary):], read_across_frames=True) as stream:
            n += stream.read().count(b"WARC/1.1\r\n")
    assert n == len(rows)
    got = warc.read_archives(spark, str(tmp_path / "a")).collect()
    assert {bytes(r["payload"]) for r in got if r["record_type"] == "response"} == {(h or "").encode() for _, _, h in rows}


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_many_small_archives(spark, rows, tmp_path, monkeypatch, broadcast):
    """Every archive begins with the dictionary, however many a task writes."""
    monkeypatch.setattr(warc, "BROADCAST_ROWS", broadcast)
    pages = pages_frame(spark, rows).repartition(2)
    dictionary = warc.train_dictionary(pages, size=2048)
    monkeypatch.setattr(warc, "BLOCK_BYTES", 400)
    monkeypatch.setattr(warc, "ARCHIVE_BLOCKS", 4)
    warc.write_archives(pages, str(tmp_path / "a"), dictionary)
    files = [p for p in (tmp_path / "a").iterdir() if p.name.startswith("part-") and p.stat().st_size]
    assert len(files) > 5 and all(struct.unpack_from("<I", p.read_bytes())[0] == warc.DICTIONARY_FRAME for p in files)
    got = warc.read_archives(spark, str(tmp_path / "a")).collect()
    assert all(r["error"] is None for r in got) and len(got) == len(rows)
    assert sorted(r["page_id"] or 0 for r in got if r["record_type"] == "revisit") == [100, 101, 102, 103, 104]


def archive(records, dictionary=b""):
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    pack = zstandard.ZstdCompressor(dict_data=shared)
    lead = struct.pack("<II", warc.DICTIONARY_FRAME, len(dictionary)) + dictionary if dictionary else b""
    return lead + b"".join(pack.compress(r) for r in records)


def good(payload=b"hello"):
    return warc.record_bytes(7, "http://u/", payload, hashlib.sha256(payload).hexdigest(), None)


@pytest.mark.parametrize("change, error", [
    (lambda r: r.replace(b"WARC/1.1", b"HTTP/1.1", 1), "no WARC header"),
    (lambda r: r.replace(b"WARC-Date: ", b"X-Date: "), "no warc-date"),
    (lambda r: r.replace(b"hello", b"hullo"), "wrong block digest"),
    (lambda r: r[:-4], "wrong content-length"),
    (lambda r: r.replace(b"WARC-Type: response", b"WARC-Type: other"), "unknown type"),
    (lambda r: r.replace(b"sha256:" + hashlib.sha256(b"hello").hexdigest().encode(), b"sha256:" + b"0" * 64), "wrong payload digest"),
])
def test_records_are_validated(change, error):
    assert warc.parse_record(good())["error"] is None
    assert warc.parse_record(change(good()))["error"] == error


def test_damage_is_reported_and_the_rest_is_read():
    data = archive([good(), good(b"second"), good(b"third")])
    assert [bytes(r["payload"]) for r in warc.archive_records(data)] == [b"hello", b"second", b"third"]
    cut = list(warc.archive_records(data[:-5]))
    assert [r["error"] is None for r in cut] == [True, True, False] and "cut off" in cut[-1]["error"]
    assert "no frame" in list(warc.archive_records(b"not an archive"))[0]["error"]
    assert list(warc.archive_records(b"")) == []


def test_compressed_dictionary():
    raw = zstandard.train_dictionary(1024, [b"some payload %d with common words" % i * 5 for i in range(200)]).as_bytes()
    packed = zstandard.ZstdCompressor().compress(raw)
    pack = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    data = struct.pack("<II", warc.DICTIONARY_FRAME, len(packed)) + packed + pack.compress(good())
    assert [r["error"] for r in warc.archive_records(data)] == [None]


def test_empty(spark, rows):
    pages = pages_frame(spark, rows).limit(0)
    assert warc.round_trip(pages).count() == 0
