"""WARC archives compressed with Zstandard, one frame per record.

An archive is a ``.zst`` file as the WARC-Zstandard convention has it: a
leading skippable frame (type 0x184D2A5D) holds the compression dictionary,
then every record is a frame of its own.  Which pages are copies is found from their
ids and digests alone.  Copies become revisit records, which have no payload;
responses are written from the scan of the pages, from which the copies are
taken out by id and digest (a broadcast within ``BROADCAST_ROWS``, else a
shuffle that spreads by id, so that a page of many copies is no hot key).  The
reader loads archives with Spark's ``binaryFile`` source, takes the dictionary
from the leading frame, decodes frame by frame, and validates headers, lengths
and digests record by record.

Archives are written by Spark's text writer with a block of frames per row, so
they reach any file system that Spark does, through the commit protocol that
survives lost tasks.  The line separator is an empty skippable frame, which
decoders pass over.  An archive is closed after ``ARCHIVE_BLOCKS`` blocks of
about ``BLOCK_BYTES``, so that a reader's memory doesn't follow the corpus.

Defined cases: null html is an empty payload; a null page id is kept as such
and its record is a response; repeated rows give a record each, all of the
smallest page id of their payload being responses; payloads that differ in a
byte are no copies; a very long payload is a block of its own; an empty table
gives no archive; a damaged record is returned with its ``error`` and the rest
of its archive is read on.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentfit.llm.common import slices, write_stage
from contentfit.session import ensure_checkpoint_dir

MIN_REVISIT_BYTES = 100
DICTIONARY_BYTES = 64 * 1024
DICTIONARY_ROWS = 1_000
SAMPLE_BYTES = 16 * 1024
LEVEL = 3
BLOCK_BYTES = 1 << 20
ARCHIVE_BLOCKS = 32
BROADCAST_ROWS = 200_000
DATE = "2024-01-01T00:00:00Z"
# --- fixed values of the formats ---
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE_FRAMES = range(0x184D2A50, 0x184D2A60)
DATA_FRAME = 0xFD2FB528
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"  # a skippable frame without content
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
TYPES = ("response", "revisit")

_RECORDS = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, "
            "payload binary, error string")


def train_dictionary(pages: DataFrame, html_col: str = "html", rows: int = DICTIONARY_ROWS,
                     size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from at most ``rows`` payloads, picked by hash, of at most
    ``SAMPLE_BYTES`` each; empty if there is too little to train on."""
    h = F.xxhash64(html_col)
    full = pages.where(F.length(html_col) > 0)
    # Hashes are picked first, so that tasks send the driver numbers, not pages.
    picked = full.select(h.alias("h")).distinct().orderBy("h").limit(rows)
    body = F.substring(F.encode(F.col(html_col), "UTF-8"), 1, SAMPLE_BYTES)
    picked = (full.select(h.alias("h"), body.alias("b")).join(F.broadcast(picked), "h")
              .groupBy("h").agg(F.min("b").alias("b")).orderBy("h").collect())
    try:
        return zstandard.train_dictionary(size, [bytes(r["b"]) for r in picked]).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few or too small samples
        return b""


def _http_header(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None,
                 length: int | None = None) -> bytes:
    """One WARC/1.1 record; with ``refers_to`` a revisit, whose block has the
    HTTP header of a payload of ``length`` bytes alone."""
    block = _http_header(len(payload) if length is None else length) + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {TYPES[refers_to is not None]}", f"WARC-Record-ID: <urn:page:{page_id}>",
             f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}",
             f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if url:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, path: str, dictionary: bytes, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", min_revisit_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Write a record per page to archives under ``path``.

    Of pages with equal payloads of ``min_revisit_bytes`` or more, the
    smallest page id is the response and others revisit it.
    """
    payload = F.coalesce(F.encode(F.col(html_col), "UTF-8"), F.lit(b""))
    keyed = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
                         payload.alias("payload"))
    keyed = keyed.withColumn("digest", F.sha2("payload", 256)).withColumn("length", F.octet_length("payload"))
    # Ids, addresses and digests, without payloads.
    narrow = write_stage(keyed.where(F.col("id").isNotNull() & (F.col("length") >= min_revisit_bytes))
                         .select("id", "url", "digest", "length"), "page-digests")
    first = write_stage(narrow.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last"))
                        .where("first < last").select("digest", "first"), "first-pages")
    revisits = write_stage(narrow.join(first, "digest").where("id > first"), "revisits")
    copies = revisits.select(F.col("id").alias("copy"), F.col("digest").alias("copied")).distinct()
    if revisits.count() <= BROADCAST_ROWS:
        copies = F.broadcast(copies)
    responses = keyed.join(copies, (F.col("id") == F.col("copy")) & (F.col("digest") == F.col("copied")), "left_anti")
    rows = responses.select("id", "url", "payload", "digest", "length", F.lit(None).cast("long").alias("refers_to")).unionByName(
        revisits.select("id", "url", F.lit(b"").alias("payload"), "digest", "length", F.col("first").alias("refers_to")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=True)
        lead = struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary
        frames, size, written = [], 0, 0

        def blocks() -> Iterator[bytes]:
            """The block so far, behind the leading frame where an archive begins."""
            nonlocal frames, size, written
            if dictionary and written % ARCHIVE_BLOCKS == 0:
                written += 1
                yield lead
            written += 1
            yield b"".join(frames)
            frames, size = [], 0

        def made(out: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
            for block in out:
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], names=["frame"])

        for batch in (part for whole in batches for part in slices(whole)):
            for i, u, p, d, n, r in zip(*(batch.column(c).to_pylist() for c in range(6))):
                frames.append(packer.compress(record_bytes(i, u, p, d, r, n)))
                size += len(frames[-1])
                if size >= BLOCK_BYTES:
                    yield from made(blocks())
        if frames:
            yield from made(blocks())

    frames = rows.mapInArrow(run, "frame binary").select(F.col("frame").cast("string").alias("value"))
    frames.write.option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", ARCHIVE_BLOCKS).text(path)


def _frames(data: memoryview) -> Iterator[tuple[int, memoryview]]:
    """``(magic, content)``: skippable frames' content, data frames whole.  A
    data frame's end is found by walking its block headers."""
    at = 0
    while at + 8 <= len(data):
        magic, size = struct.unpack_from("<II", data, at)
        if magic in SKIPPABLE_FRAMES:
            yield magic, data[at + 8:at + 8 + size]
            at += 8 + size
            continue
        if magic != DATA_FRAME:
            raise ValueError(f"no frame at byte {at}")
        descriptor = data[at + 4]
        single = descriptor >> 5 & 1
        end = at + 5 + (not single) + (0, 1, 2, 4)[descriptor & 3] + (single, 2, 4, 8)[descriptor >> 6]
        last = False
        while not last:
            if end + 3 > len(data):
                raise ValueError(f"frame at byte {at} is cut off")
            block = int.from_bytes(data[end:end + 3], "little")
            last, kind = block & 1, block >> 1 & 3
            end += 3 + (1 if kind == 1 else block >> 3)
        end += 4 * (descriptor >> 2 & 1)
        if end > len(data):
            raise ValueError(f"frame at byte {at} is cut off")
        yield magic, data[at:end]
        at = end
    if at != len(data):
        raise ValueError(f"{len(data) - at} bytes after the last frame")


def _urn(value: str | None) -> int | None:
    number = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def parse_record(record: bytes) -> dict:
    """A record's fields; ``error`` names the first check that it fails."""
    out: dict = dict.fromkeys(("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload", "error"))

    def wrong(what: str) -> dict:
        out["error"] = what
        return out

    head, found, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        return wrong("no WARC header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            return wrong("malformed header line")
        fields[name.strip().lower()] = value.strip()
    out |= {"page_id": _urn(fields.get("warc-record-id")), "record_type": fields.get("warc-type"),
            "url": fields.get("warc-target-uri"), "refers_to": _urn(fields.get("warc-refers-to"))}
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"):
        if name not in fields:
            return wrong(f"no {name}")
    if out["record_type"] not in TYPES:
        return wrong("unknown type")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4:
        return wrong("wrong content-length")
    if not rest.endswith(b"\r\n\r\n"):
        return wrong("no record end")
    block = rest[:-4]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != "sha256:" + hashlib.sha256(block).hexdigest():
        return wrong("wrong block digest")
    http, found, payload = block.partition(b"\r\n\r\n")
    length = [x.split(b":", 1)[1].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if not found or not length or not length[0].isdigit():
        return wrong("no HTTP header")
    out |= {"payload_bytes": int(length[0]), "payload_digest": fields["warc-payload-digest"].removeprefix("sha256:")}
    if out["record_type"] == "revisit":
        return wrong("no target of revisit") if out["refers_to"] is None else out
    out["payload"] = payload
    if len(payload) != out["payload_bytes"]:
        return wrong("wrong payload length")
    if hashlib.sha256(payload).hexdigest() != out["payload_digest"]:
        return wrong("wrong payload digest")
    return out


def archive_records(data: bytes | pa.Buffer) -> Iterator[dict]:
    """The records of one archive.  A frame that can't be decoded gives a row
    with an error; damage to the framing ends the archive with such a row."""
    unpacker = zstandard.ZstdDecompressor()
    blank = dict.fromkeys(("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"))
    try:
        for i, (magic, frame) in enumerate(_frames(memoryview(data))):
            if magic == DICTIONARY_FRAME and i == 0 and len(frame):
                raw = bytes(frame)
                if raw[:4] == struct.pack("<I", DATA_FRAME):  # the dictionary may itself be compressed
                    raw = zstandard.ZstdDecompressor().decompress(raw)
                unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
            if magic != DATA_FRAME:
                continue
            try:
                record = unpacker.decompressobj().decompress(frame)
            except zstandard.ZstdError as e:
                yield blank | {"error": f"frame not decoded: {e}"}
                continue
            yield parse_record(record)
    except ValueError as e:
        yield blank | {"error": str(e)}


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives under ``path``; without ``payloads`` they
    are checked and left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _RECORDS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]
        for batch in batches:
            for k in range(batch.num_rows):
                some, size = [], 0
                for record in archive_records(batch.column(0)[k].as_buffer()):
                    if not payloads:
                        record["payload"] = None
                    some.append(record)
                    size += len(record["payload"] or b"") + 500
                    if size > 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in some], t) for n, t in zip(names, kinds)], names=names)
                        some, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in some], t) for n, t in zip(names, kinds)], names=names)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, _RECORDS)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    path = f"{ensure_checkpoint_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, train_dictionary(pages, html_col), id_col, url_col, html_col)
    return read_archives(pages.sparkSession, path, payloads=False)
