import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from contentfit.llm.packing import WordEncoder, fill, pack, plan_patterns

TEXTS = ["", "  ", "<|endoftext|> a<|startoftext|>b", "It's I'LL we'd 5²½ İstanbul ΟΔΟΣ éá ﬁ  x y \x1cz\x85q",
         "ﾊﾝ 漢字かな 한국어 😀👍🏽 a̸≠", "ß ẞ ſ K Å don't'll''s", "zero​width‍", "ŉ ǅ ª º µ × ÷ ¿ \xad soft\xadhyphen", "x" * 3000]


@pytest.fixture(scope="module")
def encoder():
    return WordEncoder()


def test_words_encode_as_the_whole_text(encoder):
    for text, ids in zip(TEXTS, encoder.encode([t.encode() for t in TEXTS])):
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text_encodes_as_a_whole(text):
    encoder = test_any_text_encodes_as_a_whole.encoder
    assert encoder.encode([text.encode()])[0].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


test_any_text_encodes_as_a_whole.encoder = WordEncoder(cached_words=50)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 4), max_size=6), st.integers(0, 60))
def test_fill_is_the_best_subset_sum(counts, room):
    chosen = fill(counts, room)
    assert all(0 < n <= counts[k] for k, n in chosen.items())
    sums = {0}
    for k, n in counts.items():
        sums = {s + k * i for s in sums for i in range(n + 1)}
    assert sum(k * n for k, n in chosen.items()) == max(s for s in sums if s <= room)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 1000), max_size=30))
def test_plan_covers_the_histogram(histogram):
    used = {}
    for pattern, times in plan_patterns(histogram, 64):
        assert times > 0 and sum(k * n for k, n in pattern.items()) <= 64
        for k, n in pattern.items():
            used[k] = used.get(k, 0) + n * times
    assert used == histogram


def check(rows, docs, encoder, capacity):
    """Every id in one piece, sequences gapless and within capacity."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for s in by_sequence.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    for i, text in docs:
        ids = np.array(encoder.tokenizer.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            piece = ids[at:at + r["length"]]
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(piece.tobytes()) and r["doc_tokens"] == len(ids)
            at += r["length"]
        assert at == len(ids)
    return by_sequence


def test_pack(spark, encoder, prose_of):
    docs = [(i, prose_of(i, 1 + i * 13 % 400)) for i in range(120)] + [(200, None), (201, ""), (202, prose_of(5, 3000))]
    rows = pack(spark.createDataFrame(docs, "doc_id long, text string"), capacity=512).collect()
    sequences = check(rows, docs, encoder, 512)
    total = sum(r["length"] for r in rows)
    assert len(sequences) <= -(-total // 512) + 1


def test_same_plan_for_many_salted_groups(spark, encoder, prose_of, monkeypatch):
    from contentfit.llm import packing
    monkeypatch.setattr(packing, "GROUP_ROWS", 10)
    docs = [(i, prose_of(i % 7, 30)) for i in range(200)]
    check(pack(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs, encoder, 2048)


def test_odd_rows(odd_docs, no_docs):
    rows = pack(odd_docs).collect()
    assert sum(1 for r in rows if r["start"] == 0) == odd_docs.count()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert pack(no_docs).count() == 0
