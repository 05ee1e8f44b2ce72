import numpy as np

from contentfit.llm.chunk_dedup import chunks, cut_words, gear_boundaries, remove_repeats, repeated_spans
from contentfit.llm.common import word_hashes, word_spans


def hashes(text):
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    return word_hashes(raw, *word_spans(raw))


def test_chunks_resist_shifts(prose_of):
    passage = prose_of(1, 70)
    a = set(chunks(hashes(prose_of(2, 33) + " " + passage + " " + prose_of(3, 5)))[2].tolist())
    b = set(chunks(hashes(passage + " " + prose_of(4, 90)))[2].tolist())
    assert a & b
    start, size, _ = chunks(hashes(prose_of(5, 3000)))
    assert size.min() >= 20 and size.max() <= 26


def test_passages_are_cut_from_the_later_documents(spark, prose_of):
    rows, passages = [], [prose_of(1000 + i, 55) for i in range(30)]
    for i, p in enumerate(passages):
        rows += [(10 * i, f"{prose_of(i, 40)} {p} {prose_of(i + 500, 30)}"),
                 (10 * i + 1, f"{prose_of(i + 100, 7 + i)}\n{p}"), (10 * i + 2, f"{p} {prose_of(i + 200, 25)}")]
    rows += [(5000 + i, prose_of(3000 + i, 80)) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r["doc_id"]: r for r in repeated_spans(docs).collect()}
    assert set(spans) == {10 * i + j for i in range(30) for j in (1, 2)}
    assert all(r["first_doc_ids"][0] == d // 10 * 10 for d, r in spans.items())
    texts = {r["doc_id"]: r["text"] for r in remove_repeats(docs).collect()}
    for i, p in enumerate(passages):
        assert p in texts[10 * i] and p not in texts[10 * i + 1] and p not in texts[10 * i + 2]
        assert texts[10 * i + 1].startswith(prose_of(i + 100, 7 + i)) and texts[10 * i + 2].endswith(prose_of(i + 200, 25))
    assert all(texts[5000 + i] == prose_of(3000 + i, 80) for i in range(30))


def without_boundaries(period, words):
    """A text of ``period`` distinct words over and over that has no gear boundary."""
    for seed in range(1000):
        text = " ".join(f"w{seed}x{i % period}" for i in range(words))
        if not len(gear_boundaries(hashes(text))):
            return text
    raise AssertionError("every text has a boundary")


def test_starts_are_close_in_any_text(prose_of):
    texts = [without_boundaries(p, 300) for p in (1, 2, 3, 5, 8)]
    for text in [*texts, prose_of(1, 3000), f"{prose_of(2, 40)} {' '.join(texts)} {prose_of(3, 40)}"]:
        start, size, _ = chunks(hashes(text))
        assert start[0] <= 25 and np.diff(start).max() <= 25 and start[-1] >= len(text.split()) - 51
        assert size.min() >= 20 and size.max() <= 26


def test_passages_without_boundaries_are_cut(spark, prose_of):
    rows, passages = [], {p: without_boundaries(p, 60) for p in (1, 2, 3, 5, 8)}
    for p, passage in passages.items():
        rows += [(10 * p, f"{prose_of(p, 40)} {passage} {prose_of(p + 50, 30)}"),
                 (10 * p + 1, f"{prose_of(p + 100, 33)} {passage} {prose_of(p + 150, 27)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {r["doc_id"]: r["text"] for r in remove_repeats(docs).collect()}
    for p, passage in passages.items():
        left = texts[10 * p + 1]
        assert texts[10 * p] == dict(rows)[10 * p] and prose_of(p + 100, 33) in left and prose_of(p + 150, 27) in left
        assert len(left.split()) <= 60 + 34  # a chunk of 26 words or more went


def test_a_document_repeating_itself_is_left_alone(spark, prose_of):
    text = "\n".join([prose_of(1, 60)] * 3)
    assert repeated_spans(spark.createDataFrame([(1, text), (2, "z " * 400)], "doc_id long, text string")).count() == 0


def test_cut_words_keeps_the_rest():
    assert cut_words(b" a  b c\nd e ", [1, 3], [2, 4]) == b" a  c\ne "
    assert cut_words(b"a b", [1], [9]) == b"a "


def test_odd_rows(odd_docs, no_docs):
    out = remove_repeats(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[1] and len(texts[2]) < len(texts[1]) / 2 and texts[3] is None and texts[9]
    assert repeated_spans(no_docs).count() == 0 and remove_repeats(no_docs).count() == 0
