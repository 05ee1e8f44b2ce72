import random

import pytest
from pyspark.sql import functions as F

from contentfit.llm import edit_counts as ec

SCRAPS = ["", " ", "  ", "x", "'s", "\n", "12", "!!", "<EMAIL>", "hello world " * 100, "   y", "é"]


@pytest.fixture(scope="module")
def counter():
    return ec.TokenCounter()


def test_recount_equals_a_fresh_count(counter, prose_of):
    rng = random.Random(3)
    texts = [prose_of(i, 10 + 97 * i) for i in range(12)] + [
        "", " ", "a", "   \n\n  x  y\n\n\n  ", "it's they'll 12345 !!! \t\t z" * 50, " " * 500 + "x", "é" * 1000, "\n" * 300]
    for text in texts:
        chars, tokens = ec.leaves(counter, text)
        assert sum(tokens) == len(counter.encode(text)) and sum(chars) == len(text)
        for _ in range(12):
            edits = []
            for _ in range(rng.choice([1, 2, 5, 20])):
                s = rng.randint(0, len(text))
                edits.append({"start": s, "end": min(len(text), s + rng.choice([0, 0, 1, 3, 10, 400])), "text": rng.choice(SCRAPS)})
            edits = ec.valid_edits(edits, len(text))
            new = ec.edit_text(text, edits)
            c, t, _ = ec.recount(counter, text, chars, tokens, edits)
            assert sum(c) == len(new) and sum(t) == len(counter.encode(new)), (text[:30], edits)
            # The table serves the next edits as a fresh one would.
            again = ec.valid_edits([{"start": len(new) // 2, "end": len(new) // 2, "text": "more words"}], len(new))
            assert sum(ec.recount(counter, new, c, t, again)[1]) == len(counter.encode(ec.edit_text(new, again)))


def test_small_edits_reencode_little(counter, prose_of):
    text = prose_of(1, 20_000)
    chars, tokens = ec.leaves(counter, text)
    _, _, touched = ec.recount(counter, text, chars, tokens, [(60_000, 60_005, "x")])
    assert touched < len(text) / 50


def test_tree_sums():
    tree = ec.SegmentTree([3, 0, 4, 5, 1], [1, 0, 2, 2, 1])
    assert tree.total == (13, 6)
    assert [tree.locate(c) for c in (0, 2, 3, 6, 7, 12)] == [(0, 0), (0, 0), (2, 3), (2, 3), (3, 7), (4, 12)]
    tree.set(2, 10, 7)
    assert tree.total == (19, 11) and tree.locate(12) == (2, 3) and ec.sum_before(tree, 3) == 13


def test_edit_lists(counter):
    e = lambda s, n, t="": {"start": s, "end": n, "text": t}
    assert ec.valid_edits([e(5, 9), e(2, 6), e(9, 99, "z"), e(-1, 3), e(4, 2), None, e(None, 3)], 12) == [(2, 6, ""), (9, 12, "z")]
    assert ec.valid_edits(None, 5) == [] and ec.edit_text("abcdef", [(1, 2, "X"), (4, 6, "")]) == "aXcd"


def test_masks(spark, counter):
    text = "mail a.b+c@x-y.example.org or +49 (30) 1234-5678, not 12 or x@y"
    docs = spark.createDataFrame([(1, text), (2, "call 555 123 4567"), (3, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in ec.apply_edits(ec.index_tokens(docs), ec.redactions("text")).collect()}
    assert rows[1]["text"] == "mail <EMAIL> or <NUMBER>, not 12 or x@y" and rows[2]["text"] == "call <NUMBER>"
    assert all(rows[i]["tokens_after"] == len(counter.encode(rows[i]["text"])) for i in (1, 2))
    assert rows[3]["tokens_before"] == rows[3]["tokens_after"] == rows[3]["n_edits"] == 0


def test_one_pass_equals_table_and_edits(spark, odd_docs, no_docs, counter, prose_of):
    rows = [(1, "a@b.example.org and " + prose_of(1, 300) + " +49 30 1234 5678"), (2, prose_of(2, 50)), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for frame in (docs, odd_docs):
        want = ec.apply_edits(ec.index_tokens(frame), ec.redactions("text"))
        names = ["doc_id", "n_edits", "tokens_before", "tokens_after", "reencoded_chars"]
        assert sorted(map(str, ec.count_edited(frame).select(names).collect())) == sorted(map(str, want.select(names).collect()))
    assert ec.count_edited(no_docs).count() == 0


def test_many_edits_of_a_long_text_are_not_quadratic(counter):
    """Each edit reads the text near it, not all that follows."""
    text = "word 123 " * 40_000
    chars, tokens = ec.leaves(counter, text)
    edits = [(9 * i + 5, 9 * i + 8, "<N>") for i in range(0, 40_000, 10)]
    read = []
    first, ec.Tail.first = ec.Tail.first, lambda self, n: read.append(out := first_(self, n)) or out
    first_ = first
    try:
        _, new, _ = ec.recount(counter, text, chars, tokens, edits)
    finally:
        ec.Tail.first = first
    assert sum(new) == len(counter.encode(ec.edit_text(text, edits)))
    assert sum(map(len, read)) < 10 * len(text)


def test_clashing_columns(spark, counter):
    docs = spark.createDataFrame([(1, "a 12345678 b", 5, 6, 7)], "doc_id long, text string, leaves int, done int, tokens_before int")
    row = ec.apply_edits(ec.index_tokens(docs), ec.redactions("text")).first()
    assert (row["leaves"], row["done"], row["tokens_before"]) == (5, 6, len(counter.encode("a 12345678 b")))


def test_odd_rows(odd_docs, no_docs, counter):
    edits = F.when(F.col("doc_id") % 2 == 1, F.array(F.struct(F.lit(3).alias("start"), F.lit(8).alias("end"), F.lit("Q q").alias("text"))))
    out = ec.apply_edits(ec.index_tokens(odd_docs), edits.cast(ec.EDITS)).collect()
    assert len(out) == odd_docs.count()
    assert all(r["tokens_after"] == len(counter.encode(r["text"] or "")) for r in out)
    assert ec.index_tokens(no_docs).count() == 0
