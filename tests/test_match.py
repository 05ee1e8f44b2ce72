"""Joins with bounds: equal to scoring every pair, with fewer pairs."""

import math
import random
from collections import Counter

import pytest

from contentfit.operators import fit as fx
from contentfit.operators import match as mt


def cosine(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    dot = sum(n * b[w] for w, n in a.items())
    return dot / (math.sqrt(sum(n * n for n in a.values())) * math.sqrt(sum(n * n for n in b.values()))) if dot else 0.0


def texts(seed, n, words, skew):
    """Texts of Zipf-like words; with skew a third are near one text."""
    rng = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(400)]
    weights = [1 / (i + 1) ** 1.1 for i in range(400)]
    out = [" ".join(rng.choices(vocabulary, weights, k=rng.randint(1, words))) for _ in range(n)]
    if skew:
        base = " ".join(rng.choices(vocabulary, weights, k=words))
        for i in range(0, n, 3):
            out[i] = base + " " + " ".join(rng.choices(vocabulary, k=rng.randint(0, 8)))
    return out


@pytest.mark.parametrize("seed, skew, cut", [(1, False, 0.5), (2, True, 0.65), (3, True, 0.9), (4, False, 0.2)])
def test_pruned_match_equals_brute_force(spark, seed, skew, cut):
    left, right = texts(seed, 150, 60, skew), texts(seed + 50, 90, 25, skew) + texts(seed, 30, 60, skew)
    lrows = [(i % 140, t) for i, t in enumerate(left)] + [(None, left[0]), (7, left[7]), (7, left[7]), (500, ""), (501, None)]
    rrows = [(i, t) for i, t in enumerate(right)] + [(None, right[1]), (3, right[3]), (900, None)]
    ldf, rdf = spark.createDataFrame(lrows, "lid long, ltext string"), spark.createDataFrame(rrows, "rid long, rtext string")
    for max_rows in (200_000, 1):
        got = mt.pruned_match(ldf.repartition(3), ["lid"], "ltext", rdf, ["rid"], "rtext", cut, max_rows=max_rows).collect()
        want = sorted((str(a), str(b), f"{cosine(x, y):.6f}") for a, x in lrows if x for b, y in rrows if y and cosine(x, y) >= cut)
        assert sorted((str(r.lid), str(r.rid), f"{r.raw_score:.6f}") for r in got) == want


def test_fewer_join_rows(spark, monkeypatch):
    """Candidates come from a small part of the entry pairs, and sketches leave few to score."""
    sizes, candidates, stage = {}, mt.candidates, mt.stage_table

    def staged(df, name):
        out = stage(df, name)
        sizes[name] = sizes.get(name, 0) + out.count()
        if name == "ranks":
            sizes["direct"] = out.agg({"pairs": "sum"}).first()[0]
        return out

    def counted(left, lk, right, rk, bound, max_rows):
        hits = left.join(right.select("rank", "rrest"), "rank").where(left["lrest"] * right["rrest"] >= bound)
        sizes["hits"] = hits.count()
        return candidates(left, lk, right, rk, bound, max_rows)
    monkeypatch.setattr(mt, "stage_table", staged)
    monkeypatch.setattr(mt, "candidates", counted)
    rng = random.Random(5)
    common = [f"c{i}" for i in range(12)]
    rows = [(i, " ".join(rng.choices(common, k=10) + [f"r{rng.randint(0, 3000)}" for _ in range(25)])) for i in range(600)]
    rows += [(1000 + i, t + " extra") for i, t in rows[:40]]
    left = spark.createDataFrame(rows[20:], "lid long, ltext string")
    right = spark.createDataFrame(rows[:300], "rid long, rtext string")
    found = mt.pruned_match(left, ["lid"], "ltext", right, ["rid"], "rtext", 0.8).count()
    assert found == fx.lexical_match(left, ["lid"], "ltext", right, ["rid"], "rtext", 0.8).count() > 280
    assert sizes["hits"] * 10 <= sizes["direct"] and found <= sizes["near"] <= 2 * found


def test_pruned_needs_a_threshold(spark):
    df = spark.createDataFrame([(1, "a")], "k long, t string")
    with pytest.raises(ValueError):
        mt.pruned_match(df, ["k"], "t", df, ["k"], "t", 0.0)


def test_nothing_in_common_and_empty_sides(spark):
    a = spark.createDataFrame([(1, "a b"), (2, "")], "lid long, ltext string")
    b = spark.createDataFrame([(1, "c d")], "rid long, rtext string")
    assert mt.pruned_match(a, ["lid"], "ltext", b, ["rid"], "rtext", 0.1).collect() == []
    assert mt.pruned_match(a.limit(0), ["lid"], "ltext", b, ["rid"], "rtext", 0.1).collect() == []
    assert mt.pruned_match(a, ["lid"], "ltext", b.limit(0), ["rid"], "rtext", 0.1).collect() == []


@pytest.mark.parametrize("seed, skew", [(11, False), (12, True)])
def test_best_match_equals_the_full_table(spark, seed, skew, monkeypatch):
    items, labels = texts(seed, 120, 40, skew), sorted(set(texts(seed + 9, 160, 12, skew)) | {"zzz", "aaa"})
    rows = [(i, t) for i, t in enumerate(items)] + [(0, items[0]), (None, items[4]), (700, "no shared word here"), (701, None), (702, "")]
    idf, ldf = spark.createDataFrame(rows, "item_id long, qtext string"), spark.createDataFrame([(x,) for x in labels], "intent string")
    sizes, stage = {}, mt.stage_table

    def staged(df, name):
        out = stage(df, name)
        sizes[name] = sizes.get(name, 0) + out.count()
        return out
    monkeypatch.setattr(mt, "stage_table", staged)
    got = sorted((str(r.item_id), str(r.qtext), r.intent, f"{r.score:.6f}")
                 for r in fx.nearest_label(idf, "item_id", "qtext", ldf, "intent", max_rows=1).collect())

    def best(text):
        return min((-round(cosine(text or "", x), 12), x) for x in labels)
    want = sorted((str(i), str(t), best(t)[1], f"{-best(t)[0]:.6f}") for i, t in rows)
    assert got == want
    pairs = sum(1 for t in set(items) for x in labels if cosine(t, x))
    assert sizes["near"] < pairs / 2


def test_entries_of_the_other_sides_terms_only(spark):
    """What makes no pair is not written, and labels' texts go with no entry."""
    left = spark.createDataFrame([(1, "cat mat only"), (2, "left only"), (None, "mat")], "lid long, ltext string")
    right = spark.createDataFrame([(7, "cat mat right")], "rid long, rtext string")
    rp = mt.postings(right, ["rid"], "rtext", "r")
    lp = mt.postings(left, ["lid"], "ltext", "l", rp)
    assert sorted((str(r.lid), r.term, round(r.lnorm ** 2)) for r in lp.collect()) == [("1", "cat", 3), ("1", "mat", 3), ("None", "mat", 1)]


def test_a_tasks_rows_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(mt, "TASK_ROWS", 10)
    df = spark.range(95)
    assert mt.dealt(df, ["id"], 95).rdd.getNumPartitions() == 10
    assert mt.dealt(df, ["id"], 5).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
