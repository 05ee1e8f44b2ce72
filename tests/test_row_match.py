"""Scoring row by row equals scoring pair by pair, in bounded pieces."""

import numpy as np
import pyarrow as pa

from contentfit.operators import fit as fx
from contentfit.operators import row_match as rm

LEFT = [(i % 7, " ".join(f"w{(i * j) % 11}" for j in range(i % 9))) for i in range(120)] + [(None, "w1 W1 ıx İ"), (3, None), (3, "zz")] * 2
RIGHT = [(i, f"w{i % 5} w{i % 3} w1") for i in range(12)] + [(None, "w2 w2"), (2, "w2 w1"), (2, "w2 w1"), (50, ""), (51, None), (52, "i̇ ıx")]


def _frames(spark):
    return spark.createDataFrame(LEFT, "lid long, ltext string"), spark.createDataFrame(RIGHT, "rid long, rtext string")


def _pairs(df):
    return sorted((str(r.lid), str(r.rid), round(r.raw_score, 12)) for r in df.collect())


def test_equals_the_term_join(spark, monkeypatch):
    left, right = _frames(spark)
    joined = fx.lexical_scores(left, ["lid"], "ltext", right, ["rid"], "rtext")
    want = _pairs(joined.where("raw_score >= 0.3"))
    assert _pairs(fx.lexical_match(left, ["lid"], "ltext", right, ["rid"], "rtext", 0.3)) == want
    every = rm.cosines(left, ["lid"], "ltext", right, ["rid"], "rtext", 0.0)
    assert every.count() == len(LEFT) * len(RIGHT)
    assert _pairs(every.where("raw_score > 0")) == _pairs(joined)


def test_pairs_are_not_shuffled(spark):
    """Memory of a task and bytes shuffled grew with the pairs before."""
    left, right = _frames(spark)
    m = fx.lexical_match(left.repartition(3), ["lid"], "ltext", right, ["rid"], "rtext", 0.3)
    m.collect()
    final = m._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "HashAggregate" not in final and "hashpartitioning" not in final


def test_empty_sides(spark):
    left, right = _frames(spark)
    for a, b in ((left.limit(0), right), (left, right.limit(0)), (left, right.where("rid = 50"))):
        assert fx.lexical_match(a, ["lid"], "ltext", b, ["rid"], "rtext", 0.1).count() == 0
        assert rm.cosines(a, ["lid"], "ltext", b, ["rid"], "rtext", 0.0).count() == a.count() * b.count()


def test_pieces_and_large_counts(monkeypatch):
    vectors = pa.array([{"entries": [{"term": "a", "tf": 3}, {"term": "b", "tf": 4}], "norm": 5.0},
                        {"entries": [], "norm": 0.0}, {"entries": [{"term": "b", "tf": 1}], "norm": 1.0}])
    items, words = rm.Items(vectors), pa.array([["a"] * 3 + ["b"] * 4, [], ["b", "c"], ["c"], ["a", "b", "b"]])
    whole = np.concatenate(list(items.scores(words)))
    assert whole.tolist()[0] == [1.0, 0.0, 0.8] and whole.tolist()[1] == whole.tolist()[3] == [0.0] * 3
    monkeypatch.setattr(rm, "CELLS", 4)
    assert np.array_equal(np.concatenate(list(items.scores(words))), whole)
    exact, slow = (items.sums(np.array([0, 0, 1]), np.array([0, 1, 1]), np.array([2, 5, 1]), 2, exact=e).tolist() for e in (True, False))
    assert exact == slow == [[26, 0, 5], [4, 0, 1]]
