import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from contentfit.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, row int, cluster string, chunk int, rank int, v int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "c", 2, 3, 4) for r in rows], SCHEMA)


def brute(rows, every=100, k=5, floor_pct=80, scale=256):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v], label) for i, v, label in rows
            if label is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v, label) in enumerate(kept):
        if i is None or i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j is None, j or 0, other == label)
                        for b, (j, w, other) in enumerate(kept) if b != a)
        for s, null, j, _ in [x for x in scored if x[3]][:k]:
            hits = [x for x in scored if not x[3] and floor_pct * -s <= 100 * -x[0] <= 100 * -s][:k]
            out += [(i, None if null else j, rank, None if n[1] else n[2], -s, -n[0]) for rank, n in enumerate(hits, 1)]
    return sorted(out, key=str)


def got(df, every=100, **params):
    return sorted((tuple(r) for r in hn.hard_negatives(df, F.col("id") % every == 0, **params).collect()), key=str)


def clustered_rows(seed, n, width=8, labels=3, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, width))
    return [(i, [float(np.float32(x)) for x in centres[rng.integers(4)] + spread * rng.normal(size=width)],
             int(rng.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("seed, n, every, chunk", [(1, 900, 10, 20_000), (2, 700, 7, 30), (3, 300, 5, 7)])
def test_brute_force(spark, seed, n, every, chunk):
    rows = clustered_rows(seed, n)
    rows += [(n + i, v, (label + i) % 3) for i, (_, v, label) in enumerate(rows[:40])]  # ties
    assert got(frame(spark, rows).repartition(3), every, chunk=chunk) == brute(rows, every)


def test_odd_rows(spark):
    rows = clustered_rows(4, 60)
    v = rows[0][1]
    rows += [rows[0], rows[10], (None, rows[1][1], 1), (None, v, rows[0][2]), (500, None, 1), (501, [None] + v[1:], 0), (502, v, None),
             (600, [math.nan] + v[1:], 0), (700, [0.0] * 8, 1), (800, [-x for x in v], 2), (801, [], 0), (900, v[:4], 0)]
    whole = [r for r in rows if r[1] is None or len(r[1]) != 4]
    assert got(frame(spark, rows), 10) == brute(whole, 10)
    assert got(frame(spark, rows).limit(0), 10) == []
    assert got(frame(spark, [(1, v, 0)]), 10) == []


def test_bounds_hold_and_walks_end_early():
    """The bound is never below a product, and in clustered data most candidates aren't scored."""
    rows = clustered_rows(5, 4000, width=16, labels=2, spread=0.05)
    x = np.array([[math.floor(256 * a) for a in r[1]] for r in rows])
    label = np.array([r[2] for r in rows])
    length = np.sqrt((x.astype(float) ** 2).sum(axis=1))
    near = np.flatnonzero((x[:200] @ x[0]) > 0.9 * length[0] ** 2)
    anchors = {"v": x[near], "label": label[near], "row": near, "cluster": np.zeros(len(near))}
    needs = {"anchor": np.arange(len(near)), "low": np.full(len(near), -2**62), "high": np.full(len(near), 2**62)}
    cluster = hn.Cluster(np.arange(len(near)), anchors, needs, 5)
    bound = cluster.bounds(x.astype(float), length)
    assert (x @ cluster.v.T <= bound[:, None] * cluster.length[None, :] + 1e-6).all()
    made = cluster.walk(x, length, label, np.arange(len(x)), np.arange(len(x)), True)
    assert made < 0.6 * len(near) * len(x)
    for m, a in enumerate(near):
        scores = sorted((-int(x[j] @ x[a]), j) for j in range(len(x)) if j != a and label[j] == label[a])[:5]
        mine = cluster.best.rows[cluster.best.rows[:, 0] == m]
        assert [(s, j) for s, j in mine[:, 1:].tolist()] == scores


def test_best_keeps_ties_by_id():
    best = hn.Best(2, 2)
    best.add(np.array([0, 0, 1]), np.array([5, 5, 1]), np.array([9, 7, 3]))
    best.add(np.array([0, 0]), np.array([5, 6]), np.array([8, 20]))
    assert best.rows.tolist() == [[0, -6, 20], [0, -5, 7], [1, -1, 3]]
    assert best.least.tolist() == [5, np.iinfo(np.int64).min]
