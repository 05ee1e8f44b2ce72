"""The trained vectors against a small dense SVD."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from contentfit.operators import fit as fx
from contentfit.operators import latent as lt
from contentfit.operators import weighting as wt


@pytest.fixture(scope="module")
def trained(spark):
    rng = np.random.default_rng(4)
    topics = [[f"{t}{i}" for i in range(12)] for t in "abcd"]
    rows = [(i, " ".join(rng.choice(topics[i % 4], 9)) + " the of" + (" the" * (i % 3))) for i in range(80)]
    df = spark.createDataFrame(rows, "k long, t string")
    weights = wt.fit_idf(df, "t")
    model, values = lt.fit_latent(df, "t", weights, k=5, more=8, iterations=4)
    return rows, df, weights, model, values


def dense(rows):
    words = sorted({w for _, t in rows for w in t.split()})
    texts = sorted({t for _, t in rows})
    count = np.array([[t.split().count(w) for w in words] for t in texts], dtype=float)
    n = len(rows)
    df = np.array([sum(w in t.split() for _, t in rows) for w in words])
    weighted = count * (np.log((1 + n) / (1 + df)) + 1)
    return words, texts, weighted / np.linalg.norm(weighted, axis=1)[:, None]


def test_values_and_space_equal_a_dense_svd(trained):
    rows, _, _, model, values = trained
    words, _, a = dense(rows)
    _, s, vt = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(values[:4], s[:4], rtol=1e-5) and np.isclose(values[4], s[4], rtol=2e-2)  # beyond the fourth there is no gap
    got = {r["term"]: r["v"] for r in model.collect()}
    v = np.array([got[w] for w in words])
    assert np.allclose(v.T @ v, np.eye(5), atol=1e-6)
    # The first four directions, the topics, are apart from the rest; signs and turns may differ.
    overlap = np.linalg.svd(v[:, :4].T @ vt[:4].T)[1]
    assert overlap.min() > 0.99


def test_folded_texts_and_scores(spark, trained):
    rows, df, weights, model, _ = trained
    words, texts, a = dense(rows)
    got = {r["term"]: r["v"] for r in model.collect()}
    want = a @ np.array([got[w] for w in words])
    vectors = {r["t"]: r["vec"] for r in lt.fold(df, ["k"], "t", weights, model, "vec").collect()}
    assert len(vectors) == len(texts) and all(np.allclose(vectors[t], want[i], atol=1e-9) for i, t in enumerate(texts))
    # J1 and V4 on them: texts of one topic fit though they share few words.
    left = lt.fold(df.where("k < 8"), ["k"], "t", weights, model, "lv").select("k", "lv")
    right = lt.fold(df.where("k >= 60").withColumnRenamed("k", "rk"), ["rk"], "t", weights, model, "rv").select("rk", "rv")
    pairs = fx.dense_all_pairs(left, "lv", right, "rv", cut=0.65).collect()
    assert len(pairs) == 8 * 20
    assert np.mean([(r.verdict == "fit") == (r.k % 4 == r.rk % 4) for r in pairs]) > 0.9
    other = lt.fold(spark.createDataFrame([(1, "unknown words"), (2, None)], "k long, t string"), ["k"], "t", weights, model)
    assert [r["v"] for r in other.orderBy("k").collect()] == [[0.0] * 5] * 2


def test_bad_dimensions(trained):
    _, df, weights, _, _ = trained
    with pytest.raises(ValueError):
        lt.fit_latent(df.select(F.col("t")), "t", weights, k=65)
