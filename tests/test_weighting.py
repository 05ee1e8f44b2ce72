import math
from collections import Counter

import pytest

from contentfit.operators import weighting as wt

CORPUS = [(1, "the cat sat"), (2, "the dog"), (3, "the the end"), (4, ""), (5, None), (6, "cat")]


def brute(corpus, rows_l, rows_r, cut):
    docs = [set((t or "").split()) for _, t in corpus]

    def vector(t):
        return {w: c * (math.log((1 + len(docs)) / (1 + sum(w in d for d in docs))) + 1) for w, c in Counter((t or "").split()).items()}

    def norm(v):
        return math.sqrt(sum(x * x for x in v.values()))
    out = []
    for a, x in rows_l:
        for b, y in rows_r:
            u, v = vector(x), vector(y)
            if u and v and (s := sum(w * v.get(k, 0) for k, w in u.items()) / (norm(u) * norm(v))) >= cut:
                out.append((str(a), str(b), f"{s:.6f}"))
    return sorted(out)


def test_weighted_match_equals_brute_force(spark):
    left = CORPUS + [(1, "the cat sat"), (None, "dog end unseen")]
    right = [(10, "cat"), (11, "the dog dog"), (12, "unseen words"), (13, ""), (None, "the end")]
    df = spark.createDataFrame(left, "lid long, ltext string")
    model = wt.fit_idf(spark.createDataFrame(CORPUS, "k long, t string"), "t")
    got = wt.idf_match(df, ["lid"], "ltext", spark.createDataFrame(right, "rid long, rtext string"), ["rid"], "rtext", model, 0.1)
    assert sorted((str(r.lid), str(r.rid), f"{r.score:.6f}") for r in got.collect()) == brute(CORPUS, left, right, 0.1)


def test_models_are_kept_by_version(spark, tmp_path):
    path = str(tmp_path / "idf")
    one = spark.createDataFrame(CORPUS[:2], "k long, t string")
    assert wt.save_model(wt.fit_idf(one, "t"), path) == 1
    assert wt.save_model(wt.fit_idf(spark.createDataFrame(CORPUS, "k long, t string"), "t"), path) == 2

    def known(**how):
        return {r["term"]: r["df"] for r in wt.load_model(spark, path, **how).collect()}
    assert known(version=1) == {"the": 2, "cat": 1, "sat": 1, "dog": 1, None: 2}
    assert known() == known(version=2) == {"the": 3, "cat": 2, "sat": 1, "dog": 1, "end": 1, None: 6}
    with pytest.raises(ValueError):
        wt.load_model(spark, path, 3)
