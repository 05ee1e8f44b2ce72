"""Scoring joins: properties and brute-force agreement."""

import math
from collections import Counter

from pyspark.sql import functions as F

from contentfit.operators import fit as fx
from contentfit.operators import vectors as V

LEFT = [(1, "the cat sat on the mat"), (2, "a dog"), (3, ""), (4, "cat cat dog mat"), (5, "zebra")]
RIGHT = [(10, "cat mat"), (11, "dog dog"), (12, "the the the"), (13, "")]


def _frames(spark):
    left = spark.createDataFrame(LEFT, "lid long, ltext string")
    right = spark.createDataFrame(RIGHT, "rid long, rtext string")
    return left, right


def _brute(a, b):
    import re
    from collections import Counter
    ta, tb = Counter(re.findall(r"\w+", a.lower())), Counter(re.findall(r"\w+", b.lower()))
    dot = sum(v * tb[k] for k, v in ta.items())
    na, nb = math.sqrt(sum(v * v for v in ta.values())), math.sqrt(sum(v * v for v in tb.values()))
    return 0.0 if na == 0 or nb == 0 else dot / (na * nb)


def test_all_pairs_count_and_values(spark):
    left, right = _frames(spark)
    out = fx.lexical_all_pairs(left, "ltext", right, "rtext", ["rid"], cut=0.5).collect()
    assert len(out) == len(LEFT) * len(RIGHT)
    for r in out:
        exp = _brute(dict(LEFT)[r.lid], dict(RIGHT)[r.rid])
        assert abs(r.score - round(exp, 6)) < 1e-9
        assert -1.0 <= r.score <= 1.0
        assert r.verdict == ("fit" if exp >= 0.5 else "low_fit")


def test_self_score_is_one(spark, one):
    v = V.lexical_vector(F.lit("alpha beta beta"))
    assert abs(one(V.lexical_cosine(v, v)) - 1.0) < 1e-12


def test_match_equals_filtered_all_pairs(spark):
    left, right = _frames(spark)
    full = {(r.lid, r.rid): r.score for r in
            fx.lexical_all_pairs(left, "ltext", right, "rtext", ["rid"]).collect() if r.score >= 0.3}
    m = {(r.lid, r.rid): r.score for r in
         fx.lexical_match(left, ["lid"], "ltext", right, ["rid"], "rtext", 0.3).collect()}
    assert m == full


def test_bounded_paths_give_same_result(spark):
    """Force the grid, the pruned join and the salted shuffle join."""
    left, right = _frames(spark)
    base = sorted(tuple(r) for r in fx.lexical_all_pairs(left, "ltext", right, "rtext", ["rid"]).collect())
    chunked = sorted(tuple(r) for r in
                     fx.lexical_all_pairs(left, "ltext", right, "rtext", ["rid"], max_rows=3).collect())
    assert base == chunked
    a = sorted(tuple(r) for r in fx.lexical_match(left, ["lid"], "ltext", right, ["rid"], "rtext", 0.1).collect())
    b = sorted(tuple(r) for r in fx.lexical_match(left, ["lid"], "ltext", right, ["rid"], "rtext", 0.1, max_rows=1).collect())
    assert a == b
    c, d = (sorted(tuple(r) for r in fx.lexical_scores(left, ["lid"], "ltext", right, ["rid"], "rtext", **how).collect())
            for how in ({}, {"max_rows": 1, "salt_buckets": 3}))
    assert c == d and len(c) > len(a) // 2


def test_partition_count_independent(spark):
    left, right = _frames(spark)
    a = sorted(tuple(r) for r in fx.lexical_match(left.repartition(1), ["lid"], "ltext", right, ["rid"],
                                                    "rtext", 0.1).collect())
    b = sorted(tuple(r) for r in fx.lexical_match(left.repartition(7), ["lid"], "ltext", right, ["rid"],
                                                    "rtext", 0.1).collect())
    assert a == b


def test_best_section_per_query(spark):
    secs = spark.createDataFrame([(1, "p", 1, "cat"), (1, "p", 2, "cat cat mat"), (1, "h1", 1, "zebra"),
                                  (2, "li", 1, "nothing here")],
                                 "page_id long, section string, ordinal int, text string")
    qs = spark.createDataFrame([(10, "cat mat"), (11, "unrelated")], "item_id long, qtext string")
    out = {(r.page_id, r.item_id): (r.section, r.ordinal) for r in
           fx.best_section_per_query(secs, qs, "item_id", "qtext").collect()}
    assert out[(1, 10)] == ("p", 2)
    assert out[(1, 11)] == ("h1", 1)      # all zero: first by (section, ordinal)
    assert out[(2, 11)] == ("li", 1)


def test_dense_cosine(spark, one):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))
    assert abs(one(V.dense_cosine(a, b)) - 1 / math.sqrt(2)) < 1e-12


def test_embedder_udf(spark):
    enc = V.embedder_udf(lambda texts: [[float(len(t)), 1.0] for t in texts])
    df = spark.createDataFrame([("ab",), ("abcd",)], "t string")
    rows = df.select(enc("t").alias("v")).collect()
    assert [list(r.v) for r in rows] == [[2.0, 1.0], [4.0, 1.0]]


def test_nearest_label(spark):
    items = spark.createDataFrame([(1, "buy cheap shoes"), (2, "zzz")], "item_id long, qtext string")
    labs = spark.createDataFrame([("shoes shopping",), ("travel",), ("a label",)], "intent string")
    out = {r.item_id: r.intent for r in fx.nearest_label(items, "item_id", "qtext", labs, "intent").collect()}
    assert out == {1: "shoes shopping", 2: "a label"}


def test_lsh_pairs_are_exact_pairs(spark):
    from contentfit.plans import catalog as C
    sf = "/root/testdata/sf0.001"
    exact = {(r.vec_id, r.centroid_label): r.score for r in C.dense_fit(spark, sf).collect() if r.score >= 0.3}
    approx = {(r.vec_id, r.centroid_label): r.score for r in C.lsh_fit(spark, sf).collect()}
    assert set(approx) <= set(exact)
    assert all(abs(approx[k] - exact[k]) < 1e-5 for k in approx)


def test_lsh_recall(spark):
    from contentfit.plans import catalog as C
    sf = "/root/testdata/sf0.01"
    exact = {(r.vec_id, r.centroid_label) for r in C.dense_fit(spark, sf).collect() if r.score >= 0.3}
    approx = {(r.vec_id, r.centroid_label) for r in C.lsh_fit(spark, sf).collect()}
    print(f"lsh_fit finds {len(approx & exact)} of {len(exact)} pairs")
    assert exact and len(approx & exact) >= 0.9 * len(exact)


def test_assign_labels_supplied_first(spark):
    items = spark.createDataFrame([(1, "buy shoes"), (2, "cheap travel deals")], "item_id long, qtext string")
    supplied = spark.createDataFrame([("buy shoes", "shopping intent")], "query string, intent string")
    labs = spark.createDataFrame([("travel deals",), ("shoes",)], "intent string")
    out = {r.item_id: (r.intent, r.score) for r in
           fx.assign_labels(items, "item_id", "qtext", supplied, labs, "intent").collect()}
    assert out[1] == ("shopping intent", 1.0)
    assert out[2][0] == "travel deals"


def test_hashed_vector_matches_lexical_without_collisions(spark, one):
    a, b = F.lit("the cat sat on the mat"), F.lit("cat mat dog")
    lex = one(V.lexical_cosine(V.lexical_vector(a), V.lexical_vector(b)))
    hashed = one(V.lexical_cosine(V.hashed_vector(a, 1 << 20), V.hashed_vector(b, 1 << 20)))
    assert abs(lex - hashed) < 1e-12


def _scans(df, node):
    return df._jdf.queryExecution().executedPlan().toString().count(node)


def test_grid_of_two_large_sides(spark, tmp_path):
    """Beyond the bound both sides are read once and no side is broadcast."""
    spark.range(0, 300).selectExpr("id as a", "id % 7 as x").write.parquet(str(tmp_path / "l"))
    left = spark.read.parquet(str(tmp_path / "l"))
    right = spark.range(0, 120).selectExpr("id as b", "id % 5 as y").unionByName(spark.createDataFrame([(7, 2)] * 30, "b long, y long"))
    grid = fx.all_pairs(left, right, lambda: (F.col("x") * F.col("y")).cast("double"), max_rows=25)
    assert _scans(grid, "FileScan") == 1 and _scans(grid, "BroadcastNestedLoopJoin") == _scans(grid, "CartesianProduct") == 0
    want = sorted((a, a % 7, b, b % 5, float(a % 7 * (b % 5))) for a in range(300) for b in [*range(120), *[7] * 30])
    assert sorted(tuple(r) for r in grid.collect()) == want


def test_lexical_grid_reads_the_left_side_twice_at_most(spark, tmp_path):
    """Once for scores, once for the rows: not once for each block."""
    rows = [(i, f"w{i % 9} w{i % 4} common") for i in range(60)] + [(3, "w3 w3 common")] * 2 + [(None, "w1")]
    spark.createDataFrame(rows, "lid long, ltext string").write.parquet(str(tmp_path / "l"))
    left = spark.read.parquet(str(tmp_path / "l"))
    right = spark.createDataFrame([(i, f"w{i % 5} common") for i in range(40)] + [(99, "")], "rid long, rtext string")
    small, grid = (fx.lexical_all_pairs(left, "ltext", right, "rtext", ["rid"], max_rows=n) for n in (1000, 8))
    assert sorted(map(str, grid.collect())) == sorted(map(str, small.collect())) and grid.count() == len(rows) * 41
    assert _scans(grid, "FileScan") == _scans(small, "FileScan")


def test_row_identity_survives_another_numbering(spark):
    """Rows are known by what they hold: shuffled input with repeats gives the same result, however it is dealt."""
    rows = [(i % 4, f"w{i % 3} w{i % 5}") for i in range(60)] + [(None, "w1 w2")] * 3
    right = spark.createDataFrame([(1, "w1 w2"), (1, "w1 w2"), (2, "w0 w4"), (None, "w3")], "rid long, rtext string")
    got = []
    for n in (1, 5):
        left = spark.createDataFrame(rows, "lid long, ltext string").repartition(n)
        plan = fx.lexical_scores(left, ["lid"], "ltext", right, ["rid"], "rtext")
        assert "monotonically" not in plan._jdf.queryExecution().optimizedPlan().toString()
        got.append(sorted((str(r.lid), str(r.rid), r.dot, round(r.raw_score, 9)) for r in plan.collect()))
    want = sorted((str(a), str(b), sum(Counter(x.split())[w] * n for w, n in Counter(y.split()).items()), round(_brute(x, y), 9))
                  for a, x in rows for b, y in [(1, "w1 w2"), (1, "w1 w2"), (2, "w0 w4"), (None, "w3")] if set(x.split()) & set(y.split()))
    assert got[0] == got[1] == want


def test_rows_repeating_a_key_are_scored_by_their_own_text(spark):
    left = spark.createDataFrame([(1, "cat mat"), (1, "cat mat"), (1, "dog dog"), (None, "cat mat")], "lid long, ltext string")
    right = spark.createDataFrame(RIGHT[:2], "rid long, rtext string")
    got = sorted((r.lid or 0, r.rid, r.score) for r in
                 fx.lexical_match(left, ["lid"], "ltext", right, ["rid"], "rtext", 0.1).collect())
    assert got == [(0, 10, 1.0), (1, 10, 1.0), (1, 10, 1.0), (1, 11, 1.0)]
    full = fx.lexical_all_pairs(left, "ltext", right, "rtext", ["rid"]).collect()
    assert sorted((r.lid or 0, r.ltext, r.rid, r.score) for r in full) == sorted(
        [(0, "cat mat", 10, 1.0), (0, "cat mat", 11, 0.0), (1, "cat mat", 10, 1.0), (1, "cat mat", 11, 0.0),
         (1, "cat mat", 10, 1.0), (1, "cat mat", 11, 0.0), (1, "dog dog", 10, 0.0), (1, "dog dog", 11, 1.0)])


def test_zero_vectors_score_zero(spark):
    left = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "id long, v array<double>")
    right = spark.createDataFrame([(7, [0.0, 0.0]), (8, [2.0, 0.0])], "rid long, w array<double>")
    got = {(r.id, r.rid): r.score for r in fx.dense_all_pairs(left, "v", right, "w").collect()}
    assert got == {(1, 7): 0.0, (1, 8): 0.0, (2, 7): 0.0, (2, 8): 1.0}


def test_supplied_labels_have_a_total_order(spark):
    items = spark.createDataFrame([(1, "buy shoes")], "item_id long, qtext string")
    supplied = spark.createDataFrame([("buy shoes", "z"), ("buy shoes", "a"), ("buy shoes", None)], "query string, intent string")
    labs = spark.createDataFrame([("shoes",)], "intent string")
    assert [r.intent for r in fx.assign_labels(items, "item_id", "qtext", supplied, labs, "intent").collect()] == ["a"]


def test_the_grid_of_all_pairs_is_not_shuffled(spark):
    left, right = _frames(spark)
    p = fx.lexical_all_pairs(left, "ltext", right, "rtext", ["rid"])._jdf.queryExecution().executedPlan().toString()
    above = p[:p.index("BroadcastNestedLoopJoin") if "BroadcastNestedLoopJoin" in p else p.index("CartesianProduct")]
    assert "Exchange" not in above


def test_all_pairs_shuffle_neither_scores_nor_texts(spark):
    """Scores were summed and gathered by shuffles of every pair that shares a term."""
    left, right = _frames(spark)
    out = fx.lexical_all_pairs(left.repartition(3), "ltext", right, "rtext", ["rid"])
    out.collect()
    final = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "HashAggregate" not in final and "hashpartitioning" not in final


def test_texts_of_a_repeated_right_key(spark):
    """Scores above zero, equal ones once; zero where none is; in blocks as in one."""
    rows, keys = [("a b", 1), ("zz", 2), (None, 3), ("a b", 1)], [(1, "a"), (1, "b"), (1, "q"), (1, "a b"), (2, "q"), (2, None), (None, "a")]
    left, right = spark.createDataFrame(rows, "ltext string, lid int"), spark.createDataFrame(keys, "rid int, rtext string")
    half = 1 / math.sqrt(2)
    ab, none = [(1, half), (1, 1.0), (2, 0.0), (None, half)], [(1, 0.0), (2, 0.0), (None, 0.0)]
    want = sorted(str((t, i, k, round(s, 6))) for t, i in rows for k, s in (ab if t == "a b" else none))
    for most in (1000, 1):
        got = fx.lexical_all_pairs(left, "ltext", right, "rtext", ["rid"], max_rows=most).collect()
        assert sorted(str((r.ltext, r.lid, r.rid, round(r.score, 6))) for r in got) == want


def test_best_sections_are_found_in_the_task(spark, monkeypatch):
    """Only pages whose sections lie apart are compared by a shuffle; before, every scored pair was."""
    rows = [(p if p % 5 else None if p else 3, s, o, f"w{(p * o) % 4} w{(p + o) % 3} {s}") for p in range(12) for s in ("p", "h1", "li") for o in (2, 1, 3)]
    rows += [(40, "p", 1, None), (40, "h1", 1, ""), (41, None, 1, "w1"), (41, "p", None, "w1")]
    items = [(i, f"w{i % 4} w{i % 2}") for i in range(6)] + [(2, "h1"), (None, "w1 li"), (7, None), (2, "h1")]
    queries, order = spark.createDataFrame(items, "item_id long, qtext string"), lambda r: tuple((x is not None, x) for x in r[:2])
    want = {}
    for p, k in {(r[0], i[0]) for r in rows for i in items}:
        scored = [(s, o, max(_brute(t or "", x or "") for i, x in items if i == k)) for q, s, o, t in rows if q == p]
        top = max(r[2] for r in scored)
        want[p, k] = (*min((r for r in scored if r[2] >= top - 1e-12), key=order)[:2], round(top, 6))
    seen, best = [], fx.best_by
    monkeypatch.setattr(fx, "best_by", lambda pairs, *a: seen.append(pairs) or best(pairs, *a))
    schema = "page_id long, section string, ordinal int, text string"
    for frame, most in ((spark.createDataFrame(rows, schema).coalesce(1), 1000), (spark.createDataFrame(rows, schema).repartition(4), 1000),
                        (spark.createDataFrame(rows, schema), 1)):
        got = {(r.page_id, r.item_id): (r.section, r.ordinal, round(r.score, 6)) for r in
               fx.best_section_per_query(frame, queries, "item_id", "qtext", max_rows=most).collect()}
        assert got == want
    # In one task all pages but the two that occur twice are whole: two runs of either, of eight keys.
    assert seen[0].count() == (2 + 2) * 8
