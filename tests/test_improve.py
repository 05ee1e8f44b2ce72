"""Improvement jobs and the report."""


from contentfit.operators import improve as im
from contentfit.operators import report as rp


def _rows(spark, old_score=0.66):
    return spark.createDataFrame([(1, "cat mat", "dog", None, old_score)],
                                 "row_key long, intent string, old_text string, section string, old_score double")


def test_first_improving_attempt_choice(spark):
    rows = _rows(spark, 0.5)
    cands = spark.createDataFrame([(1, 1, "dog dog"), (1, 2, "cat"), (1, 3, "cat mat")],
                                  "row_key long, attempt int, text string")
    r = im.first_improving_attempt(rows, cands).first()
    assert r.attempt == 2 and r.new_text == "cat"   # first that improves, not the best
    assert r.section == "p"                         # P6 default


def test_first_improving_attempt_rollback(spark):
    rows = _rows(spark, 0.99)
    cands = spark.createDataFrame([(1, 1, "cat"), (1, 2, "mat")], "row_key long, attempt int, text string")
    r = im.first_improving_attempt(rows, cands).first()
    assert r.attempt == 0 and r.new_text == "dog" and r.new_score == 0.99 and r.pct_change == 0.0


def test_attempt_texts_first_valid_try(spark):
    rows = _rows(spark)
    raw = spark.createDataFrame([(1, 1, 1, "garbage"), (1, 1, 2, 'x {"text": "v2"} y'), (1, 1, 3, '{"text": "v3"}'),
                                 (1, 2, 1, "none"), (1, 2, 2, "{'text': 'single quotes'}")],
                                "row_key long, attempt int, try int, raw string")
    out = {r.attempt: r.text for r in im.attempt_texts(raw, rows).collect()}
    assert out == {1: "v2", 2: "dog"}               # no valid try -> current text


def test_improvable_filters(spark):
    fit = spark.createDataFrame([(0.65, "fit"), (0.85, " FIT "), (0.649999, "fit"), (None, "fit"), (0.7, "low_fit")],
                                "score double, verdict string")
    assert fit.transform(lambda d: im.improvable(d, "strict")).count() == 2
    assert fit.transform(lambda d: im.improvable(d, "any")).count() == 5


def test_first_k_in_order(spark):
    df = spark.createDataFrame([(1, 5), (1, 2), (1, 9), (1, 4), (2, 7)], "k long, t long")
    first = im.first_k_in_order(df, "k", ["t"], 3)
    p = first._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.k, r.nth, r.t) for r in first.collect()) == [(1, 1, 2), (1, 2, 4), (1, 3, 5), (2, 1, 7)]
    assert "WindowGroupLimit" in p and p.count("Exchange") == 1


def test_report_goldens_intent_table(spark):
    # Committed intent-improvement rows: (section, old, new, change).
    rows = [("div", 0.660704, 0.687436, 4.05), ("div", 0.660704, 0.730403, 10.55),
            ("li", 0.714652, 0.816071, 14.19), ("div", 0.655036, 0.655036, 0.0),
            ("div", 0.655036, 0.655036, 0.0), ("li", 0.741646, 0.769194, 3.71)]
    df = spark.createDataFrame([(s, "i", "a", "b", o, n, c) for s, o, n, c in rows],
                               "section string, intent string, old_text string, new_text string, "
                               "old_score double, new_score double, pct_change double")
    rep = rp.report_rows(df, "intent", "intent")
    s = {r.mode: r for r in rp.report_summary(rep).collect()}
    assert s["intent"].n_rows == 4 and s["intent"].n_improved == 4
    assert abs(s["intent"].avg_new_score - 0.750776) < 1e-6
    assert abs(s["intent"].avg_delta - 8.125) < 1e-9
    assert s["query"].n_rows == 0 and s["query"].avg_new_score == 0.0
    f = {r.mode: r for r in rp.summary_formatted(rp.report_summary(rep)).collect()}
    assert f["intent"].avg_new_score_txt == "0.751" and f["intent"].avg_delta_txt == "8.13%"


def test_grain_aware_improver_equals_rowwise(spark):
    from contentfit.functions import rules as R
    work = spark.createDataFrame([
        (1, "h1", "Old heading", "the cat how", 0.7), (2, "p", "arama sonuçlar text", "with that", 0.66),
        (3, "li", "", "nothing", 0.7), (4, "li", "an item", "with", 0.7), (5, "li", "an item", "zzz", 0.7),
        (6, "title", "The the title", "the in", 0.7), (7, "div", "x", "that", 0.8), (8, "h2", "a b c", "ofs guide", 0.7),
    ], "k long, section string, text string, query string, score double")
    args = dict(keys=["k"], query_col="query", text_col="text", section_col="section", score_col="score")
    for pack in (R.ENGLISH_TEST, R.TURKISH_ADS):
        a = sorted(tuple(r) for r in im.improve_by_rules_rowwise(work, pack, **args).collect())
        b = sorted(tuple(r) for r in im.improve_by_rules(work, pack, **args).collect())
        c = sorted(tuple(r) for r in im.improve_by_rules(work, pack, section_keys=["k"], query_keys=["k"],
                                                           **args).collect())
        sections, queries = work.select("k", "section", "text"), work.select("k", "query")
        d = sorted(tuple(r) for r in im.improve_by_rules(
            work.select("k", "score"), pack, section_keys=["k"], query_keys=["k"], sections=sections, queries=queries,
            **args).collect())
        assert a == b == c == d


def test_candidates_are_scored_at_every_cut(spark):
    import random

    from contentfit.functions import rules as R
    from contentfit.operators.vectors import lexical_cosine, lexical_vector
    rnd = random.Random(5)
    words = ["the", "The", "of", "in", "with", "that", "how", "from", "it's", "text", "--", "a", "x,y", "rehberi", "verme", "nasıl"]
    pick = lambda most: " ".join(rnd.choice(words) for _ in range(rnd.randrange(most)))
    work = spark.createDataFrame([(i, rnd.choice(["h1", "h2", "p", "div", "li", "title", "h3", None]), pick(25), pick(40), rnd.random())
                                  for i in range(300)], "k long, section string, text string, query string, score double")
    args = dict(keys=["k"], query_col="query", text_col="text", section_col="section", score_col="score")
    for pack, rollback in ((R.ENGLISH_TEST, False), (R.TURKISH_ADS, True)):
        a = sorted(map(str, im.improve_by_rules_rowwise(work, pack, rollback=rollback, **args).collect()))
        assert a == sorted(map(str, im.improve_by_rules(work, pack, rollback=rollback, **args).collect()))
    # Texts are taken apart once a section or query, not once a pair.
    plan = im.improve_by_rules(work, R.ENGLISH_TEST, **args)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" in plan and "regexp_extract_all" not in plan.split("Join")[0]
    cuts = [(q, " ".join(c.split()[:n])) for q, c in [("a b a", "a x b b, a"), ("a", ""), ("", "a"), ("é É", "É é-é")]
            for n in range(1, len(c.split()) + 1)]
    whole = spark.createDataFrame(cuts, "q string, c string").select(lexical_cosine(lexical_vector("q"), lexical_vector("c")))
    made = [s for q, c in [("a b a", [["a"], ["x"], ["b"], ["b"], ["a"]]), ("", [["a"]]), ("é é", [["é"], ["é", "é"]])]
            for s in im._cut_cosines(q.split(), [c])[0]]
    assert made == [r[0] for r in whole.collect()] and im._cut_cosines(["a"], [[[]]]) == [[0.0]]


def test_report_parses_text_numbers(spark):
    # An improvement table read from CSV holds numbers as text.
    df = spark.createDataFrame([("li", "q", "a", "b", "0.714652", " 0.816071 ", "14,19%"),
                                ("p", "q", "a", "b", "0.5", "0.5", "abc")],
                               "section string, query string, old_text string, new_text string, "
                               "old_score string, new_score string, pct_change string")
    rows = rp.report_rows(df, "query", "query").collect()
    assert len(rows) == 1 and rows[0].delta == 14.19 and rows[0].new_score == 0.816071


def test_query_job_improves_subheadings(spark, tmp_path):
    from contentfit.plans import catalog as C
    x = "pick running shoes for summer days today"
    html = f"<html><head><title>t</title></head><body><h1>{x}</h1><h2>{x}</h2><h3>{x}</h3><p>other</p></body></html>"
    only = f"<html><head><title>t</title></head><body><h3>{x}</h3><h2>{x}</h2></body></html>"
    spark.createDataFrame([(1, "https://a.example/", html), (2, "https://b.example/", only)],
                          "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(7, "how to pick running shoes for winter rain", "en")],
                          "item_id long, text string, lang string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = {(r["page_id"], r["section"]): r for r in C.improve_by_rules(spark, str(tmp_path)).collect()}
    assert set(rows) == {(1, "h1"), (1, "h2"), (1, "h3"), (2, "h2"), (2, "h3")}
    assert all(r["old_text"] == x and r["old_score"] == rows[1, "h1"]["old_score"] for r in rows.values())
    for page in (1, 2):  # h2 takes the heading branch, h3 that of other tags
        assert rows[page, "h2"]["new_text"] == rows[1, "h1"]["new_text"]
        assert rows[page, "h3"]["new_text"] == rows[1, "h3"]["new_text"] != rows[1, "h1"]["new_text"]
    assert {r["page_id"] for r in C.pct_change(spark, str(tmp_path)).collect()} == {1, 2}
