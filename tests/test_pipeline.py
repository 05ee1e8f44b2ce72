"""End-to-end job on the smallest driver tables."""

from pyspark.sql import functions as F

from contentfit.functions import rules as rl
from contentfit.operators import sections as sx
from contentfit.plans.pipeline import PipelineConfig, run
from contentfit.sources.tables import read_table

SF = "/root/testdata/sf0.001"


def test_pipeline_stages(spark, tmp_path):
    pages = read_table(spark, SF, "pages", ["page_id", "url", "html"])
    # Search terms derived from the pages themselves (titles), so the fit and
    # improvement stages have rows on driver data.
    perf = sx.page_titles(pages).select(F.col("title").alias("query"),
                                        F.length("title").cast("long").alias("clicks"),
                                        F.col("page_id").alias("impressions"))
    cfg = PipelineConfig(top_k=10, cut=0.3, band=(0.3, 0.85), pack=rl.ENGLISH_TEST)
    out = run(spark, perf, pages, str(tmp_path), cfg)
    assert 10 <= out["queries"].count() <= 20
    assert out["sections"].count() > 0
    assert out["fit"].count() > 0
    n_improved = out["improved"].count()
    assert n_improved > 0
    assert out["report_rows"].count() <= n_improved
    s = {r.mode: r for r in out["report_summary"].collect()}
    assert set(s) == {"intent", "query"} and s["query"].n_rows == out["report_rows"].count()


def test_pipeline_with_labels_and_attempts(spark, tmp_path):
    pages = spark.createDataFrame([
        (1, "http://h/a", "<title>cheap red shoes</title><meta name=description content='shoes for less'>"
                          "<h1>red shoes</h1><p>walk far<div>outer <div>inner</div></div>"),
        (2, "http://h/b", "<title>blue hats</title><ul><li>hats<li>caps</ul>")], "page_id long, url string, html string")
    perf = spark.createDataFrame([("red shoes", 9, 1), ("blue hats online", 5, 9), ("how to walk", 1, 3)],
                                 "query string, clicks long, impressions long")
    labels = spark.createDataFrame([("red shoes", "buy shoes"), ("red shoes", "zz")], "query string, intent string")
    cfg = PipelineConfig(cut=0.5, band=(0.3, 0.9), pack=rl.ENGLISH_TEST)
    out = run(spark, perf, pages, str(tmp_path), cfg, labels=labels)
    intents = {r.query: r.intent for r in out["query_intents"].collect()}
    assert intents["red shoes"] == "buy shoes" and set(intents.values()) <= {"buy shoes", "zz"}
    sections, queries = out["sections"].count(), out["queries"].count()
    assert out["section_query_fit"].count() == sections * queries
    assert out["field_query_fit"].count() == 2 * 2 * queries and out["field_self_fit"].count() == 2
    work = out["intent_work"].collect()
    assert work and out["intent_improvement"].where("attempt > 0").count() == 0
    raw = [(r.row_key, 1, t, x) for r in work for t, x in ((1, "no json"), (2, 'ok {"text": "' + r.intent + '"}'))]
    attempts = spark.createDataFrame(raw, "row_key string, attempt int, try int, raw string")
    again = run(spark, perf, pages, str(tmp_path / "b"), cfg, labels=labels, attempts=attempts)
    better = again["intent_improvement"].where("attempt = 1").collect()
    assert better and all(r.new_score == 1.0 for r in better)
    assert again["report_rows"].where("mode = 'intent'").count() > 0
    kept = run(spark, perf.limit(0), pages.limit(0), str(tmp_path / "b"), cfg, resume=True)
    assert kept["report_rows"].count() == again["report_rows"].count()
