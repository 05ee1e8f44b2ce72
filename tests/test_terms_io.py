"""Priority terms (T1, T2, U1, U2, A5, A6) and I/O checks."""

import pytest

from contentfit.operators import terms as tm
from contentfit.sources import tables as tb


def _perf(spark):
    data = [("a", 5, 1), ("b", 5, 9), ("c", 3, 9), ("d", None, 2), (None, 99, 99), ("e", 1, 0)]
    return spark.createDataFrame(data, "query string, clicks long, impressions long")


def test_top_k_ties_and_nulls(spark):
    out = [(r.query, r.rank) for r in tm.top_k(_perf(spark), "clicks", 3).orderBy("rank").collect()]
    assert out == [("a", 1), ("b", 2), ("c", 3)]       # null query dropped, ties by query


def test_priority_terms_keep_first(spark):
    out = [(r.query, r.source, r.position) for r in tm.priority_terms(_perf(spark), 2).orderBy("position").collect()]
    assert out == [("a", "clicks", 1), ("b", "clicks", 2), ("c", "impressions", 3)]


def test_distinct_first_seen(spark):
    df = spark.createDataFrame([("x", 2, 0), ("x", 1, 5), ("y", 3, 1)], "v string, c long, t long")
    out = {r.v: (r.first_c, r.first_t, r.n) for r in tm.distinct_first_seen(df, "v", ["c", "t"]).collect()}
    assert out == {"x": (1, 5, 2), "y": (3, 1, 1)}


def test_require_columns(spark):
    df = spark.createDataFrame([(1,)], "a long")
    with pytest.raises(tb.MissingColumnsError) as e:
        tb.require_columns(df, ["a", "b"])
    assert e.value.missing == {"b"}


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("q1", "multi\nline, \"quoted\"")], "query string, intent string")
    path = str(tmp_path / "qi")
    tb.write_table(df, path, fmt="csv")
    back = tb.read_csv(spark, path, tb.QUERY_INTENT_SCHEMA, need=["query", "intent"], multi_line=True)
    assert back.collect() == df.collect()


def test_missing_input(spark, tmp_path):
    from pyspark.errors import AnalysisException
    with pytest.raises(AnalysisException):
        tb.read_table(spark, str(tmp_path), "nope").collect()


def test_read_search_performance_csv(spark, tmp_path):
    df = spark.createDataFrame([("q a", 3, 10), (None, 9, 9)], "query string, clicks long, impressions long")
    path = str(tmp_path / "perf")
    tb.write_table(df, path, fmt="csv")
    perf = tb.read_search_performance(spark, path)
    assert [r.query for r in tm.top_k(perf, "clicks", 5).collect()] == ["q a"]


def test_reference_layout_round_trip(spark, tmp_path):
    from contentfit.sources import compat
    df = spark.createDataFrame([("h2", "google reklam verme", "Google Ads Nedir?", 0.671517, "fit")],
                               "section string, query string, text string, score double, verdict string")
    out = compat.to_reference(df, "section_query_fit")
    assert out.columns == ["HTML Bölümü", "İçerik", "Kullanıcı Sorgusu", "Benzerlik Skoru", "Uyum Durumu"]
    assert out.first()["Uyum Durumu"] == "Uyumlu"
    path = str(tmp_path / "fit")
    tb.write_table(out, path, fmt="csv")
    back = compat.from_reference(tb.read_csv(spark, path, need=["HTML Bölümü", "Benzerlik Skoru"]))
    r = back.first()
    assert (r.section, r.query, r.text, float(r.score), r.verdict) == \
        ("h2", "google reklam verme", "Google Ads Nedir?", 0.671517, "fit")


def test_small_tables_are_dealt_over_all_cores(spark):
    from contentfit.sources.tables import read_table, spread
    pages = read_table(spark, "/root/testdata/sf0.001", "pages", ["page_id", "url"])
    dealt = spread(pages)
    assert dealt.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(map(str, dealt.collect())) == sorted(map(str, pages.collect()))
    assert "Exchange" not in spread(pages, bytes_per_task=1)._jdf.queryExecution().executedPlan().toString()


def test_large_row_groups_are_dealt_over_all_cores(spark, tmp_path):
    from contentfit.sources.tables import spread
    rows = [(None if i % 7 == 0 else i // 2, None if i % 5 == 0 else f"text {i // 2}") for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, t string")
    df.coalesce(1).write.parquet(f"{tmp_path}/one")
    one = spark.read.parquet(f"{tmp_path}/one")
    dealt = spread(one, bytes_per_task=1, uneven_bytes=1)
    sizes = [len(p) for p in dealt.rdd.glom().collect()]
    assert sorted(map(str, dealt.collect())) == sorted(map(str, one.collect()))
    assert dealt.columns == one.columns and max(sizes) < 100 and len(sizes) >= spark.sparkContext.defaultParallelism
    df.repartition(16).write.parquet(f"{tmp_path}/many")
    many = spark.read.parquet(f"{tmp_path}/many")
    for as_it_is in (spread(many, bytes_per_task=1, uneven_bytes=1), spread(one.where("k < 0"), bytes_per_task=0, uneven_bytes=0)):
        assert "Exchange" not in as_it_is._jdf.queryExecution().executedPlan().toString()
