"""Fit tables by score range: the same rows from fewer files."""

from pyspark.sql import functions as F

from contentfit.operators import fit as fx
from contentfit.operators import improve as im
from contentfit.sources import fit_tables as ft


def files_read(df):
    df.collect()
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return scan.metrics().get("numFiles").get().value()


def test_a_band_skips_files(spark, tmp_path):
    rows = spark.range(2000).select("id", (F.col("id") % 1000 / 1000).alias("raw_score")).unionByName(
        spark.createDataFrame([(5000, None), (5001, float("nan")), (5002, 1.0), (5003, 0.65), (5004, 0.85)], "id long, raw_score double"))
    rows = rows.withColumn("verdict", fx.verdict("raw_score"))
    path = str(tmp_path / "fit")
    ft.write_fit(rows, path, files=2)
    assert ft.read_fit(spark, path).count() == 2005 and set(ft.read_fit(spark, path).columns) == set(rows.columns)
    for low, high in ((0.65, 0.85), (0.0, 0.0), (0.999, 1.0), (0.3, 0.3001)):
        got = sorted(r.id for r in ft.read_fit(spark, path, low, high).collect())
        assert got == sorted(r.id for r in rows.where(F.col("raw_score").between(low, high)).collect())
    whole = im.improvable(ft.read_fit(spark, path), "strict", score_col="raw_score")
    band = im.improvable(ft.read_fit(spark, path, 0.65, 0.85), "strict", score_col="raw_score")
    assert sorted(map(str, band.collect())) == sorted(map(str, whole.select(band.columns).collect()))
    assert files_read(band) <= 12 < files_read(whole)


def test_empty(spark, tmp_path):
    path = str(tmp_path / "none")
    ft.write_fit(spark.createDataFrame([(1, 0.5)], "id long, raw_score double"), path)
    assert ft.read_fit(spark, path, 0.9, 1.0).collect() == []
