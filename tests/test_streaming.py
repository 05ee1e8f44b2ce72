"""Streaming pages through foreachBatch gives the batch result."""

from pyspark.sql import functions as F

from contentfit.streaming import score_batch, start_section_scoring

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    queries = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", F.col("text").alias("qtext"))
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    q = start_section_scoring(spark, SF, queries, out, ckpt, min_score=0.3, glob="pages.parquet")
    q.awaitTermination(300)
    got = sorted(tuple(r) for r in spark.read.parquet(out).drop("batch_id").collect())
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    exp = sorted(tuple(r) for r in score_batch(pages, queries, "item_id", "qtext", 0.3).collect())
    assert got == exp and len(got) > 0
