"""Structured Streaming: score pages as they arrive.

Extraction and scoring against a bounded query table are stateless per page,
so a stream of crawled pages reuses the batch operators unchanged through
``foreachBatch``.  Each micro-batch writes its own output folder
(``batch_id=N``) with overwrite, so a retried batch replaces, never
duplicates, its rows; the checkpoint location records progress.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentfit import config
from contentfit.operators import fit as fx
from contentfit.operators import sections as sx

PAGES_SCHEMA = "page_id long, url string, html string"


def pages_stream(spark: SparkSession, source_dir: str, glob: str | None = None,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """A streaming DataFrame of pages from parquet files landing in
    ``source_dir`` (explicit schema: file streams never infer)."""
    r = spark.readStream.schema(PAGES_SCHEMA)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(source_dir)


def score_batch(pages: DataFrame, queries: DataFrame, query_key: str, query_text: str,
                min_score: float = config.VERDICT_CUT) -> DataFrame:
    """One micro-batch: sections of the new pages x the queries, pairs at or
    above ``min_score`` with their verdict."""
    secs = sx.page_sections(pages).drop("url")
    m = fx.lexical_match(secs, ["page_id", "section", "ordinal"], "text", queries, [query_key], query_text,
                         min_score)
    return m.withColumn("verdict", fx.verdict(F.col("raw_score"))).drop("raw_score")


def start_section_scoring(spark: SparkSession, source_dir: str, queries: DataFrame, out_dir: str,
                          checkpoint_dir: str, query_key: str = "item_id", query_text: str = "qtext",
                          min_score: float = config.VERDICT_CUT, glob: str | None = None,
                          available_now: bool = True):
    """Start the streaming job; returns the ``StreamingQuery``."""
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        out = score_batch(batch, queries, query_key, query_text, min_score)
        out.write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/batch_id={batch_id}")

    w = (pages_stream(spark, source_dir, glob).writeStream.foreachBatch(write_batch)
         .option("checkpointLocation", checkpoint_dir))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
