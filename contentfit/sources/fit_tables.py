"""Fit tables stored by score range.

A fit table holds every pair, but a job looks at a narrow band of scores.  It is
written partitioned by twentieths of the score, so that a band is a partition
filter: files outside it are neither listed into the scan nor opened.  The rows of
a range are spread over several files by a hash of the row, as zero alone may
hold most of a table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = 20
RANGE = "score_range"
FILE_ROWS = 1_000_000


def score_range(score: str) -> Column:
    """Number of the score's twentieth; -1 for a null or NaN."""
    s = F.col(score)
    return F.when(s.isNull() | F.isnan(s), F.lit(-1)).otherwise(F.floor(s * PARTS)).cast("int")


def write_fit(df: DataFrame, path: str, score: str = "raw_score", files: int | None = None) -> None:
    """Write a fit table; ``files`` is the most files of a range."""
    files = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn(RANGE, score_range(score)).withColumn("_file", F.pmod(F.xxhash64(*df.columns), F.lit(files)))
    (ranged.repartition(RANGE, "_file").drop("_file").write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS)
     .partitionBy(RANGE).parquet(path))


def read_fit(spark: SparkSession, path: str, low: float | None = None, high: float | None = None,
             score: str = "raw_score") -> DataFrame:
    """A fit table, or its rows with ``low <= score <= high``, read from the
    ranges that can hold them."""
    df = spark.read.parquet(path)
    if low is not None:
        df = df.where((F.col(RANGE) >= math.floor(low * PARTS)) & (F.col(score) >= low))
    if high is not None:
        df = df.where((F.col(RANGE) <= math.floor(high * PARTS)) & (F.col(score) <= high))
    return df.drop(RANGE)
