"""Sources and sinks.

All reads are lazy parquet/CSV scans with an explicit column list, so column
pruning and filter pushdown reach the scan.  Nothing is collected.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contentfit import config
from contentfit.session import ensure_checkpoint_dir

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)

SEARCH_PERFORMANCE_SCHEMA = T.StructType([
    T.StructField("query", T.StringType()),
    T.StructField("clicks", T.LongType()),
    T.StructField("impressions", T.LongType()),
])

QUERY_INTENT_SCHEMA = T.StructType([
    T.StructField("query", T.StringType()),
    T.StructField("intent", T.StringType()),
])


class MissingColumnsError(KeyError):
    """A table lacks columns a job needs."""

    def __init__(self, missing: set[str], present: list[str]):
        self.missing = missing
        self.present = present
        super().__init__(f"missing columns {sorted(missing)}; present {present}")


def require_columns(df: DataFrame, need: Iterable[str]) -> DataFrame:
    """Superset allowed; raise naming the missing columns."""
    miss = set(need) - set(df.columns)
    if miss:
        raise MissingColumnsError(miss, list(df.columns))
    return df


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str,
               columns: Iterable[str] | None = None) -> DataFrame:
    """Scan one driver table; a missing path fails at analysis."""
    df = spark.read.parquet(table_path(sf_dir, name))
    if columns is not None:
        df = df.select(*columns)
    return df


def spread(df: DataFrame, bytes_per_task: int = config.SPREAD_BYTES, uneven_bytes: int = config.SPREAD_BYTES) -> DataFrame:
    """Deal a table's rows over all cores where its files don't.

    A Parquet row group is read by one task, so a table of a few row groups
    keeps a few cores busy with whatever is computed per row, however large they
    are.  A table of less than ``bytes_per_task`` a core is always dealt.  Of a
    larger one the rows of each task are counted, from the files' footers: where
    a task has more than ``uneven_bytes`` and twice its share, the table is dealt
    by row numbers; else it has enough splits and is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < cores * bytes_per_task:
        return df.repartition(cores)
    tasks = df.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n"))
    most, rows = tasks.agg(F.max("n"), F.sum("n")).first()
    if not rows or most * cores <= 2 * rows or size * most / rows <= uneven_bytes:
        return df
    # Hashed numbers need no sort in the reading task, as a deal in turn does.
    at = F.monotonically_increasing_id()
    return df.withColumn("_at", at).repartition(max(cores, math.ceil(size / bytes_per_task)), "_at").drop("_at")


def search_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 on driver data: one row per user as a search term, clicks = click
    events, impressions = view events.  Partial aggregation runs map-side,
    so a hot user costs one row per task before the shuffle."""
    ev = read_table(spark, sf_dir, "events", ["user_id", "event_type"])
    return (ev.groupBy("user_id")
              .agg(F.count_if(F.col("event_type") == "click").alias("clicks"),
                   F.count_if(F.col("event_type") == "view").alias("impressions"))
              .select(F.concat(F.lit("q"), F.col("user_id").cast("string")).alias("query"),
                      "clicks", "impressions"))


def read_search_performance(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """S1 for an exported search-performance file (CSV, parquet or xlsx)."""
    if fmt == "xlsx":
        from contentfit.sources.compat import TO_OURS
        from contentfit.sources.excel import read_excel
        df = read_excel(spark, path, SEARCH_PERFORMANCE_SCHEMA, names_of=TO_OURS)
    elif fmt == "csv":
        df = read_csv(spark, path, SEARCH_PERFORMANCE_SCHEMA)
    else:
        df = spark.read.parquet(path)
    return require_columns(df, ["query", "clicks", "impressions"])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             need: Iterable[str] | None = None, multi_line: bool = False) -> DataFrame:
    """S2 (+S9): UTF-8 CSV with header.  ``multi_line`` allows line breaks in
    quoted fields, for which Spark reads each file in one task; without it files
    are split."""
    r = (spark.read.option("header", True).option("multiLine", multi_line)
         .option("escape", '"').option("encoding", "UTF-8"))
    if schema is not None:
        r = r.schema(schema)
    df = r.csv(path)
    if need is not None:
        require_columns(df, need)
    return df


def write_table(df: DataFrame, path: str, fmt: str = "parquet",
                partition_by: Iterable[str] | None = None, mode: str = "overwrite") -> None:
    """Write a result (parquet by default; CSV with header)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).option("escape", '"').csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder that the session names
    in ``spark.checkpoint.dir`` and read it back."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    write_table(df, path)
    return df.sparkSession.read.parquet(path)
