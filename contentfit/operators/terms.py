"""Priority search terms.

Top-k is ``orderBy(...).limit(k)``, which plans as ``TakeOrderedAndProject``:
each task keeps its own k best rows and only those reach the final merge, so
no full sort or shuffle of the table happens.  Keep-first dedupe is a
``min_by`` aggregate (algebraic, combined map-side) rather than a window, so
a hot key never lands whole in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentfit import config


def _ranked(df: DataFrame, order_key, out_name: str) -> DataFrame:
    """Number the rows of a frame known to hold at most 2k rows by
    ``order_key`` (a struct): sort them inside one bounded array, then
    ``posexplode``.  Used only after a ``limit``."""
    rows = F.struct(*[F.col(c) for c in df.columns])
    arr = df.agg(F.array_sort(F.collect_list(F.struct(order_key.alias("_k"), rows.alias("_r")))).alias("_a"))
    out = arr.select(F.posexplode("_a").alias("_pos", "_e"))
    return out.select("_e._r.*", (F.col("_pos") + 1).cast("int").alias(out_name))


def top_k(perf: DataFrame, metric: str, k: int = config.TOP_K) -> DataFrame:
    """The k rows with the largest ``metric`` (nulls last, ties by
    query, D1), with their 1-based ``rank``.  F1 drops null queries."""
    order = [F.col(metric).desc_nulls_last(), F.col("query").asc()]
    top = perf.where(F.col("query").isNotNull()).orderBy(*order).limit(k)
    key = F.struct(F.col(metric).isNull().alias("_null"), (-F.col(metric)).alias("_neg"), F.col("query"))
    return _ranked(top, key, "rank")


def priority_terms(perf: DataFrame, k: int = config.TOP_K) -> DataFrame:
    """U1+U2+A6: top k by clicks, then top k by impressions, stacked in that
    order, duplicates dropped keeping the first; ``position`` is the order
    of the final list (at most 2k rows)."""
    stacked = (top_k(perf, "clicks", k).withColumn("source", F.lit("clicks")).withColumn("src_ord", F.lit(0))
               .unionByName(top_k(perf, "impressions", k).withColumn("source", F.lit("impressions"))
                            .withColumn("src_ord", F.lit(1))))
    first = (stacked.groupBy("query")
                    .agg(F.min_by(F.struct("source", "rank", "clicks", "impressions", "src_ord"),
                                  F.struct("src_ord", "rank")).alias("f"))
                    .select("query", "f.*"))
    return _ranked(first, F.struct("src_ord", "rank"), "position").drop("src_ord")


def distinct_first_seen(df: DataFrame, value: str, order_cols: list[str]) -> DataFrame:
    """A5: distinct values with the order key of their first appearance and
    their count.  Order is kept as columns (a DataFrame has no order)."""
    first = F.min(F.struct(*[F.col(c) for c in order_cols])).alias("_first")
    return (df.groupBy(value).agg(first, F.count(F.lit(1)).alias("n"))
              .select(value, *[F.col(f"_first.{c}").alias(f"first_{c}") for c in order_cols], "n"))
