"""Report over improvement tables.

Rows of both improvers become one long table with a ``mode`` column
(intent / query); the summary is a single global aggregate with conditional
aggregates per mode (combined map-side, one output row per mode, zeros when a
mode has no rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentfit import config
from contentfit.functions import text as tx

MODES = ("intent", "query")


def report_rows(improved: DataFrame, mode: str, context_col: str, keep_cols=(),
                delta_min: float = config.DELTA_MIN) -> DataFrame:
    """Rename to report columns, keep rows whose change is known
    and above ``delta_min``.  Text columns that hold numbers are parsed with
    C6 (numeric columns pass through)."""
    def num(c):
        dt = dict(improved.dtypes)[c]
        return tx.parse_number(c, trim_first=True) if dt == "string" else F.col(c).cast("double")
    out = improved.select(*keep_cols, F.lit(mode).alias("mode"), F.col("section").alias("html"),
                          F.col(context_col).alias("context"), "old_text", "new_text",
                          num("old_score").alias("old_score"), num("new_score").alias("new_score"),
                          num("pct_change").alias("delta"))
    return out.where(F.col("delta").isNotNull() & (F.col("delta") > F.lit(delta_min)))


def report_summary(rows: DataFrame, delta_min: float = config.DELTA_MIN, digits: int = 6) -> DataFrame:
    """A1-A4 per mode: rows, improved rows, mean new score and mean change
    (nulls as 0, empty -> 0)."""
    aggs = []
    for m in MODES:
        inm = F.col("mode") == m
        aggs += [F.count_if(inm).alias(f"{m}_n"),
                 F.count_if(inm & (F.col("delta") > delta_min)).alias(f"{m}_imp"),
                 F.avg(F.when(inm, F.coalesce("new_score", F.lit(0.0)))).alias(f"{m}_new"),
                 F.avg(F.when(inm, F.coalesce("delta", F.lit(0.0)))).alias(f"{m}_delta")]
    g = rows.agg(*aggs)
    per_mode = F.array(*[F.struct(F.lit(m).alias("mode"), F.col(f"{m}_n").alias("n_rows"),
                                  F.col(f"{m}_imp").alias("n_improved"),
                                  F.round(F.coalesce(F.col(f"{m}_new"), F.lit(0.0)), digits).alias("avg_new_score"),
                                  F.round(F.coalesce(F.col(f"{m}_delta"), F.lit(0.0)), digits).alias("avg_delta"))
                         for m in MODES])
    return g.select(F.explode(per_mode).alias("s")).select("s.*")


def report_formatted(rows: DataFrame) -> DataFrame:
    """Display text for scores (3 decimals) and change (+, 2
    decimals, %)."""
    return rows.select("*", tx.fmt_num("old_score", 3).alias("old_score_txt"),
                       tx.fmt_num("new_score", 3).alias("new_score_txt"),
                       tx.fmt_pct("delta").alias("delta_txt"))


def summary_formatted(summary: DataFrame) -> DataFrame:
    """C11: summary figures as text."""
    return summary.select("mode", "n_rows", "n_improved",
                          tx.fmt_num("avg_new_score", 3).alias("avg_new_score_txt"),
                          F.concat(tx.fmt_num("avg_delta", 2), F.lit("%")).alias("avg_delta_txt"))
