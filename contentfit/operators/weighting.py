"""Term weights from a corpus (V1): document frequencies as a model table, and
weighted vectors through the same joins as raw counts.

A term's weight is ``ln((1 + n) / (1 + df)) + 1`` for ``n`` texts of which
``df`` hold it; a term the corpus lacks has that of ``df = 0``.  A model is a
table ``(term, df)`` with a row for the number of texts (term null), saved under
a version, so that scores can be made again with the weights they had.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contentfit import config
from contentfit.operators.fit import fits_broadcast
from contentfit.operators.match import dealt, match_postings, of_terms, postings
from contentfit.operators.vectors import tokens
from contentfit.sources.tables import stage_table

MODEL = "term string, df long"


def fit_idf(texts: DataFrame, text: str) -> DataFrame:
    """Document frequencies of a corpus; a text without terms counts as one.
    Distinct terms of a text are found in the row; counts combine map-side."""
    terms = texts.select(F.explode_outer(F.array_distinct(tokens(F.col(text)))).alias("term")).where(F.col("term").isNotNull())
    counts = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    size = texts.agg(F.count(F.lit(1)).alias("df")).select(F.lit(None).cast("string").alias("term"), "df")
    return counts.unionByName(size)


def save_model(model: DataFrame, path: str) -> int:
    """Write a model as the next version under ``path``; returns the version."""
    spark = model.sparkSession
    try:
        version = (spark.read.parquet(path).agg(F.max("version")).first()[0] or 0) + 1
    except AnalysisException:  # the first
        version = 1
    model.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(path)
    return version


def load_model(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of a model, the last by default."""
    versions = spark.read.schema(f"{MODEL}, version int").parquet(path)
    if version is None:
        version = versions.agg(F.max("version")).first()[0]
    model = versions.where(F.col("version") == version).drop("version")
    if model.isEmpty():
        raise ValueError(f"no version {version} under {path}")
    return model


def idf(df: Column, n: Column) -> Column:
    return F.log((1 + n) / (1 + F.coalesce(df, F.lit(0)))) + 1


def weighted(entries: DataFrame, keys: Sequence[str], side: str, model: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """Postings with weights in place of counts, and their rows' norms; with
    ``other`` postings, those of their terms alone (norms are of all terms)."""
    n = model.where("term is null").select("df").first()["df"]  # one row
    terms = model.where("term is not null")
    terms = F.broadcast(terms) if fits_broadcast(terms, config.BROADCAST_MAX_ROWS) else terms
    known = entries.join(terms, "term", "left")
    known = known.withColumn(f"{side}tf", F.col(f"{side}tf") * idf(F.col("df"), F.lit(n))).drop("df")
    # Repeated rows have each entry as often; their norm is that of one.  Rows dealt by keys and text serve both windows.
    known = dealt(known, [*keys, f"{side}h"], entries.count())
    row = Window.partitionBy(*keys, f"{side}h")
    times = F.count(F.lit(1)).over(Window.partitionBy(*keys, f"{side}h", "term"))
    norm = F.sqrt(F.sum(F.col(f"{side}tf") * F.col(f"{side}tf") / F.col("_times")).over(row))
    known = known.withColumn("_times", times).withColumn(f"{side}norm", F.round(norm, 12)).drop("_times")
    return stage_table(of_terms(known, other), f"weighted-{side}")


def idf_match(left: DataFrame, left_keys: Sequence[str], left_text: str, right: DataFrame, right_keys: Sequence[str],
              right_text: str, model: DataFrame, min_score: float, digits: int = 6,
              max_rows: int = config.BROADCAST_MAX_ROWS) -> DataFrame:
    """J7 on weighted vectors: pairs with a cosine of ``min_score`` or more, as
    left keys, right keys, ``score`` (rounded) and ``raw_score``."""
    lk, rk = list(left_keys), list(right_keys)
    lp, rp = postings(left, lk, left_text, "l"), postings(right, rk, right_text, "r")
    lp, rp = weighted(lp, lk, "l", model, rp), weighted(rp, rk, "r", model)
    return match_postings(lp, lk, rp, rk, min_score, digits, max_rows)
