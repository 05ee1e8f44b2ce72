"""Labelled rows for fitting: a bounded sample that leaves out a held-out fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentfit.llm.common import fold_of

FOLDS = 5


def held_out(key: Column, folds: int = FOLDS, fold: int = 0) -> Column:
    """Whether a key is in the held-out fold; false for a null key."""
    return F.coalesce(fold_of(key, folds) == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, max_rows: int, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``id, label, order, text`` of at most ``max_rows`` labelled documents
    outside the held-out fold, picked by a hash of the id.

    The sample is drawn from ids and labels alone, so texts that aren't in it
    are never moved, and it is bounded, so it is broadcast.  An id labelled
    more than once takes its largest label.
    """
    ids = (labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("label"))
           .where("__id is not null and label is not null").where(~held_out(F.col("__id")))
           .groupBy("__id").agg(F.max("label").alias("label"))
           .withColumn("order", F.xxhash64("__id", F.lit(17))).orderBy("order", "__id").limit(max_rows))
    return docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(
        F.broadcast(ids), "__id").select(F.col("__id").alias("id"), "label", "order", "text")
