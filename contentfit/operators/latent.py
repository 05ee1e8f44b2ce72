"""Dense text vectors trained on a corpus (V1): a distributed randomised SVD of
the weighted term matrix, into which texts are folded.

Rows of the matrix are texts (of unit length), columns are terms.  The sketch
starts from random signs, a hash of each term, and goes through power
iterations ``Y <- A' (A Y)``, each two joins with an aggregate of as many sums
as the sketch has columns.  Between them the columns are made orthonormal from
their Gram matrix, which tasks sum up and the driver, which gets that small
matrix alone, factorises.  The model is a table ``(term, v)``; a text's
vector is the weighted sum of its terms' rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentfit import config
from contentfit.operators.fit import fits_broadcast
from contentfit.operators.match import postings
from contentfit.operators.weighting import weighted
from contentfit.sources.tables import stage_table

DIMENSIONS, MORE, ITERATIONS = 32, 8, 3
MOST_COLUMNS = 64  # a hash has a sign for each


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _gram(rows: DataFrame, width: int) -> np.ndarray:
    """``Y' Y`` of a table ``(…, y)``: one small matrix a task, summed."""
    def run(batches):
        total = np.zeros((width, width))
        for batch in batches:
            y = _matrix(batch.column(0), width)
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], names=["at", "x"])
    found = rows.select("y").mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(width * width)
    for r in found:
        out[r["at"]] = r["x"]
    return out.reshape(width, width)


def _times(rows: DataFrame, key: str, m: np.ndarray, name: str) -> DataFrame:
    """``(key, y)`` with ``y`` times a small matrix, written."""
    kind = dict(rows.dtypes)[key]

    def run(batches):
        for batch in batches:
            y = _matrix(batch.column(1), m.shape[0]) @ m
            offsets = pa.array(np.arange(0, y.size + 1, m.shape[1]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(y.ravel()))], names=[key, "y"])
    return stage_table(rows.select(key, "y").mapInArrow(run, f"{key} {kind}, y array<double>"), name)


def _orthonormal(rows: DataFrame, key: str, width: int) -> DataFrame:
    """Columns made orthonormal; those that add nothing become zero."""
    values, vectors = np.linalg.eigh(_gram(rows, width))
    scale = np.where(values > values.max(initial=0) * 1e-12, 1 / np.sqrt(np.maximum(values, 1e-300)), 0.0)
    return _times(rows, key, vectors * scale, "orthonormal")


def _product(entries: DataFrame, by: str, to: str, y: DataFrame, width: int) -> DataFrame:
    """``(to, y)``: the matrix, or its transpose, times ``y``, whose rows are ``by``."""
    y = F.broadcast(y) if fits_broadcast(y, config.BROADCAST_MAX_ROWS) else y
    sums = [F.sum(F.col("w") * F.get(F.col("y"), F.lit(j))) for j in range(width)]
    return stage_table(entries.join(y, by).groupBy(to).agg(F.array(*sums).alias("y")), "product")


def fit_latent(texts: DataFrame, text: str, weights: DataFrame, k: int = DIMENSIONS, more: int = MORE,
               iterations: int = ITERATIONS) -> tuple[DataFrame, np.ndarray]:
    """The model ``(term, v)`` of ``k`` dimensions and the singular values.

    ``weights`` is a model of :func:`weighting.fit_idf`.  Distinct texts are
    rows; a corpus of a lower rank gives zeros in the dimensions it lacks.
    """
    width = min(k + more, MOST_COLUMNS)
    if not 0 < k <= width:
        raise ValueError(f"1 to {MOST_COLUMNS} dimensions")
    entries = weighted(postings(texts.select(text).distinct(), [], text, "l"), [], "l", weights)
    entries = stage_table(entries.select(F.col("lh").alias("row"), "term", (F.col("ltf") / F.col("lnorm")).alias("w")), "term-matrix")
    sign = [F.when(F.expr(f"(shiftrightunsigned(h, {j}) & 1) = 1"), F.lit(1.0)).otherwise(F.lit(-1.0)) for j in range(width)]
    y = entries.select("term").distinct().withColumn("h", F.xxhash64("term", F.lit(7))).select("term", F.array(*sign).alias("y"))
    y = _orthonormal(stage_table(y, "signs"), "term", width)
    for _ in range(iterations):
        y = _orthonormal(_product(entries, "row", "term", _product(entries, "term", "row", y, width), width), "term", width)
    values, vectors = np.linalg.eigh(_gram(_product(entries, "term", "row", y, width), width))
    first = np.argsort(-values)[:k]
    model = _times(y, "term", vectors[:, first], "latent").withColumnRenamed("y", "v")
    return model, np.sqrt(np.maximum(values[first], 0))


def fold(df: DataFrame, keys: Sequence[str], text: str, weights: DataFrame, model: DataFrame, name: str = "v") -> DataFrame:
    """``df`` with its texts' vectors, of the model's dimensions: the sum of
    their terms' rows by weight.  A text without known terms has zeros."""
    k = model.select(F.size("v")).first()
    if k is None:
        raise ValueError("the model has no terms")
    entries = weighted(postings(df.select(text).distinct(), [], text, "l"), [], "l", weights)
    terms = F.broadcast(model) if fits_broadcast(model, config.BROADCAST_MAX_ROWS) else model
    sums = [F.sum(F.col("ltf") / F.col("lnorm") * F.get(F.col("v"), F.lit(j))) for j in range(k[0])]
    vectors = entries.join(terms, "term").groupBy(F.col("lh").alias("_of")).agg(F.array(*sums).alias("_v"))
    zeros = F.array_repeat(F.lit(0.0), k[0])
    out = df.withColumn("_h", F.xxhash64(text)).join(vectors, F.col("_h") == F.col("_of"), "left")
    return out.select(*keys, text, F.coalesce("_v", zeros).alias(name))
