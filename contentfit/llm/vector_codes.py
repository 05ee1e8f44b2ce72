"""Vector code compression: product quantisation in exact integers.

Components are scaled to integers and vectors cut into equal parts.  Each part
position has a codebook, fitted by a few rounds of integer k-means that begin
with the smallest ids' vectors.  A task finds its rows' nearest entries with
the limb-split exact GEMM (``int_vectors.exact_products``) and the first
argmin, and adds its parts up by entry; what is shuffled and sent to the driver
in a round is one row per task and entry, and one per entry, of a fixed size.
No result depends on how rows are dealt over tasks.

Defined cases: rows whose vector is null, empty, of another width than the
smallest id's, or holds a null or non-finite component are dropped; a null id
comes last among ids; ties in distance go to the lower index; repeated rows
are rows of their own (in the codebooks' first entries, too); with fewer rows
than entries the codebooks are that small; null labels are one label; an empty
table gives no rows; a width that the parts don't divide, and a component
beyond ``int_vectors.limit``, raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentfit.llm.common import list_array, write_stage
from contentfit.llm.int_vectors import matrix, nearest, scaled_rows

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Rows whose products with a codebook are made at once.
SLICE = 8192


def first_codebooks(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """``(part, entry, component)`` from the smallest ids' vectors."""
    smallest = rows.orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()  # at most ``entries`` rows
    v = np.array([r["v"] for r in smallest], dtype=np.int64)
    return np.ascontiguousarray(v.reshape(len(v), parts, -1).transpose(1, 0, 2))


def _assigned(batches: Iterator[pa.RecordBatch], column: int, books: np.ndarray):
    """``(batch, part matrices, entries, distances)``, some rows at a time."""
    parts, _, width = books.shape
    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE):
            some = batch.slice(lo, SLICE)
            x = matrix(some.column(column), parts * width).reshape(-1, parts, width)
            found = [nearest(x[:, p], books[p]) for p in range(parts)]
            yield some, x, [f[0] for f in found], [f[1] for f in found]


def _sums(rows: DataFrame, books: np.ndarray) -> list:
    """Per part and entry: how many parts it has, and their sum."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((parts, entries), dtype=np.int64)
        total = np.zeros(books.shape, dtype=np.int64)
        for _, x, at, _ in _assigned(batches, 0, books):
            for p in range(parts):
                order = np.argsort(at[p], kind="stable")
                used, first = np.unique(at[p][order], return_index=True)
                total[p, used] += np.add.reduceat(x[order, p], first)
                n[p] += np.bincount(at[p], minlength=entries)
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]),
             list_array(list(total[part, entry]), pa.int64())], names=["part", "entry", "n", "total"])
    partial = rows.select("v").mapInArrow(run, "part int, entry int, n long, total array<long>")
    return partial.groupBy("part", "entry").agg(
        F.sum("n").alias("n"), F.array(*(F.sum(F.col("total")[i]) for i in range(width))).alias("total")).collect()


def fit_codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks ``(part, entry, component)`` of integer vectors ``rows(id, v)``,
    which has rows.  An entry that no part is nearest to stays as it was."""
    books = first_codebooks(rows, parts, entries)
    for _ in range(rounds):
        for r in _sums(rows, books):
            books[r["part"], r["entry"]] = np.array(r["total"], dtype=np.int64) // r["n"]
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``id, label, code, error``: two hex digits for each part's entry, and the
    squared distances added up."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, _, at, away in _assigned(batches, 2, books):
            raw = np.stack(at, axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [some.column(0), some.column(1), pa.array([r.tobytes().hex() for r in raw], pa.string()),
                 pa.array(np.sum(away, axis=0, dtype=np.int64))], names=["id", "label", "code", "error"])
    return rows.select("id", "label", "v").mapInArrow(run, "id long, label string, code string, error long")


def decode(code: str, books: np.ndarray) -> np.ndarray:
    """The integer vector that a code stands for."""
    return np.concatenate([books[p, entry] for p, entry in enumerate(bytes.fromhex(code))])


def codebooks_digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                     scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row per kept vector: ``vec_id, code, error, label_error`` (the error
    summed over equal labels) and ``codebooks_sha256``.  ``entries`` is at most
    256, so that two hex digits hold an index."""
    if not 0 < entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    rows, width = scaled_rows(df, id_col, vec_col, F.col(label_col), scale)
    if width % parts:
        raise ValueError(f"{parts} equal parts of {width} components")
    if not width:
        return df.sparkSession.createDataFrame(
            [], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    books = fit_codebooks(rows, parts, entries, rounds)
    coded = write_stage(encode(rows, books), "codes")
    # One row per label; a label of many rows is summed in parts, and adaptive execution splits it in the join.
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
