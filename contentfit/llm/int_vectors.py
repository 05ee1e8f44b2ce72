"""Integer vectors: scaled components, and exact products on float64 BLAS.

``scaled_rows`` turns a vector column into integers and writes them, with a
number for each row that is fixed from then on.  Rows whose vector is null,
empty or holds a null or a number that isn't finite are left out.  All vectors
have the width of the smallest id's; rows of another width are left out too.

``exact_products`` is a limb-split GEMM: integers are cut into limbs so narrow
that a float64 product of two limb matrices stays below 2^53, where float64
counts exactly; the products are put together in int64.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentfit.llm.common import list_array, write_stage

_NULLS_LAST = np.iinfo(np.int64).max


def limit(width: int) -> int:
    """The largest component whose squared distances and products, summed over
    four vectors of ``width``, stay within 64 bits."""
    return min((1 << 31) - 1, isqrt((1 << 60) // max(1, width)) // 2)


def limb_bits(width: int) -> int:
    """Bits of a limb: ``width`` products of two limbs sum to at most 2^53."""
    return (53 - max(0, width - 1).bit_length()) // 2


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """``x`` as float64 limbs, lowest first: ``sum(limb << bits * i)``.  All but
    the last are in ``[0, 2^bits)``; the last has the sign."""
    out, most = [], int(np.abs(x).max(initial=0))
    while most >= 1 << bits:
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x, most = x >> bits, most >> bits
        # The floor shift of a negative number may leave one more in size.
        most += 1
    return [*out, x.astype(np.float64)]


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of int64 matrices, exact in int64."""
    bits = limb_bits(a.shape[1])
    out = np.zeros((len(a), len(b)), dtype=np.int64)
    right = limbs(b, bits)
    for i, x in enumerate(limbs(a, bits)):
        for j, y in enumerate(right):
            out += (x @ y.T).astype(np.int64) << bits * (i + j)
    return out


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(index, squared distance)`` of each row's nearest entry, the first of
    equally near ones."""
    away = (book * book).sum(axis=1) - 2 * exact_products(x, book)
    at = away.argmin(axis=1)
    return at, (x * x).sum(axis=1) + away[np.arange(len(x)), at]


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column of ``width`` integers a row as an int64 matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def ids_of(column: pa.Array) -> np.ndarray:
    """Ids for sorting; a null comes last."""
    return column.fill_null(_NULLS_LAST).to_numpy(zero_copy_only=False)


def ids_column(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == _NULLS_LAST)


def _scaled(vectors: pa.Array, scale: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Row numbers of whole vectors and their integers."""
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    # Parts of null lists aren't in the flattened values; a null component becomes a NaN.
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
    whole = np.flatnonzero((sizes > 0) & (bad[ends] == bad[ends - sizes]))
    rows = [np.floor(scale * flat[ends[i] - sizes[i]:ends[i]]) for i in whole]
    for row in rows:
        if np.abs(row).max() > limit(len(row)):
            raise ValueError(f"a component beyond {limit(len(row)) / scale:g} doesn't fit exact 64-bit sums")
    return whole, [row.astype(np.int32) for row in rows]


def scaled_rows(df: DataFrame, id_col: str, vec_col: str, label: Column, scale: int) -> tuple[DataFrame, int]:
    """``(row, id, label, v)`` and the width; label is text.  A component beyond
    ``limit`` raises an error."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, rows = _scaled(batch.column(2), scale)
            at = pa.array(whole, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), list_array(rows, pa.int32())],
                                             names=["id", "label", "v"])
    picked = df.select(F.col(id_col).cast("long").alias("id"), label.cast("string").alias("label"),
                       F.col(vec_col).cast("array<double>").alias("v"))
    rows = write_stage(picked.mapInArrow(run, "id long, label string, v array<int>")
                       .withColumn("row", F.monotonically_increasing_id()), "int-vectors")
    first = rows.orderBy(F.asc_nulls_last("id"), "v").select(F.size("v").alias("width")).first()
    width = first["width"] if first else 0
    return rows.where(F.size("v") == width), width
