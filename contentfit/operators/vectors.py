"""Text vectors and cosine similarity (V1-V3).

Default vectors are lexical term frequencies over the tokens
``[\\p{L}\\p{N}]+`` of the lower-cased text.  A vector is computed inside the
row, with higher-order functions, as a term-sorted array of
``struct<term, tf>`` plus its L2 norm: no explode, no shuffle.  The dot product
of two such vectors merges them (sort of the concatenation, then adjacent
equal terms), so its cost is O((a+b) log(a+b)) and never a nested loop.

Dense vectors are a supplied ``array<float>`` column; a user model can be
plugged in through :func:`embedder_udf` (Arrow-batched iterator pandas UDF).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values ------------------------------------------------------------
TOKEN_RE = r"[\p{L}\p{N}]+"

ENTRY_TYPE = T.ArrayType(T.StructType([
    T.StructField("term", T.StringType()),
    T.StructField("tf", T.LongType()),
]))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text) -> Column:
    """Word tokens of the lower-cased text (null text -> no tokens)."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit(TOKEN_RE), F.lit(0))


def let(x: Column, body) -> Column:
    """Evaluate ``x`` once and hand it to ``body`` as a lambda variable."""
    return F.transform(F.array(x), body).getItem(0)


def entries_from_sorted(srt) -> Column:
    """Run-length encode a sorted token array into term-sorted
    ``array<struct<term string, tf bigint>>``.

    Each intermediate array is evaluated once: run marks feed the run starts
    only, the starts are bound once, and the distinct terms of a sorted array
    are its runs in order.  Nothing inside a lambda re-evaluates a computed
    array.  ``srt`` should be a column or a lambda variable.
    """
    s = _c(srt)
    n = F.size(s)
    prev = F.concat(F.array(F.lit(None).cast("string")), s)
    marks = F.zip_with(s, prev, lambda x, p: x.isNotNull() & (p.isNull() | (x != p)))
    starts = F.filter(F.transform(marks, lambda m, i: F.when(m, i).otherwise(F.lit(-1))), lambda v: v >= 0)

    def from_starts(st):
        ends = F.concat(F.slice(st, 2, F.greatest(n, F.lit(1))), F.array(n))
        counts = F.zip_with(st, ends, lambda a, b: (b - a).cast("long"))
        return F.zip_with(F.array_distinct(s), counts, lambda t, c: F.struct(t.alias("term"), c.alias("tf")))
    return F.when(n == 0, F.array().cast(ENTRY_TYPE)).otherwise(let(starts, from_starts))


def term_entries(text) -> Column:
    """Sparse term-frequency vector of a text (row-local, O(n log n))."""
    return let(F.sort_array(tokens(text)), entries_from_sorted)


def with_lexical_vector(df, text: str, out: str):
    """Add ``out`` = ``struct<entries, norm>`` for ``text``.  Sorted tokens
    and entries are materialised in their own projections, so each is
    computed once and read as a column."""
    srt, ent = f"_{out}_srt", f"_{out}_ent"
    df = df.withColumn(srt, F.sort_array(tokens(F.col(text))))
    df = df.withColumn(ent, entries_from_sorted(F.col(srt)))
    return (df.withColumn(out, F.struct(F.col(ent).alias("entries"), entries_norm(F.col(ent)).alias("norm")))
              .drop(srt, ent))


def entries_norm(entries) -> Column:
    """L2 norm of a term vector."""
    ss = F.aggregate(_c(entries), F.lit(0).cast("long"), lambda a, e: a + e["tf"] * e["tf"])
    return F.sqrt(ss.cast("double"))


def lexical_vector(text) -> Column:
    """``struct<entries, norm>`` for a text column, each step evaluated once
    (usable inside other lambdas, where no extra projection is possible)."""
    return let(F.sort_array(tokens(text)), lambda s: let(
        entries_from_sorted(s), lambda e: F.struct(e.alias("entries"), entries_norm(e).alias("norm"))))


def entries_dot(a, b, kind: str = "bigint") -> Column:
    """Dot product of two term vectors by merging them: after sorting the
    concatenation, a shared term sits in two adjacent slots (terms are
    distinct within each side).  ``kind`` is the weights' type."""
    zero = F.lit(0).cast(kind)
    m = F.sort_array(F.concat(_c(a), _c(b)))
    prods = F.zip_with(m, F.slice(m, 2, F.greatest(F.size(m), F.lit(1))),
                       lambda x, y: F.when(x["term"] == y["term"], x["tf"] * y["tf"]).otherwise(zero))
    return F.aggregate(prods, zero, lambda acc, p: acc + F.coalesce(p, zero))


def cosine_from(dot, norm_a, norm_b) -> Column:
    """V3: cosine with the empty guard (0.0 when either side has no terms)."""
    d, na, nb = _c(dot), _c(norm_a), _c(norm_b)
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(d.cast("double") / (na * nb))


def lexical_cosine(va, vb) -> Column:
    """Cosine of two ``lexical_vector`` structs (each bound once)."""
    return let(F.struct(_c(va).alias("a"), _c(vb).alias("b")), lambda v: cosine_from(
        entries_dot(v["a"]["entries"], v["b"]["entries"]), v["a"]["norm"], v["b"]["norm"]))


def dense_dot(a, b) -> Column:
    """Dot product of two numeric arrays, summed in double."""
    prods = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0), lambda acc, p: acc + p)


def dense_norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def dense_cosine(a, b, guard: bool = False) -> Column:
    """V2 (unguarded) / V3 (``guard=True``: 0.0 for a zero vector)."""
    num = dense_dot(a, b)
    den = dense_norm(a) * dense_norm(b)
    if guard:
        return F.when(den == 0, F.lit(0.0)).otherwise(num / den)
    return num / den


def embedder_udf(encode: Callable[[list[str]], list[list[float]]], batch_size: int = 256):
    """V1 with a user model: an iterator pandas UDF so the model is loaded
    once per task and fed Arrow batches.  ``encode`` maps a list of texts to
    a list of vectors (normalised or not; cosine normalises)."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def _embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts = s.fillna("").tolist()
            out: list = []
            for i in range(0, len(texts), batch_size):
                out.extend(encode(texts[i:i + batch_size]))
            yield pd.Series([list(map(float, v)) for v in out])

    return _embed


def hashed_vector(text, num_features: int = 1 << 18) -> Column:
    """V1 alternative: term frequencies hashed into ``num_features`` buckets
    (like ``ml.feature.HashingTF``) in the same sorted-entries shape, so the
    cosine code is shared.  Collisions merge terms."""
    hashed = F.transform(tokens(text), lambda t: F.pmod(F.xxhash64(t), F.lit(num_features)).cast("string"))
    return let(F.sort_array(hashed), lambda s: let(
        entries_from_sorted(s), lambda e: F.struct(e.alias("entries"), entries_norm(e).alias("norm"))))
