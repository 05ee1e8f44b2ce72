"""Sharding by global byte-size prefix sums.

Rows are ordered by id (null ids first), then size, text checksum and a number
fixed when the sizes are written, so the order is total and a key that a third
of the rows share is split like any other.  The ordered rows are dealt into
range *blocks*; each block's total gives, by a prefix sum over the blocks alone,
the bytes and rows before it, and a running sum inside the block does the rest.
A row goes to the shard in which its middle byte falls when the corpus is cut
at equal targets, so a shard is a contiguous run of the order and each cut is at
the row edge nearest to its target: a shard's bytes differ from the target by
no more than its largest row at either end.

Only ids, sizes and checksums are moved to number rows; texts are read once for
them, and once more, moved by shard, where shards are written as files.

Defined cases: a null text has no bytes; a null id is an id like any other;
repeated rows each have a place of their own; a text longer than a target
fills its shard alone and may leave neighbours empty; ties in size and
checksum are numbered; an empty table gives no rows and no files; extra columns
of any name are kept by ``write_shards``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contentfit.llm.common import free_name, write_stage

SHARDS = 40
ROW_BYTES = 16  # what a row takes beside its text
BLOCK_ROWS = 500_000
_ORDER = ("has_id", "id", "size", "crc", "row")


def _measured(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """The columns of a row's order, and its size."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.col(id_col).cast("long")
    return [key.isNotNull().alias("has_id"), F.coalesce(key, F.lit(0)).cast("long").alias("id"),
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("crc"),
            F.monotonically_increasing_id().alias("row")]


def _place(rows: DataFrame, shards: int, block_rows: int) -> DataFrame:
    """``_ORDER`` rows with ``shard`` and ``slot``.  ``rows`` is a written table."""
    n = rows.count()
    blocks = write_stage(rows.select(*_ORDER).repartitionByRange(max(1, -(-n // block_rows)), *_ORDER)
                         .withColumn("block", F.spark_partition_id()), "blocks")
    # As many rows as there are blocks: one for every ``block_rows`` rows.
    ahead = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy("block").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    corpus = totals.agg(F.sum("bytes")).first()[0] or 0
    before = totals.select("block", F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("bytes_before"),
                           F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("rows_before"))
    inside = Window.partitionBy("block").orderBy(*_ORDER)
    start = F.col("bytes_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    nth = F.col("rows_before") + F.row_number().over(inside) - 1
    placed = write_stage(
        blocks.join(F.broadcast(before), "block").select(*_ORDER, (2 * start + F.col("size")).alias("middle"), nth.alias("nth"))
        .select(*_ORDER, F.expr(f"int((middle * {shards}) div {2 * max(1, corpus)})").alias("shard"), "nth"), "placed")
    first = placed.groupBy("shard").agg(F.min("nth").alias("first"))  # a row for each shard
    return placed.join(F.broadcast(first), "shard").select(*_ORDER, "shard", (F.col("nth") - F.col("first")).alias("slot"))


def assign_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text",
                  block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The manifest, one row per input row: ``doc_id, size, text_crc32, shard``
    and ``slot``, the row's place in its shard (gapless from 0)."""
    rows = write_stage(docs.select(*_measured(docs, id_col, text_col)), "sizes")
    return _place(rows, shards, block_rows).select(
        F.when(F.col("has_id"), F.col("id")).alias("doc_id"), "size", F.col("crc").alias("text_crc32"), "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text",
                 block_rows: int = BLOCK_ROWS) -> str:
    """Write ``docs`` as Parquet folders, one for each shard, its files in the
    order of the manifest; returns the name of the folders' column (``shard``,
    or a free name where the documents have that column).

    The first row of every shard is a cut; a row's shard follows from
    comparing it with the cuts, so texts are shuffled once, to their files.
    """
    rows = write_stage(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"),
                                   *_measured(docs, id_col, text_col)), "sized")
    # As many cuts as there are shards.
    cuts = _place(rows, shards, block_rows).where("slot = 0").orderBy("shard").collect()
    kinds = dict(rows.dtypes)

    def key(values) -> Column:
        return F.struct(*(v.alias(c) for c, v in zip(_ORDER, values)))

    of = free_name("shard", docs.columns)
    firsts = F.array(*(F.struct(key([F.lit(cut[c]).cast(kinds[c]) for c in _ORDER]).alias("first"), F.lit(cut["shard"]).alias("shard"))
                       for cut in cuts)) if cuts else F.array().cast("array<struct<first: int, shard: int>>")
    own = key([F.col(c) for c in _ORDER])
    reached = F.filter(firsts, lambda cut: cut["first"] <= own) if cuts else firsts
    out = rows.withColumn(of, F.element_at(F.transform(reached, lambda cut: cut["shard"]), -1))
    files = max(len(cuts), -(-rows.count() // block_rows))
    (out.repartitionByRange(max(1, files), *_ORDER).sortWithinPartitions(*_ORDER)
     .select("doc.*", of).write.partitionBy(of).parquet(path))
    return of
