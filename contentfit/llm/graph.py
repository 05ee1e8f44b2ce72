"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentfit.llm.common import write_stage


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for the nodes of ``edges(u, v)``; label is the
    component's smallest node.

    Large-star hangs every larger neighbour of a node on its smallest
    neighbour, small-star does the same with the smaller ones; repeated, every
    component becomes a star round its smallest node in about log(n) rounds.
    The per-node minimum is written as a table, so both sides of the join that
    uses it are plain shuffles and adaptive execution can split a hub's rows.
    Self loops, repeated edges and an empty table are allowed; null ends are
    dropped.
    """
    edges = write_stage(edges.select("u", "v").dropna().where("u <> v").distinct(), "edges")
    before = None
    while (state := _fingerprint(edges)) != before:
        before, n = state, state[0]
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = write_stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low", 2 * n)
        large = (both.join(low, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        large = write_stage(large, "large", n)
        low = write_stage(large.groupBy("u").agg(F.min("v").alias("m")), "low", n)
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v")))
                 .where("u <> v").distinct())
        edges = write_stage(small, "edges", 2 * n)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return write_stage(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")).unionByName(roots),
                       "components", 2 * n)
