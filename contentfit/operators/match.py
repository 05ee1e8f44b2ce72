"""Exact similarity joins that leave out pairs by bounds.

Both sides' vectors are ranked: a term that both sides hold gets a rank, low
where it makes few pairs for the weight it carries, high where it makes many.
A vector's *rest* at a term is the norm of that term and all of higher rank.
If a pair's first common term has rests ``a`` and ``b``, its cosine is at most
``a * b`` (Cauchy-Schwarz), so only pairs of entries with ``a * b`` at the
threshold make a candidate; every pair at the threshold has one, its first.
Candidates meet by *sketches* next: the terms that make the most pairs have a
weight each, all others a norm for each of some groups of ranks, and the sum
of products again bounds the cosine.  What passes is scored from whole vectors.
The result is that of scoring every pair.

:func:`pruned_match` has one threshold.  :func:`best_match` finds each item's
best label: its threshold is a score the item is known to reach, that of the
label sharing the most with its lowest-ranked entries.

Rows are told apart by their keys and text; rows equal in both are scored once
and give their rows at the end.  Null keys are keys like any.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contentfit import config
from contentfit.operators.fit import _exploded_entries, _same, fits_broadcast, repeated
from contentfit.operators.vectors import cosine_from, dense_dot, entries_dot
from contentfit.sources.tables import stage_table

#: Bounds are floating point; a pair this close below the threshold is scored.
_SLACK = 1e-9
#: Places of a sketch: terms of the most pairs, and groups of the others.
SKETCH_TERMS, SKETCH_GROUPS = 64, 64
#: Lowest-ranked entries of an item from which its first label is picked.
PROBE_ENTRIES = 8
#: Rows of a shuffled partition that a task aggregates or sorts.
TASK_ROWS = 1_000_000


def dealt(df: DataFrame, row: Sequence[str], rows: int) -> DataFrame:
    """``df`` by ``row``, about ``TASK_ROWS`` of its ``rows`` or fewer to a task,
    so that a task's memory doesn't grow with the table."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / TASK_ROWS)), *row)


def of_terms(entries: DataFrame, other: DataFrame | None, max_rows: int = config.BROADCAST_MAX_ROWS) -> DataFrame:
    """The entries of terms that the other side's have; the others make no pair."""
    if other is None:
        return entries
    terms = stage_table(other.select("term").distinct(), "side-terms")
    return entries.join(F.broadcast(terms) if fits_broadcast(terms, max_rows) else terms, "term", "left_semi")


def postings(df: DataFrame, keys: Sequence[str], text: str, side: str, other: DataFrame | None = None) -> DataFrame:
    """``(keys, {side}h, {side}norm, term, {side}tf)`` of a side, written; of
    the terms of ``other`` postings alone, if these are given."""
    rows = df.select(*keys, text).withColumn(f"{side}h", F.xxhash64(text))
    return stage_table(of_terms(_exploded_entries(rows, [*keys, f"{side}h"], text, side), other), f"postings-{side}")


def term_ranks(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(term, rank, pairs, place)`` of the terms that both sides hold; ``pairs``
    is how many pairs of entries the term makes, ``place`` its place in a sketch.
    Ranks grow with the pairs a term makes for the weight it carries on either
    side."""
    def of(side, entries):
        share = F.col(f"{side}tf") * F.col(f"{side}tf") / (F.col(f"{side}norm") * F.col(f"{side}norm"))
        return entries.groupBy("term").agg(F.count(F.lit(1)).alias(f"{side}n"), F.sum(share).alias(f"{side}w"))
    both = of("l", left).join(of("r", right), "term")
    pairs = F.col("ln") * F.col("rn")
    both = stage_table(both.select("term", pairs.alias("pairs"), (pairs * pairs / (F.col("lw") * F.col("rw"))).alias("cost")), "terms")
    # A sorted table's running row number, fixed by writing it.
    ranks = stage_table(both.orderBy("cost", "term").select("term", F.monotonically_increasing_id().alias("rank"), "pairs"), "ranks")
    top = ranks.orderBy(F.desc("pairs"), "term").select("term").limit(SKETCH_TERMS).collect()
    top = ranks.sparkSession.createDataFrame([(r["term"], i) for i, r in enumerate(top)], "term string, top int")
    group = SKETCH_TERMS + F.pmod(F.xxhash64("rank"), F.lit(SKETCH_GROUPS)).cast("int")
    return ranks.join(F.broadcast(top), "term", "left").withColumn("place", F.coalesce("top", group)).drop("top")


def ranked(entries: DataFrame, ranks: DataFrame, keys: Sequence[str], side: str) -> DataFrame:
    """``(keys, {side}h, {side}norm, {side}m, rank, place, {side}tf, {side}rest)``:
    the entries of shared terms, how often the row occurs, and the rest's norm."""
    row = [*keys, f"{side}h"]
    known = dealt(entries.join(ranks.select("term", "rank", "place"), "term"), row, entries.count())
    once = known.groupBy(*row, f"{side}norm", "rank", "place", f"{side}tf").agg(F.count(F.lit(1)).alias(f"{side}m"))
    behind = Window.partitionBy(*row).orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = F.sqrt(F.sum(F.col(f"{side}tf") * F.col(f"{side}tf")).over(behind).cast("double")) / F.col(f"{side}norm")
    return stage_table(once.withColumn(f"{side}rest", rest), f"ranked-{side}")


def _vectors(entries: DataFrame, keys: Sequence[str], side: str) -> DataFrame:
    row = [*keys, f"{side}h", f"{side}norm", f"{side}m"]
    item = F.struct(F.col("rank").alias("term"), F.col(f"{side}tf").alias("tf"))
    return entries.groupBy(*row).agg(F.sort_array(F.collect_list(item)).alias(f"{side}v"))


def _sketches(entries: DataFrame, keys: Sequence[str], side: str) -> DataFrame:
    row = [*keys, f"{side}h"]
    square = F.sum(F.col(f"{side}tf") * F.col(f"{side}tf")).cast("double")
    parts = entries.groupBy(*row, f"{side}norm", "place").agg((F.sqrt(square) / F.col(f"{side}norm")).alias("part"))
    parts = parts.groupBy(*row).agg(F.sort_array(F.collect_list(F.struct("place", "part"))).alias("parts"))
    before = F.slice(F.concat(F.array(F.lit(-1)), F.col("parts.place")), 1, F.size("parts"))
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    filled = parts.select(*row, F.flatten(F.zip_with("parts", before, lambda x, p: F.concat(
        zeros(x["place"] - p - 1), F.array(x["part"])))).alias("filled"))
    rest = zeros(SKETCH_TERMS + SKETCH_GROUPS - F.size("filled"))
    return filled.select(*row, F.concat("filled", rest).alias(f"{side}s"))


def _with_sides(pairs: DataFrame, sides: Sequence[tuple[DataFrame, Sequence[str], str]], max_rows: int) -> DataFrame:
    """Pairs of rows with what each side's row has, the smaller sides broadcast."""
    for rows, keys, side in sides:
        row = [*keys, f"{side}h"]
        for c in row:
            rows = rows.withColumnRenamed(c, f"_of_{c}")
        names = [f"_of_{c}" for c in row]
        pairs = pairs.join(F.broadcast(rows) if fits_broadcast(rows, max_rows) else rows, _same(row, names)).drop(*names)
    return pairs


def scored(pairs: DataFrame, left: DataFrame, lk: Sequence[str], right: DataFrame, rk: Sequence[str], least: Column,
           max_rows: int = config.BROADCAST_MAX_ROWS) -> DataFrame:
    """Pairs of rows ``(lk, lh, rk, rh)`` that can reach ``least`` by their
    sketches, with ``raw_score``, ``lm`` and ``rm``, from whole vectors."""
    also = [c for c in pairs.columns if c not in (*lk, "lh", *rk, "rh")]
    near = _with_sides(pairs, [(stage_table(_sketches(left, lk, "l"), "sketches"), lk, "l"),
                               (stage_table(_sketches(right, rk, "r"), "sketches"), rk, "r")], max_rows)
    near = stage_table(near.where(dense_dot("ls", "rs") >= least).drop("ls", "rs"), "near")
    sides = []
    for entries, keys, side in ((left, lk, "l"), (right, rk, "r")):
        row = [*keys, f"{side}h"]
        used = near.select(*(F.col(c).alias(f"_of_{c}") for c in row)).distinct()
        entries = entries.join(used, _same(row, [f"_of_{c}" for c in row]), "left_semi")
        sides.append((stage_table(_vectors(entries, keys, side), "vectors"), keys, side))
    return _with_sides(near, sides, max_rows).select(*lk, "lh", *rk, "rh", *also, "lm", "rm", cosine_from(
        entries_dot("lv", "rv", dict(left.dtypes)["ltf"]), "lnorm", "rnorm").alias("raw_score"))


def candidates(left: DataFrame, lk: Sequence[str], right: DataFrame, rk: Sequence[str], bound: Column,
               max_rows: int = config.BROADCAST_MAX_ROWS) -> DataFrame:
    """Distinct pairs of rows with a common term whose rests reach ``bound``."""
    right = right.select("rank", *rk, "rh", "rrest")
    if fits_broadcast(right, max_rows):
        # Rows dealt by left row keep their hits together: these aren't shuffled, and a task has so many of them.
        many = left.groupBy("rank").agg(F.count(F.lit(1)).alias("l")).join(right.groupBy("rank").agg(F.count(F.lit(1)).alias("r")), "rank")
        left = dealt(left, [*lk, "lh"], many.agg(F.sum(F.col("l") * F.col("r"))).first()[0] or 0)
        right = F.broadcast(right)
    hits = left.join(right, (left["rank"] == right["rank"]) & (F.col("lrest") * F.col("rrest") >= bound))
    return hits.select(*lk, "lh", *rk, "rh").distinct()


def pruned_match(left: DataFrame, left_keys: Sequence[str], left_text: str, right: DataFrame, right_keys: Sequence[str],
                 right_text: str, min_score: float, digits: int = 6, max_rows: int = config.BROADCAST_MAX_ROWS) -> DataFrame:
    """The rows of ``lexical_match``, by candidates and verification."""
    lk, rk = list(left_keys), list(right_keys)
    rp = postings(right, rk, right_text, "r")
    return match_postings(postings(left, lk, left_text, "l", rp), lk, rp, rk, min_score, digits, max_rows)


def match_postings(lp: DataFrame, lk: Sequence[str], rp: DataFrame, rk: Sequence[str], min_score: float, digits: int = 6,
                   max_rows: int = config.BROADCAST_MAX_ROWS) -> DataFrame:
    """The pruned match of two sides' postings, of counts or other weights that
    aren't negative."""
    if not min_score > 0:
        raise ValueError("a pruned match needs a positive threshold")
    ranks = term_ranks(lp, rp)
    lv, rv = ranked(lp, ranks, lk, "l"), ranked(rp, ranks, rk, "r")
    least = min_score * (1 - _SLACK)
    pairs = candidates(lv.where(F.col("lrest") >= least), lk, rv.where(F.col("rrest") >= least), rk, F.lit(least), max_rows)
    found = scored(pairs, lv, lk, rv, rk, F.lit(least), max_rows).where(F.col("raw_score") >= min_score)
    return repeated(found, F.col("lm") * F.col("rm")).select(*lk, *rk, F.round("raw_score", digits).alias("score"), "raw_score")


def best_match(items: DataFrame, item_text: str, labels: DataFrame, label_col: str, digits: int = 6,
               max_rows: int = config.BROADCAST_MAX_ROWS) -> DataFrame:
    """Each item with its best label and score, ties by label; an item
    that shares no term with a label has the smallest label and 0.0.

    An item's lowest-ranked entries are in few labels.  The label that shares the
    most with them is scored whole, which is a score the item reaches: pairs that
    can't reach it are left out, and whole vectors are read for the rest only.
    """
    # Labels are texts: entries and pairs name them by a number, fixed by writing it.
    labels = labels.select(F.col(label_col).alias("_label")).distinct()
    labels = stage_table(labels.withColumn("_id", F.monotonically_increasing_id()), "labels")
    rows = items.select(item_text).distinct()
    lp = postings(rows, [], item_text, "l")
    rp = postings(labels, ["_id"], "_label", "r", lp)
    ranks = term_ranks(lp, rp)
    lv, rv = ranked(lp, ranks, [], "l"), ranked(rp, ranks, ["_id"], "r")
    # Weights aren't negative, so the labels that share the most with an item's lowest-ranked entries score at least that.
    nth = Window.partitionBy("lh").orderBy("rank")
    first = lv.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= PROBE_ENTRIES).select("lh", "rank", "ltf", "lnorm")
    part = F.sum(F.col("ltf") * F.col("rtf") / (F.col("lnorm") * F.col("rnorm"))).alias("part")
    hits = first.join(rv, "rank").groupBy("lh", "_id", "rh").agg(part)
    near = stage_table(hits.groupBy("lh").agg(F.max_by(F.struct("_id", "rh"), F.struct("part", "_id")).alias("n"))
                       .select("lh", "n.*"), "first-labels")
    reached = stage_table(scored(near, lv, [], rv, ["_id"], F.lit(0.0), max_rows).select(
        F.col("lh").alias("item"), (F.col("raw_score") * (1 - _SLACK)).alias("least")), "reached")
    entries = lv.join(reached, F.col("lh") == F.col("item")).where(F.col("lrest") >= F.col("least")).drop("item")
    right = rv.select("rank", "_id", "rh", "rrest")
    right = F.broadcast(right) if fits_broadcast(right, max_rows) else right
    pairs = entries.join(right, "rank").where(F.col("lrest") * F.col("rrest") >= F.col("least")).select(
        "lh", "_id", "rh", "least").distinct()
    found = scored(pairs, lv, [], rv, ["_id"], F.col("least"), max_rows).where(F.col("raw_score") >= F.col("least"))
    best = found.select("lh", "_id", "raw_score").join(labels, "_id").groupBy("lh").agg(
        F.min(F.struct((-F.col("raw_score")).alias("neg"), "_label")).alias("b"))
    best = best.select(F.col("lh").alias("_h"), F.col("b._label").alias("_best"), (-F.col("b.neg")).alias("_raw"))
    smallest = labels.agg(F.min("_label").alias("_min"))
    out = items.withColumn("_lh", F.xxhash64(item_text)).join(best, F.col("_lh") == F.col("_h"), "left").crossJoin(F.broadcast(smallest))
    return out.select(*items.columns, F.coalesce("_best", "_min").alias(label_col),
                      F.round(F.coalesce("_raw", F.lit(0.0)), digits).alias("score"))
