"""Scoring joins (J1-J7) and verdicts (V4).

Two shapes, chosen by the semantics:

* **Thresholded match** (J7, score >= a positive cut): where the right side's
  entries are within the broadcast bound, each left row is scored against all of
  them in its own task (:mod:`contentfit.operators.row_match`), without a
  shuffle.  Beyond the bound the match is pruned
  (:mod:`contentfit.operators.match`).
* **Every non-zero score**: the left side's term entries are exploded and
  equi-joined on the term with the right side's, by a broadcast hash join within
  the bound, else with hot terms spread over salt buckets.  Partial products are
  summed by a partial aggregate before the single shuffle, so the shuffle
  carries one row per scored pair.
* **All pairs** (J1-J3 keep zero scores): each left row is scored against all
  right keys in its own task, so neither scores nor the grid are shuffled.  A
  right side beyond the bound is cut into blocks and the left side into
  fragments; left rows are copied to each block, pairs are made in the cells.

A pair is a pair of *rows*: rows repeating a key are scored each by their own
text, repeated rows each give their rows, and null keys are keys like any.
Rows are told apart by keys and a hash of the text, which a task that is run
again finds as before; how often a row is repeated is counted.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentfit import config
from contentfit.operators.vectors import cosine_from, lexical_cosine, with_lexical_vector
from contentfit.sources.tables import stage_table


def verdict(score, cut: float = config.VERDICT_CUT, labels=config.VERDICT_LABELS) -> Column:
    """V4: ``labels[0]`` when score >= cut, else ``labels[1]``."""
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s >= F.lit(cut), F.lit(labels[0])).otherwise(F.lit(labels[1]))


def _row_bytes(df: DataFrame) -> Column:
    """About the size of a row: strings and arrays by length, the rest 8."""
    size = F.lit(0).cast("long")
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        part = F.octet_length(c) if kind == "string" else 8 * F.size(c) if kind.startswith("array") else F.lit(8)
        size = size + F.greatest(F.coalesce(part, F.lit(0)), F.lit(0))
    return size


def fits_broadcast(df: DataFrame, max_rows: int, max_bytes: int = config.BROADCAST_MAX_BYTES) -> bool:
    """Whether a side is within the broadcast bounds, in rows and in bytes:
    one partial aggregate, of which the driver gets one row."""
    n, size = df.agg(F.count(F.lit(1)), F.sum(_row_bytes(df))).first()
    return n <= max_rows and (size or 0) <= max_bytes


def _blocks(df: DataFrame, max_rows: int, max_bytes: int = config.BROADCAST_MAX_BYTES) -> int:
    """Into how many blocks within the bounds a side is cut."""
    n, size = df.agg(F.count(F.lit(1)), F.sum(_row_bytes(df))).first()
    return max(1, math.ceil(n / max_rows), math.ceil((size or 0) / max_bytes))


def _text_blocks(right: DataFrame, keys: Sequence[str], text: str, max_rows: int) -> int:
    """Into how many blocks a side's keys and the entries of its texts are cut."""
    sides = right.select(*keys, F.col(text).alias("_t")).distinct()
    return max(_blocks(sides, max_rows), _blocks(_exploded_entries(sides, keys, "_t", "r"), max_rows))


def _fragments(df: DataFrame, blocks: int) -> int:
    """Into how many fragments the other side is cut, so that the cells are
    about as many as a shuffle has partitions."""
    return max(1, math.ceil(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) / blocks))


def all_pairs(left: DataFrame, right: DataFrame, score: Callable[[], Column],
              max_rows: int = config.BROADCAST_MAX_ROWS) -> DataFrame:
    """Every left row x every right row with ``score()`` computed in the
    task.  Column names of the two sides must not clash.

    A right side beyond the broadcast bound makes a grid: rows of either side
    go to a fragment or block by their hash and are copied along the other
    side's, so each side is read once and a cell is one key of a shuffle join,
    whose task may spill."""
    blocks = _blocks(right, max_rows)
    if blocks == 1:
        return left.crossJoin(F.broadcast(right)).withColumn("score", score())
    fragments = _fragments(left, blocks)

    def dealt(df, own, n, other, m):
        mine = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)), F.lit(n)).cast("int")
        return df.withColumn(own, mine).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    cells = dealt(left, "_a", fragments, "_b", blocks).join(dealt(right, "_b", blocks, "_a", fragments), ["_a", "_b"])
    return cells.drop("_a", "_b").withColumn("score", score())


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    cond = F.lit(True)
    for a, b in zip(left, right):
        cond = cond & F.col(a).eqNullSafe(F.col(b))
    return cond


def lexical_all_pairs(left: DataFrame, left_text: str, right: DataFrame, right_text: str,
                      right_keys: Sequence[str], cut: float = config.VERDICT_CUT,
                      labels=config.VERDICT_LABELS, digits: int = 6,
                      max_rows: int = config.BROADCAST_MAX_ROWS,
                      left_keys: Sequence[str] | None = None, raw_col: str | None = None) -> DataFrame:
    """All pairs of left rows and right keys with the guarded lexical
    cosine and a verdict; the left columns, the right keys, ``score``
    (rounded) and ``verdict`` (from the unrounded score, which ``raw_col``
    names to keep it).

    Each left row is scored against the whole right side in its own task
    (:func:`contentfit.operators.row_match.every_pair`): neither scores nor pairs
    are shuffled.  Beyond the bound the right side is cut into blocks, and the
    left rows, read once, are dealt to (fragment, block) cells.

    Of a right key with several texts, the scores above zero, equal ones once;
    0.0 where none is.  Left rows need no key: ``left_keys`` is not used any more.
    """
    from contentfit.operators.row_match import every_pair
    blocks = _text_blocks(right, right_keys, right_text, max_rows)
    pairs = every_pair(left, left_text, right, right_keys, right_text, blocks, _fragments(left, blocks))
    out = pairs.withColumn("verdict", verdict(F.col("_raw"), cut, labels)).withColumn("score", F.round("_raw", digits))
    return out.withColumnRenamed("_raw", raw_col) if raw_col else out.drop("_raw")


def _exploded_entries(df: DataFrame, keys: Sequence[str], text: str, prefix: str) -> DataFrame:
    v = with_lexical_vector(df.select(*keys, text), text, "_v")
    # explode_outer + a filter on the generated column: a plain explode makes
    # Catalyst infer size(entries) > 0 and push it below the projections,
    # re-evaluating the whole vector expression inside that filter.
    return (v.select(*keys, F.col("_v.norm").alias(f"{prefix}norm"), F.explode_outer("_v.entries").alias("_e"))
             .where(F.col("_e").isNotNull())
             .select(*keys, f"{prefix}norm", F.col("_e.term").alias("term"), F.col("_e.tf").alias(f"{prefix}tf")))


def _repeats(df: DataFrame, keys: Sequence[str], text_hash: str, count: str, prefix: str) -> DataFrame:
    """Rows that occur more than once, by keys and text: hardly any, mostly."""
    often = df.groupBy(*keys, text_hash).agg(F.count(F.lit(1)).alias(count)).where(F.col(count) > 1)
    return often.select(*(F.col(c).alias(f"{prefix}{i}") for i, c in enumerate([*keys, text_hash])), count)


def lexical_scores(left: DataFrame, left_keys: Sequence[str], left_text: str,
                   right: DataFrame, right_keys: Sequence[str], right_text: str,
                   max_rows: int = config.BROADCAST_MAX_ROWS,
                   salt_buckets: int = config.SALT_BUCKETS, small: bool | None = None) -> DataFrame:
    """Every pair of rows that shares at least one term, with ``dot``, the
    unrounded cosine ``raw_score`` and ``_th``, the left text's hash (pairs
    sharing nothing score 0 and are not emitted).  ``small`` says that the right
    side's entries are known to be within the broadcast bound."""
    lk, rk = [*left_keys, "_th"], [*right_keys, "_rh"]
    left = left.withColumn("_th", F.xxhash64(left_text))
    right = right.withColumn("_rh", F.xxhash64(right_text))
    le = _exploded_entries(left, lk, left_text, "l")
    re_ = _exploded_entries(right, rk, right_text, "r")
    if small or small is None and fits_broadcast(re_, max_rows):
        j = le.join(F.broadcast(re_), "term")
    else:
        # Salted shuffle join: the left side's rows for a hot term spread
        # over ``salt_buckets`` tasks; the right side is replicated per salt.
        salt = F.pmod(F.xxhash64(*lk), F.lit(salt_buckets)).cast("int")
        le_s = le.withColumn("_salt", salt)
        re_s = re_.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt_buckets - 1))))
        j = le_s.join(re_s, ["term", "_salt"]).drop("_salt")
    dots = j.groupBy(*lk, "lnorm", *rk, "rnorm").agg(F.sum(F.col("ltf") * F.col("rtf")).alias("dot"))
    # The sum of rows repeated m and n times is m * n times theirs; it is theirs, and they are m * n rows.
    for df, keys, count, prefix in ((left, lk, "_lm", "_l"), (right, rk, "_rm", "_r")):
        often = _repeats(df, keys[:-1], keys[-1], count, prefix)
        dots = dots.join(often, _same(keys, [f"{prefix}{i}" for i in range(len(keys))]), "left").drop(
            *(f"{prefix}{i}" for i in range(len(keys))))
    times = F.coalesce("_lm", F.lit(1)) * F.coalesce("_rm", F.lit(1))
    dots = repeated(dots.withColumn("_m", times).withColumn("dot", F.expr("dot div _m")), F.col("_m"))
    return (dots.withColumn("raw_score", cosine_from(F.col("dot"), F.col("lnorm"), F.col("rnorm")))
                .drop("lnorm", "rnorm", "_rh", "_lm", "_rm", "_m"))


def repeated(df: DataFrame, times: Column, block: int = 10_000) -> DataFrame:
    """Every row ``times`` over, in blocks, so that no array grows with the count."""
    columns = df.columns
    df = df.withColumn("_times", times.cast("long"))
    df = df.withColumn("_block", F.explode(F.expr(f"sequence(0L, (_times - 1) div {block})")))
    df = df.withColumn("_one", F.explode(F.expr(f"sequence(1L, least({block}L, _times - _block * {block}))")))
    return df.select(*columns)


def lexical_match(left: DataFrame, left_keys: Sequence[str], left_text: str,
                  right: DataFrame, right_keys: Sequence[str], right_text: str,
                  min_score: float, digits: int = 6,
                  max_rows: int = config.BROADCAST_MAX_ROWS) -> DataFrame:
    """Pairs whose lexical cosine is >= ``min_score`` (> 0), found row by row
    (:mod:`contentfit.operators.row_match`).  Where the right side's entries are
    beyond the broadcast bound, by a pruned join.

    Output: left keys, right keys, ``score`` (rounded), ``raw_score``.
    """
    if not min_score > 0:
        raise ValueError("lexical_match needs a positive threshold; use lexical_all_pairs for zero pairs")
    if not fits_broadcast(_exploded_entries(right, right_keys, right_text, "r"), max_rows):
        from contentfit.operators.match import pruned_match
        return pruned_match(left, left_keys, left_text, right, right_keys, right_text, min_score, digits, max_rows)
    from contentfit.operators.row_match import cosines
    found = cosines(left, left_keys, left_text, right, right_keys, right_text, min_score)
    return found.select(*left_keys, *right_keys, F.round("raw_score", digits).alias("score"), "raw_score")


def best_section_per_query(sections: DataFrame, queries: DataFrame, query_key: str, query_text: str,
                           cut: float = config.VERDICT_CUT, labels=config.VERDICT_LABELS,
                           digits: int = 6, max_rows: int = config.BROADCAST_MAX_ROWS) -> DataFrame:
    """J5 (D6): for every page and query, the best-scoring section, ties by
    (section, ordinal); the first section at score 0 where none shares a term.

    Sections are scored in their own task, which keeps for each run of a page's
    sections the best one by query (:func:`contentfit.operators.row_match.best_rows`);
    these short rows are written.  Only pages of several runs, as where rows
    repeat an id, are compared by a shuffle.  Queries beyond the broadcast bound
    are scored by the term join."""
    keys = ["section", "ordinal"]
    if _text_blocks(queries, [query_key], query_text, max_rows) == 1:
        from contentfit.operators.row_match import best_rows
        runs, by_key = best_rows(sections, "page_id", keys, "text", queries, [query_key], query_text)
        runs = stage_table(runs, "best-sections")
        often = runs.groupBy("page_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("page_id").alias("_page"))
        often = stage_table(often, "pages-of-several-runs")
        if fits_broadcast(often, max_rows):
            often = F.broadcast(often)
        once, several = (by_key(runs.join(often, _same(["page_id"], ["_page"]), how)) for how in ("left_anti", "left_semi"))
        several = best_by(several, ["page_id", query_key], "_raw", keys, [*keys, "_raw"])
        out = once.unionByName(several)
    else:
        nz = lexical_scores(sections, ["page_id", *keys], "text", queries, [query_key], query_text, max_rows)
        best = best_by(nz, ["page_id", query_key], "raw_score", keys, [*keys, "raw_score"])
        first = (sections.groupBy("page_id")
                         .agg(F.min(F.struct("section", "ordinal")).alias("_f"))
                         .select("page_id", F.col("_f.section").alias("f_section"), F.col("_f.ordinal").alias("f_ordinal")))
        q_ids = queries.select(query_key).distinct()
        grid = all_pairs(first, q_ids, lambda: F.lit(0.0), max_rows).drop("score")
        best = best.withColumnRenamed("page_id", "_page").withColumnRenamed(query_key, "_query")
        out = grid.join(best, _same(["page_id", query_key], ["_page", "_query"]), "left")
        found = F.col("raw_score").isNotNull()
        out = out.select("page_id", query_key, *(F.when(found, F.col(c)).otherwise(F.col(f"f_{c}")).alias(c) for c in keys),
                         F.coalesce("raw_score", F.lit(0.0)).alias("_raw"))
    return out.select("page_id", query_key, *keys, F.round("_raw", digits).alias("score"), verdict("_raw", cut, labels).alias("verdict"))


def self_fit(df: DataFrame, a: str, b: str, cut: float = config.VERDICT_CUT,
             labels=config.VERDICT_LABELS, digits: int = 6) -> DataFrame:
    """Score two text columns of the same row (title vs description)."""
    v = with_lexical_vector(with_lexical_vector(df, a, "_va"), b, "_vb")
    return (v.withColumn("_raw", lexical_cosine(F.col("_va"), F.col("_vb"))).drop("_va", "_vb")
              .withColumn("score", F.round("_raw", digits))
              .withColumn("verdict", verdict(F.col("_raw"), cut, labels)).drop("_raw"))


def best_by(pairs: DataFrame, group_cols: Sequence[str], score_col: str,
            tie_cols: Sequence[str], keep_cols: Sequence[str]) -> DataFrame:
    """Per group, the row with the highest score, ties by ``tie_cols``
    ascending.  ``min_by`` over a struct key is algebraic, so it is combined
    map-side and a hot group costs one row per task before the shuffle."""
    order = F.struct((-F.col(score_col)).alias("neg"), *[F.col(c) for c in tie_cols])
    best = F.min_by(F.struct(*[F.col(c) for c in keep_cols]), order).alias("_best")
    return pairs.groupBy(*group_cols).agg(best).select(*group_cols, *[F.col(f"_best.{c}").alias(c) for c in keep_cols])


def centroids(df: DataFrame, key: str, vec: str) -> DataFrame:
    """Mean vector per key (in double).  Partial aggregation per (key,
    position); the collected list per key has one entry per dimension, so
    its size is bounded by the vector width, not by the data."""
    from pyspark.sql import functions as F2  # noqa: N812
    per_pos = (df.select(key, F2.posexplode(vec).alias("pos", "v"))
                 .groupBy(key, "pos").agg(F2.avg(F2.col("v").cast("double")).alias("m")))
    return (per_pos.groupBy(key)
                   .agg(F2.array_sort(F2.collect_list(F2.struct("pos", "m"))).alias("_pm"))
                   .select(key, F2.transform("_pm", lambda e: e["m"]).alias("centroid")))


def dense_all_pairs(left: DataFrame, left_vec: str, right: DataFrame, right_vec: str, cut: float = config.VERDICT_CUT,
                    labels=config.VERDICT_LABELS, digits: int = 6,
                    max_rows: int = config.BROADCAST_MAX_ROWS) -> DataFrame:
    """V2 over supplied vectors: every left row x every right row, cosine and verdict, computed inside the task.  Norms are computed once
    per row; a zero vector scores 0.0."""
    from contentfit.operators.vectors import dense_dot, dense_norm
    lefts = left.withColumn("_nl", dense_norm(F.col(left_vec)))
    rights = right.withColumn("_nr", dense_norm(F.col(right_vec)))
    pairs = all_pairs(lefts, rights, lambda: cosine_from(
        dense_dot(F.col(left_vec), F.col(right_vec)), F.col("_nl"), F.col("_nr")), max_rows).drop("_nl", "_nr")
    return (pairs.withColumn("verdict", verdict(F.col("score"), cut, labels))
                 .withColumn("score", F.round("score", digits)))


def nearest_label(items: DataFrame, item_key: str, item_text: str, labelled: DataFrame, label_col: str,
                  max_rows: int = config.BROADCAST_MAX_ROWS, digits: int = 6) -> DataFrame:
    """X6 default: each item takes the label whose text scores highest
    against it (ties by label ascending).  Only pairs sharing a term are
    scored; an item sharing no term with any label takes the smallest label
    at score 0, exactly what the full cross table would give.  Where the items'
    entries are beyond the broadcast bound, by a join with bounds."""
    lab = labelled.select(F.col(label_col).alias("_label")).distinct()
    if not fits_broadcast(_exploded_entries(items, [item_key], item_text, "r"), max_rows):
        from contentfit.operators.match import best_match
        return best_match(items, item_text, lab.withColumnRenamed("_label", label_col), label_col, digits, max_rows)
    nz = lexical_scores(lab, ["_label"], "_label", items.select(item_key, item_text), [item_key], item_text,
                        max_rows, small=True)
    best = best_by(nz, [item_key], "raw_score", ["_label"], ["_label", "raw_score"])
    smallest = lab.agg(F.min("_label").alias("_min_label"))
    best = best.withColumnRenamed(item_key, "_item")
    out = items.join(best, _same([item_key], ["_item"]), "left").crossJoin(F.broadcast(smallest))
    raw = F.coalesce(F.col("raw_score"), F.lit(0.0))
    return out.select(*items.columns, F.coalesce(F.col("_label"), F.col("_min_label")).alias(label_col),
                      F.round(raw, digits).alias("score"))


def assign_labels(items: DataFrame, item_key: str, item_text: str, supplied: DataFrame, labelled: DataFrame,
                  label_col: str = "intent", max_rows: int = config.BROADCAST_MAX_ROWS) -> DataFrame:
    """Label from a supplied (text -> label) table where the item's
    text is in it (of several, the first in order); otherwise the nearest
    labelled text's label."""
    sup = supplied.groupBy(F.col("query").alias(item_text)).agg(F.min(label_col).alias("_sup")).where("_sup is not null")
    given = items.join(sup, item_text).select(*items.columns, F.col("_sup").alias(label_col), F.lit(1.0).alias("score"))
    near = nearest_label(items.join(sup, item_text, "left_anti"), item_key, item_text, labelled, label_col, max_rows)
    return given.unionByName(near)


def lsh_match(left: DataFrame, left_key: str, left_vec: str, right: DataFrame, right_key: str, right_vec: str,
              min_score: float, bucket_length: float = 1.0, num_tables: int = 4, seed: int = 42) -> DataFrame:
    """J7 on dense vectors, approximate: ``BucketedRandomProjectionLSH``
    candidate pairs (vectors L2-normalised, so Euclidean distance d maps to
    cosine 1 - d^2/2), kept when the cosine is >= ``min_score``.  Pairs
    that share no bucket are missed; the exact form is :func:`dense_all_pairs`."""
    import math

    from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
    from pyspark.ml.functions import array_to_vector

    def prep(df, key, vec):
        v = df.select(F.col(key).alias("id"), array_to_vector(F.col(vec).cast("array<double>")).alias("raw"))
        return Normalizer(inputCol="raw", outputCol="features", p=2.0).transform(v).select("id", "features")

    a, b = prep(left, left_key, left_vec), prep(right, right_key, right_vec)
    lsh = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket_length,
                                      numHashTables=num_tables, seed=seed).fit(b)
    max_dist = math.sqrt(max(0.0, 2.0 - 2.0 * min_score))
    pairs = lsh.approxSimilarityJoin(a, b, max_dist, distCol="dist")
    return pairs.select(F.col("datasetA.id").alias(left_key), F.col("datasetB.id").alias(right_key),
                        F.round(1.0 - F.col("dist") * F.col("dist") / 2.0, 6).alias("score"))
