"""Benchmark decontamination by size-partitioned MinHash containment search.

Uses DataFrame functions only.  An item's set is its distinct 5-word shingles
(letters and digits, lower-cased) as 64-bit hashes; a document contains it
if it has ``pct`` percent of them or more.  A document may then lack
``n - ceil(pct n / 100)`` of an item's ``n`` shingles, so one of any such number
plus one must be in it: the item's smallest hashes, a bottom-k MinHash sketch
whose ``k`` follows the item's size, find every document that contains it,
however long that is.  Items are partitioned by size (powers of two), and each
partition has the largest hash of its sketches as bound: a document only
looks up its hashes below the bounds of the partitions that could fit in it,
about a quarter of them.  Candidates are verified by counting the item's
shingles in the document's full set.

Defined cases: empty texts have no shingles and match nothing; a text of fewer
than five words is one shingle; null ids match nothing; rows repeating an id
give one row per pair, the highest containment; a containment of exactly the
threshold counts; a very long text is read whole, its shingles as one array of
its row; without items or documents the result is empty; extra columns of any
name are kept by ``drop_contaminated``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentfit.llm.common import free_name, write_stage

SHINGLE_WORDS = 5
CONTAINMENT_PCT = 80


def with_shingles(df: DataFrame, text_col: str, name: str, k: int = SHINGLE_WORDS) -> DataFrame:
    """``df`` with the distinct shingle hashes of a text as an array of long."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    h = F.col("__h")
    many = F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(k))))
    one = F.array(F.xxhash64(h))
    return (df.withColumn("__h", F.transform(words, lambda w: F.xxhash64(w)))
            .withColumn(name, F.when(F.size(h) >= k, F.array_distinct(many))
                        .when(F.size(h) > 0, one).otherwise(F.array().cast("array<bigint>"))).drop("__h"))


def _bound(partitions: list, n: Column, pct: int) -> Column | None:
    """Largest sketch hash of the size partitions that a document of ``n``
    shingles can hold; partitions are at most 32, one for each power of two."""
    best, expr = None, None
    for row in sorted(partitions, key=lambda r: r["smallest"]):
        best = row["bound"] if best is None else max(best, row["bound"])
        fits = 100 * n >= pct * row["smallest"]
        expr = F.when(fits, F.lit(best)) if expr is None else F.when(fits, F.lit(best)).otherwise(expr)
    return expr


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    item_col: str = "item_id", item_text_col: str = "text", pct: int = CONTAINMENT_PCT,
                    k: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, item_id, n_item_shingles, n_shared, containment`` of every pair
    with containment of ``pct``/100 or more."""
    items = with_shingles(items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("__t"))
                          .where("item_id is not null"), "__t", "item", k)
    items = write_stage(items.select("item_id", "item", F.size("item").alias("n")).where("n > 0").distinct(), "items")
    need = F.ceil(F.col("n") * pct / 100)
    sketch = write_stage(items.select(
        "item_id", "n", F.explode(F.expr("slice(sort_array(item), 1, int(n - ceil(n * {0} / 100)) + 1)".format(pct)))
        .alias("h")), "sketches")
    partitions = sketch.groupBy(F.floor(F.log2("n")).alias("p")).agg(
        F.min("n").alias("smallest"), F.max("h").alias("bound")).collect()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__t")).where("doc_id is not null")
    sets = with_shingles(texts, "__t", "sh", k).select("doc_id", "sh", F.size("sh").alias("size"))
    bound = _bound(partitions, F.col("size"), pct)
    if bound is None:
        bound = F.lit(None).cast("bigint")
    looked = sets.withColumn("bound", bound).select(
        "doc_id", "size", F.explode(F.expr("filter(sh, x -> x <= bound)")).alias("h"))
    pairs = write_stage(looked.join(sketch, "h").where(F.col("size") >= need).select("doc_id", "item_id").distinct(),
                        "candidates")
    chosen = texts.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    both = (with_shingles(chosen, "__t", "sh", k).select("doc_id", "sh").join(pairs, "doc_id").join(items, "item_id"))
    shared = F.size(F.array_intersect("item", "sh"))
    return (both.withColumn("n_shared", shared.cast("long")).where(100 * F.col("n_shared") >= pct * F.col("n"))
            .groupBy("doc_id", "item_id")
            .agg(F.max(F.col("n").cast("long")).alias("n_item_shingles"), F.max("n_shared").alias("n_shared"))
            .withColumn("containment", F.col("n_shared") / F.col("n_item_shingles")))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **params) -> DataFrame:
    """``docs`` without the documents that contain an item; same columns."""
    found = contained_items(docs, items, id_col, **params)
    own = free_name("gone", docs.columns)
    gone = write_stage(found.select(F.col("doc_id").alias(own)).distinct(), "contaminated")
    return docs.join(gone, F.col(id_col) == F.col(own), "left_anti")
