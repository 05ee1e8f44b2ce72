"""Section x query fits that are kept up to date.

A run compares what it is given with what the last run saw: pages by a digest
of address and markup, queries by id and text.  Only new and changed pages are
parsed, only their sections are scored against every query, and of the others
only new queries are scored.  Removed pages and queries leave the tables.

Tables are Parquet folders by run and bucket (a hash of the page id).  A run
writes under its own number, and last of all a list of which runs hold each
table's bucket now; tables are read by a join with that list, which prunes
their partitions.  A run that dies leaves files that no list names, and the
tables as they were.  Digests and queries are written whole by bucket.  Sections
and fits are added to: pages that a run changes or drops are listed, and their rows of
earlier runs no longer count.  When a table is in many runs, or half of the pages
have such rows, a run first writes it anew.

Queries are numbered by batch, those new in a run, and place in it.  A stored fit row
is a section with its norm and its dot products with a batch by place; the pairs
and their scores are made of it as they are read.

Defined cases: null page ids are one page, as are rows that repeat an id; a page
without sections keeps its digest; repeated query ids are queries of their own
where their texts differ; empty inputs leave empty tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contentfit import config
from contentfit.operators import fit as fx
from contentfit.operators import sections as sx
from contentfit.operators.row_match import placed_products
from contentfit.operators.vectors import cosine_from, entries_norm, term_entries
from contentfit.sources.tables import stage_table

BUCKETS = 64
SECTIONS = "page_id long, section string, ordinal int, text string"
DIGESTS = "page_id long, digest string"
STORED = "page_id long, section string, ordinal int, norm double, batch long, dots array<bigint>, cut double"
FITS = "page_id long, section string, ordinal int, query_id long, query string, raw_score double, score double, verdict string"
QUERIES = "query_id long, query string"
NUMBERED = f"{QUERIES}, batch long, place int"
REPLACED = "page_id long"
#: Runs that may hold a table's rows before it is written anew.
MAX_RUNS = 16
#: Batches that the queries of one run may make.
BATCHES = 1 << 20
_LIST = "name string, bucket int, run int"
ADDED_TO = ("sections", "fits")


def bucket_of(page_id: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(page_id), F.lit(buckets)).cast("int").alias("bucket")


class Tables:
    """The tables under a folder as its last whole run left them."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        try:
            lists = spark.read.parquet(f"{self.path}/current")
            self.run = lists.agg(F.max("list")).first()[0]
            self.list = lists.where(F.col("list") == self.run).drop("list")
        except AnalysisException:  # no run yet
            self.run, self.list = 0, spark.createDataFrame([], _LIST)

    def rows(self, name: str, schema: str, only: DataFrame | None = None) -> DataFrame:
        """A table as stored, or those of its buckets that ``only(bucket)`` names."""
        if not self.run:
            return self.spark.createDataFrame([], f"{schema}, bucket int")
        held = self.list.where(F.col("name") == name).select("run", "bucket")
        if only is not None:
            held = held.join(only, "bucket", "left_semi")
        if held.isEmpty():
            return self.spark.createDataFrame([], f"{schema}, bucket int")
        files = self.spark.read.schema(f"{schema}, run int, bucket int").parquet(f"{self.path}/{name}")
        files = files.join(F.broadcast(held), ["run", "bucket"])  # at most MAX_RUNS rows a bucket, and one
        if name in ADDED_TO and not self.list.where("name = 'replaced'").isEmpty():
            gone = self.spark.read.schema(f"{REPLACED}, run int, bucket int").parquet(f"{self.path}/replaced")
            gone = gone.join(F.broadcast(self.list.where("name = 'replaced'").select("run", "bucket")), ["run", "bucket"])
            gone = gone.groupBy(F.col("page_id").alias("_id")).agg(F.max("run").alias("_upto"))
            if fx.fits_broadcast(gone, config.BROADCAST_MAX_ROWS):
                gone = F.broadcast(gone)
            files = files.join(gone, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("run") < F.col("_upto")), "left_anti")
        return files.drop("run")

    def read(self, name: str, schema: str, only: DataFrame | None = None) -> DataFrame:
        """A table, or those of its buckets that ``only(bucket)`` names; of
        ``fits`` the pairs."""
        if name == "fits":
            return _pairs(self.rows(name, STORED, only), self.rows("queries", NUMBERED)).select(
                *self.spark.createDataFrame([], schema).columns, "bucket")
        return self.rows(name, schema, only)

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """Write a table's rows under the next run's number, where no list names
        them yet; returns them as written."""
        path = f"{self.path}/{name}/run={self.run + 1}"
        df.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def finish(self, written: dict[str, DataFrame], replaced: dict[str, DataFrame]) -> None:
        """The list of the next run: per table the buckets ``written``, and
        without those ``replaced``, also where no row is left."""
        number, parts = self.run + 1, [self.list.where("name != ''")]
        # A row without a table, so that a run that leaves every table empty is the last run too.
        parts.append(self.spark.range(1).select(F.lit("").alias("name"), F.lit(-1).alias("bucket"), F.lit(number).alias("run")))
        for name, touched in replaced.items():
            parts = [p.join(touched, (F.col("name") == name) & (p["bucket"] == touched["bucket"]), "left_anti") for p in parts]
        for name, df in written.items():
            parts.append(df.select("bucket").distinct().select(F.lit(name).alias("name"), "bucket", F.lit(number).alias("run")))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        out = stage_table(out, "current")
        out.coalesce(1).withColumn("list", F.lit(number)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("list").parquet(f"{self.path}/current")

    def all_buckets(self) -> DataFrame:
        return self.spark.range(self.buckets).select(F.col("id").cast("int").alias("bucket"))

    def scattered(self) -> bool:
        """Whether the rows that count lie in many runs or among many others."""
        if not self.run:
            return False
        held = self.list.where(F.col("name").isin(*ADDED_TO, "replaced"))
        return held.select("run").distinct().count() > MAX_RUNS or \
            2 * self.rows("replaced", REPLACED).count() > self.rows("digests", DIGESTS).count()

    def rewrite(self) -> None:
        """Sections and fits anew, with the rows that count alone, as a run of its own."""
        live = self.rows("queries", NUMBERED).select("batch").distinct()
        every = self.all_buckets()
        written = {"sections": self.put("sections", self.rows("sections", SECTIONS).repartition("bucket")),
                   "fits": self.put("fits", self.rows("fits", STORED).join(F.broadcast(live), "batch", "left_semi").repartition("bucket"))}
        self.finish(written, {n: every for n in (*ADDED_TO, "replaced")})


def _pairs(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """The pairs of stored fit rows with the queries of their batch."""
    norm = entries_norm(term_entries(F.col("query")))
    live = queries.withColumn("_n", norm).groupBy("batch").agg(F.collect_list(F.struct("place", "query_id", "query", "_n")).alias("_live"))
    if fx.fits_broadcast(queries, config.BROADCAST_MAX_ROWS):
        rows = rows.join(F.broadcast(live), "batch")
    else:
        n = fx._fragments(rows, live.count())
        rows = rows.withColumn("_a", F.pmod(F.xxhash64("page_id", "section", "ordinal"), F.lit(n)).cast("int")).join(
            live.withColumn("_a", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))), ["batch", "_a"])
    one = F.transform("_live", lambda q: F.struct(q["query_id"].alias("query_id"), q["query"].alias("query"), cosine_from(
        F.get("dots", q["place"]), F.col("norm"), q["_n"]).alias("raw_score")))
    keys = ["page_id", "section", "ordinal", "bucket", "cut"]
    pairs = rows.select(*keys, F.explode_outer(one).alias("_p")).where("_p is not null").select(*keys, "_p.*")
    return pairs.withColumn("score", F.round("raw_score", 6)).withColumn("verdict", fx.verdict("raw_score", F.col("cut")))


def page_digests(pages: DataFrame) -> DataFrame:
    """``(page_id, digest)``, one row for each id, of all its rows."""
    one = F.sha2(F.to_json(F.struct("url", "html")), 256)
    return pages.groupBy("page_id").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(one)), ""), 256).alias("digest"))


def _other(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``a`` that ``b`` lacks, nulls being equal."""
    there = b.select(*(F.col(c).alias(f"_{c}") for c in keys)).distinct()
    return a.join(there, fx._same(keys, [f"_{c}" for c in keys]), "left_anti")


def _fits(sections: DataFrame, queries: DataFrame, cut: float) -> DataFrame:
    """The fits from nothing, which those kept up to date equal."""
    distinct = queries.select("query_id", "query", F.col("query").alias("_text"))
    keys = ["page_id", "section", "ordinal"]
    pairs = fx.lexical_all_pairs(sections.select(*keys, "text"), "text", distinct, "_text", ["query_id", "query"], cut=cut, raw_col="raw_score")
    return pairs.select(*keys, "query_id", "query", "raw_score", "score", "verdict")


def _numbered(queries: DataFrame, run: int) -> DataFrame:
    """New queries with batch and place; a batch is within the broadcast bounds."""
    blocks = fx._text_blocks(queries, ["query_id", "query"], "query", config.BROADCAST_MAX_ROWS)
    batch = F.lit(run * BATCHES) + F.pmod(F.xxhash64("query_id", "query"), F.lit(blocks))
    place = F.row_number().over(Window.partitionBy("batch").orderBy("query_id", "query")) - 1
    return queries.withColumn("batch", batch.cast("long")).withColumn("place", place.cast("int"))


def _stored(sections: DataFrame, queries: DataFrame, cut: float) -> DataFrame:
    """Fit rows as stored of sections with every batch of ``queries``."""
    keys = ["page_id", "section", "ordinal", "bucket"]
    whole = fx._text_blocks(queries, ["batch", "place"], "query", config.BROADCAST_MAX_ROWS) == 1
    dots = placed_products(sections, keys, "text", queries, "query", whole, fx._fragments(sections, 1))
    return dots.withColumn("cut", F.lit(float(cut)))


def _with_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the pages that ``ids(_id)`` names."""
    ids = F.broadcast(ids) if fx.fits_broadcast(ids, config.BROADCAST_MAX_ROWS) else ids
    return df.join(ids, F.col("page_id").eqNullSafe(F.col("_id")), "left_semi")


def update_fits(spark: SparkSession, pages: DataFrame, queries: DataFrame, path: str, cut: float = config.VERDICT_CUT,
                buckets: int = BUCKETS) -> dict[str, int]:
    """Bring the tables under ``path`` up to ``pages(page_id, url, html)`` and
    ``queries(query_id, query)``; returns how many pages were parsed and gone,
    queries new and gone, and pairs scored.  ``Tables(...).read("fits", FITS)``
    is the result."""
    tables = Tables(spark, path, buckets)
    if tables.scattered():
        tables.rewrite()
        tables = Tables(spark, path, buckets)
    now = stage_table(page_digests(pages.select("page_id", "url", "html")).withColumn("bucket", bucket_of("page_id", buckets)), "digests")
    before = tables.read("digests", DIGESTS)
    changed = stage_table(_other(now, before, ["page_id", "digest"]).select("page_id", "bucket"), "changed-pages")
    gone = stage_table(_other(before, now, ["page_id"]).select("page_id", "bucket"), "gone-pages")
    queries = stage_table(queries.select(F.col("query_id").cast("long").alias("query_id"), "query").distinct(), "queries")
    had = tables.read("queries", NUMBERED).drop("bucket")
    fresh = stage_table(_numbered(_other(queries, had, ["query_id", "query"]), tables.run + 1), "new-queries")
    gone_queries = _other(had, queries, ["query_id", "query"])
    counts = {"pages_parsed": changed.count(), "pages_gone": gone.count(), "queries_new": fresh.count(),
              "queries_gone": gone_queries.count()}
    live = stage_table(_other(had, gone_queries, ["query_id", "query"]).unionByName(fresh), "live-queries")

    touched = changed.select("bucket").union(gone.select("bucket")).distinct()
    # Changed pages alone are parsed; of those and the gone ones, earlier rows no longer count.
    wanted = changed.select(F.col("page_id").alias("_id"))
    parsed = pages if counts["pages_parsed"] == now.count() else _with_ids(pages, wanted)
    parsed = sx.page_sections(parsed).select("page_id", "section", "ordinal", "text").withColumn("bucket", bucket_of("page_id", buckets))
    replaced = stage_table(_with_ids(changed, before.select(F.col("page_id").alias("_id"))).unionByName(gone), "replaced-pages")
    digests = _other(tables.read("digests", DIGESTS, touched), replaced, ["page_id"]).unionByName(_with_ids(now, wanted))

    # Rows are dealt by bucket once, before they are scored; fits are written where they are made.
    written = {"digests": tables.put("digests", digests.repartition("bucket")), "replaced": tables.put("replaced", replaced.repartition("bucket")),
               "sections": tables.put("sections", parsed.repartition("bucket")),
               "queries": tables.put("queries", live.withColumn("bucket", F.lit(0)).coalesce(1))}
    scored = _stored(written["sections"], live, cut)
    if counts["queries_new"] and tables.run:
        rest = _other(tables.read("sections", SECTIONS), replaced, ["page_id"])
        scored = scored.unionByName(_stored(rest, fresh, cut))
    written["fits"] = tables.put("fits", scored)
    sizes = live.groupBy("batch").agg(F.count(F.lit(1)).alias("size"))
    pairs = written["fits"].groupBy("batch").agg(F.count(F.lit(1)).alias("rows")).join(sizes, "batch")
    counts["pairs_scored"] = pairs.agg(F.sum(F.col("rows") * F.col("size"))).first()[0] or 0
    tables.finish(written, {"digests": touched, "queries": tables.all_buckets().where("bucket = 0")})
    return counts
