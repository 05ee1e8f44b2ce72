"""Section extraction from crawled pages.

:mod:`contentfit.operators.html_tree` parses each page once, inside the task;
sections, links, counts and the nested page record are projections of that
one row per page, so ``pages`` is scanned once and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contentfit.operators.html_tree import TEXT_TAGS, parse_pages

# --- fixed values: URL patterns ----------------------------------------------
SCHEME_RE = r"^([a-zA-Z][a-zA-Z0-9+.-]*):"
NETLOC_RE = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)"
PATH_RE = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)"

SECTION_KINDS = ("h1", "h2", "h3", "p", "div", "li")
TEXT_KINDS = TEXT_TAGS
COUNT_KINDS = ("h1", "h2", "h3", "p", "div", "li", "strong", "em", "table", "img_alt",
               "link_internal", "link_external")

SECTIONS_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("section", T.StringType()),
    T.StructField("ordinal", T.IntegerType()),
    T.StructField("text", T.StringType()),
])


def netloc(url) -> Column:
    """Network location (keeps user info and port, like urlparse)."""
    u = F.col(url) if isinstance(url, str) else url
    return F.regexp_extract(u, NETLOC_RE, 1)


DOT_SEGMENT_RE = r"(^|/)\.\.?(/|$)"


def fold_dot_segments(url: Column) -> Column:
    """Remove ``.`` and ``..`` path segments of an http(s) URL, as a browser
    does when it resolves an href (RFC 3986 remove_dot_segments).  Paths hold
    a handful of segments, so the per-URL fold is cheap."""
    path = F.regexp_extract(url, PATH_RE, 1)
    prefix = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    rest = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*[^?#]*(.*)$", 1)
    segs = F.slice(F.split(path, "/"), 2, F.greatest(F.size(F.split(path, "/")), F.lit(1)))
    stack = F.aggregate(segs, F.array().cast("array<string>"), lambda acc, x: (
        F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
         .when(x == ".", acc).otherwise(F.concat(acc, F.array(x)))))
    last = F.element_at(segs, -1)
    folded = F.concat(prefix, F.lit("/"), F.array_join(stack, "/"),
                      F.when(last.isin(".", "..") & (F.size(stack) > 0), F.lit("/")).otherwise(F.lit("")), rest)
    special = F.lower(F.regexp_extract(url, SCHEME_RE, 1)).isin("http", "https")
    return F.when(special & path.rlike(DOT_SEGMENT_RE), folded).otherwise(url)


def resolve_href(page_url: Column, href: Column) -> Column:
    """Resolve an href against the page URL (absolute, //, /, #, ?, and
    relative forms), then fold dot segments of http(s) paths."""
    return fold_dot_segments(_join_href(page_url, href))


def _join_href(page_url: Column, href: Column) -> Column:
    scheme = F.regexp_extract(page_url, SCHEME_RE, 1)
    origin = F.concat(scheme, F.lit("://"), netloc(page_url))
    path = F.regexp_extract(page_url, PATH_RE, 1)
    base_dir = F.concat(origin, F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, r"^(.*/)", 1)))
    return (F.when(href.rlike(SCHEME_RE), href)
             .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
             .when(href.startswith("/"), F.concat(origin, href))
             .when(href.startswith("#"), F.concat(F.regexp_replace(page_url, "#.*$", ""), href))
             .when(href.startswith("?"), F.concat(F.regexp_replace(page_url, "[?#].*$", ""), href))
             .when(href == "", F.regexp_replace(page_url, "#.*$", ""))
             .otherwise(F.concat(base_dir, href)))


def page_arrays(pages: DataFrame) -> DataFrame:
    """Every tag's texts for each page, one row per page, map-only.

    Columns: page_id, url, netloc, title, meta_description, h1, h2, h3, p,
    div, li, strong, em, table, img_alt (arrays of string) and links
    (array<struct<text,url,internal>>).  A link of a page without a URL keeps
    its href and is external.
    """
    arr = parse_pages(pages).withColumn("netloc", netloc(F.col("url")))
    url = F.col("url")
    links = F.transform("links_raw", lambda l: F.struct(
        l["text"].alias("text"), F.coalesce(resolve_href(url, l["href"]), l["href"]).alias("url")))
    return (arr.withColumn("links", links)
            .withColumn("links", F.transform("links", lambda l: F.struct(
                l["text"].alias("text"), l["url"].alias("url"),
                F.coalesce(netloc(l["url"]).contains(F.col("netloc")), F.lit(False)).alias("internal"))))
            .drop("links_raw"))


def _kind_items(kind: str) -> Column:
    return F.transform(F.col(kind), lambda x, i: F.struct(
        F.lit(kind).alias("section"), (i + 1).alias("ordinal"), x.alias("text")))


def page_sections(pages: DataFrame, kinds=SECTION_KINDS, url: str | None = None) -> DataFrame:
    """Long form ``(page_id, url, section, ordinal, text)``.

    ``url`` (trimmed) picks one page; the default is every page.
    """
    if url is not None:
        pages = pages.where(F.col("url") == url.strip())
    return sections_of(page_arrays(pages), kinds)


def sections_of(arr: DataFrame, kinds=SECTION_KINDS) -> DataFrame:
    """The long form of parsed pages (``page_arrays``)."""
    items = F.concat(*[_kind_items(k) for k in kinds])
    # explode_outer + filter: see fit._exploded_entries (no inferred filter
    # that would re-run the page parsing).
    return (arr.select("page_id", "url", F.explode_outer(items).alias("s")).where(F.col("s").isNotNull())
               .select("page_id", "url", F.col("s.section").alias("section"),
                       F.col("s.ordinal").cast("int").alias("ordinal"),
                       F.col("s.text").alias("text")))


def page_titles(pages: DataFrame) -> DataFrame:
    """H1: one row per page."""
    return page_arrays(pages).select("page_id", "url", "title")


def page_meta(pages: DataFrame) -> DataFrame:
    """H2: meta description, "" when the tag or its content is missing."""
    return page_arrays(pages).select("page_id", "meta_description")


def page_links(pages: DataFrame) -> DataFrame:
    """One row per link with an href, classed internal/external by
    substring test of the page's network location."""
    arr = page_arrays(pages)
    return (arr.select("page_id", F.posexplode_outer("links").alias("pos", "l")).where(F.col("l").isNotNull())
               .select("page_id", (F.col("pos") + 1).cast("int").alias("ordinal"),
                       F.when(F.col("l.internal"), F.lit("internal")).otherwise(F.lit("external")).alias("link_class"),
                       F.col("l.text").alias("text"), F.col("l.url").alias("url")))


def section_counts(pages: DataFrame) -> DataFrame:
    """Extraction counts per page and tag (zeros kept), computed from
    array sizes in the same pass: no explode, no shuffle."""
    arr = page_arrays(pages)
    sizes = [F.struct(F.lit(k).alias("section"), F.size(F.col(k)).cast("long").alias("n"))
             for k in COUNT_KINDS if not k.startswith("link_")]
    sizes.append(F.struct(F.lit("link_internal").alias("section"),
                          F.size(F.filter("links", lambda l: l["internal"])).cast("long").alias("n")))
    sizes.append(F.struct(F.lit("link_external").alias("section"),
                          F.size(F.filter("links", lambda l: ~l["internal"])).cast("long").alias("n")))
    return (arr.select("page_id", F.explode_outer(F.array(*sizes)).alias("c")).where(F.col("c").isNotNull())
               .select("page_id", F.col("c.section").alias("section"), F.col("c.n").alias("n")))


def page_record(pages: DataFrame) -> DataFrame:
    """The nested page record of the reference, one row per page."""
    arr = page_arrays(pages)
    link = lambda inner: F.transform(
        F.filter("links", lambda l: l["internal"] if inner else ~l["internal"]),
        lambda l: F.struct(l["text"].alias("text"), l["url"].alias("url")))
    return arr.select(
        "page_id", "url", "title", "meta_description",
        F.struct(F.col("h1"), F.col("h2"), F.col("h3")).alias("headings"),
        F.col("p").alias("paragraphs"), F.col("div").alias("div_texts"),
        F.col("li").alias("lists"), F.col("table").alias("tables"),
        F.struct(F.col("strong"), F.col("em")).alias("emphasis"),
        F.col("img_alt").alias("images_alt"),
        F.struct(link(True).alias("internal"), link(False).alias("external")).alias("links"))


def page_record_rows(pages: DataFrame) -> DataFrame:
    """H14 in long form: ``(page_id, field, ordinal, text, url)`` for every
    value of the record; ``url`` is set for links."""
    rec = page_record(pages)
    none = F.lit(None).cast("string")

    def items(field: str, arr: Column, is_link: bool = False) -> Column:
        return F.transform(arr, lambda x, i: F.struct(
            F.lit(field).alias("field"), (i + 1).cast("int").alias("ordinal"),
            (x["text"] if is_link else x).alias("text"), (x["url"] if is_link else none).alias("url")))

    fields = [("title", F.array("title")), ("meta_description", F.array("meta_description")),
              ("h1", F.col("headings.h1")), ("h2", F.col("headings.h2")), ("h3", F.col("headings.h3")),
              ("paragraphs", F.col("paragraphs")), ("div_texts", F.col("div_texts")), ("lists", F.col("lists")),
              ("tables", F.col("tables")), ("strong", F.col("emphasis.strong")), ("em", F.col("emphasis.em")),
              ("images_alt", F.col("images_alt"))]
    values = [items(name, arr) for name, arr in fields]
    values += [items(f"links_{kind}", F.col(f"links.{kind}"), True) for kind in ("internal", "external")]
    return rec.select("page_id", F.explode(F.concat(*values)).alias("v")).select("page_id", "v.*")


def record_to_sections(record: DataFrame) -> DataFrame:
    """Inverse of :func:`page_record` for the scored tags (explode)."""
    flat = record.select(
        "page_id", "url",
        F.col("headings.h1").alias("h1"), F.col("headings.h2").alias("h2"),
        F.col("headings.h3").alias("h3"), F.col("paragraphs").alias("p"),
        F.col("div_texts").alias("div"), F.col("lists").alias("li"))
    items = F.concat(*[_kind_items(k) for k in SECTION_KINDS])
    return (flat.select("page_id", "url", F.explode_outer(items).alias("s")).where(F.col("s").isNotNull())
                .select("page_id", "url", "s.section", F.col("s.ordinal").cast("int").alias("ordinal"), "s.text"))
