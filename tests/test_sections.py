"""Section extraction on the page fixture (tags the driver pages lack)."""

from contentfit.operators import sections as sx

URL = "https://m.x.org/a"
HTML = """<html><head><title> T  one </title><meta name="description" content="D"></head><body>
<h2> A </h2><h3></h3><h4>z</h4>
<strong>s</strong><b>t</b><em>e</em>
<img alt="p"><img alt=" "><img>
<table></table><table><tr><td>c</td></tr></table>
<ol><li>x</li></ol><ul><li>y</li></ul>
<p>one<p>two</p>
<a href="/b">in</a><a href="https://blog.m.x.org/">sub</a><a href="https://notm.x.org/">sub2</a>
<a href="https://x.org/">out</a><a href="mailto:a@b">mail</a><a>no href</a>
<script>var s = "<p>hidden</p>";</script><!-- <p>comment</p> -->
</body></html>"""


def _pages(spark, html=HTML):
    return spark.createDataFrame([(1, URL, html)], "page_id long, url string, html string")


def test_page_arrays(spark):
    r = sx.page_arrays(_pages(spark)).first()
    assert r.title == "T one"
    assert r.meta_description == "D"
    assert r.h2 == ["A"] and r.h3 == []
    assert r.strong == ["s"] and r.em == ["e"]
    assert r.img_alt == ["p", ""]
    assert r.table == ["c"]
    assert r.li == ["y", "x"]          # every ul item before every ol item
    assert r.p == ["one", "two"]       # implied end of the open paragraph


def test_meta_absent(spark):
    r = sx.page_arrays(_pages(spark, "<html><head><title>x</title></head></html>")).first()
    assert r.meta_description == ""


def test_links(spark):
    rows = {(r.text, r.url, r.link_class) for r in sx.page_links(_pages(spark)).collect()}
    assert ("in", "https://m.x.org/b", "internal") in rows
    assert ("sub", "https://blog.m.x.org/", "internal") in rows
    assert ("sub2", "https://notm.x.org/", "internal") in rows      # substring rule
    assert ("out", "https://x.org/", "external") in rows
    assert ("mail", "mailto:a@b", "external") in rows
    assert all(t != "no href" for t, _, _ in rows)


def test_sections_and_counts(spark):
    secs = sx.page_sections(_pages(spark)).collect()
    assert {(r.section, r.ordinal, r.text) for r in secs if r.section == "p"} == {("p", 1, "one"), ("p", 2, "two")}
    counts = {r.section: r.n for r in sx.section_counts(_pages(spark)).collect()}
    assert counts["link_internal"] == 3 and counts["link_external"] == 2 and counts["h2"] == 1


def test_record_round_trip(spark):
    pages = _pages(spark)
    a = sorted(tuple(r) for r in sx.page_sections(pages).drop("url").collect())
    b = sorted(tuple(r) for r in sx.record_to_sections(sx.page_record(pages)).drop("url").collect())
    assert a == b


def test_driver_pages_smoke(spark):
    from contentfit.sources.tables import read_table
    pages = read_table(spark, "/root/testdata/sf0.001", "pages", ["page_id", "url", "html"])
    n_pages = pages.count()
    h1 = sx.page_sections(pages, kinds=("h1",)).count()
    assert h1 == n_pages


def test_single_page_filter(spark):
    pages = spark.createDataFrame([(1, URL, HTML), (2, "https://other.org/", "<h1>x</h1>")],
                                  "page_id long, url string, html string")
    ids = {r.page_id for r in sx.page_sections(pages, url="  " + URL + " ").collect()}
    assert ids == {1}


def test_dot_segments_folded(spark):
    from pyspark.sql import functions as F
    base = "https://m.x.org/a/b/c"
    cases = {"../d": "https://m.x.org/a/d", "./x": "https://m.x.org/a/b/x", "../../..": "https://m.x.org/",
             "a/./b/": "https://m.x.org/a/b/a/b/", "/p/../q?z=1#f": "https://m.x.org/q?z=1#f",
             "x/..": "https://m.x.org/a/b/", "..": "https://m.x.org/a/", ".": "https://m.x.org/a/b/",
             "mailto:a/../b": "mailto:a/../b", "https://o.org/k/./l": "https://o.org/k/l"}
    df = spark.createDataFrame([(h,) for h in cases], "h string")
    got = {r.h: r.u for r in df.select("h", sx.resolve_href(F.lit(base), F.col("h")).alias("u")).collect()}
    assert got == cases
