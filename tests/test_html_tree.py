"""Page parser: nesting, implied ends, attributes and references."""

from contentfit.operators.html_tree import TEXT_TAGS, parse_page


def rows(html):
    page = parse_page(html)
    return [(t, x) for t in TEXT_TAGS for x in page[t]]


def test_nested_divs_repeat_inner_text():
    assert rows("<div>o<div>i</div></div>") == [("div", "o i"), ("div", "i")]
    assert rows("<div>o<div>i</div>tail</div>") == [("div", "o i tail"), ("div", "i")]


def test_nested_lists_once_per_enclosing_list():
    assert rows("<ul><li>a<ul><li>b</li></ul></li></ul>") == [("li", "a b"), ("li", "b"), ("li", "b")]


def test_unclosed_items():
    assert rows("<ul><li>a<li>b</ul>") == [("li", "a"), ("li", "b")]
    assert rows("<ul><li>a<ol><li>b<li>c</ol><li>d") == [("li", x) for x in ("a b c", "b", "c", "d", "b", "c")]


def test_ul_before_ol():
    assert rows("<ol><li>x</li></ol><ul><li>y</li></ul>") == [("li", "y"), ("li", "x")]


def test_table_and_emphasis():
    assert rows("<table></table><table><tr><td>c</td></tr></table>") == [("table", "c")]
    assert rows("<table><tr><td>a<table><tr><td>b</table>c</table>") == [("table", "a b c"), ("table", "b")]
    assert rows("<strong>s</strong><b>t</b><em>e</em>") == [("strong", "s"), ("em", "e")]


def test_open_paragraphs_and_scripts():
    assert rows('<p><b>one<br><p>two</p><script>var t="</p>"</script>') == [("p", "one"), ("p", "two")]


def test_an_inline_end_does_not_close_blocks():
    assert rows("<b><div>x</b>y</div>") == [("div", "xy")]


def test_headings_h4_not_read():
    assert rows("<h2> A </h2><h3></h3><h4>z</h4>") == [("h2", "A")]


def test_links_and_alternatives_of_any_quoting():
    page = parse_page("<a href='/s'>one</a><a href=/u>two</a><a href=\"/v\">th<i>ree</i></a><a>no</a><a href=''>self</a>"
                      "<img alt='a b'><img alt=c><img alt=\" d \"><img alt=''><img>")
    assert [(x["text"], x["href"]) for x in page["links_raw"]] == [("one", "/s"), ("two", "/u"), ("three", "/v"), ("self", "")]
    assert page["img_alt"] == ["a b", "c", "d"]


def test_references():
    assert rows("<p>&uuml;r&uuml;n &#351;u &#x41; &amp;lt; &nbsp; x") == [("p", "\u00fcr\u00fcn \u015fu A &lt; x")]


def test_title_and_description():
    page = parse_page("<title> A &amp; B\n c</title><meta name=keywords content=k><meta content='x &gt; y' name=description>"
                      "<meta name=description content=second><svg><title>icon</title></svg>")
    assert page["title"] == "A & B c" and page["meta_description"] == "x > y"
    assert parse_page("<meta name=description>")["meta_description"] == "" and parse_page("x")["title"] == ""


def test_deep_nesting_and_no_html():
    page = parse_page("<div>" * 1_200 + "x" + "</div>" * 1_200)
    assert page["div"] == ["x"] * 1_200
    assert rows(None) == rows("") == []


def test_null_url_and_html(spark):
    from contentfit.operators import sections as sx
    pages = spark.createDataFrame([(1, None, "<a href='/x'>t</a>"), (2, "http://h/", None)], "page_id long, url string, html string")
    rows = {r["page_id"]: r for r in sx.page_arrays(pages).collect()}
    assert [tuple(x) for x in rows[1]["links"]] == [("t", "/x", False)] and rows[2]["links"] == [] and rows[2]["title"] == ""
