"""One pass over a page's HTML: title, description, texts of every tag, image
alternatives and links.

A page is parsed by the standard library's ``html.parser`` inside the task;
only ``page_id, url, html`` cross into Python.  The pass keeps a stack of open
elements and one list of text pieces; an element's text is the pieces from its
start to its end, so text is gathered once and nesting needs no recursion.
Elements that HTML closes by implication (``li``, ``p``), unclosed ones, any
attribute quoting and all character references come out as in a browser's
document: an outer div's text repeats its inner divs' (H5), a list item is
emitted once per enclosing list, every ul before every ol (H7), and a
table's text is that of all its cells (H8).
"""

from __future__ import annotations

import sys
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from contentfit.functions.text import INLINE_TAGS

# --- fixed values ------------------------------------------------------------
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track",
        "wbr"}
# Start tags that close an open paragraph (HTML5 implied end tags).
P_CLOSERS = {"address", "article", "aside", "blockquote", "div", "dl", "dd", "dt", "fieldset", "figcaption",
             "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav",
             "ol", "p", "pre", "section", "table", "ul"}
SKIP = {"script", "style", "template", "noscript"}
TEXT_TAGS = ("h1", "h2", "h3", "p", "div", "li", "strong", "em", "table")

_INLINE = set(INLINE_TAGS)
_FLUSH_BYTES = 4 << 20
_LINK = pa.struct([("text", pa.string()), ("href", pa.string())])
_COLUMNS = ("title", "meta_description", *TEXT_TAGS, "img_alt", "links_raw")
SCHEMA = ("page_id long, url string, title string, meta_description string, "
          + ", ".join(f"`{t}` array<string>" for t in TEXT_TAGS)
          + ", img_alt array<string>, links_raw array<struct<text: string, href: string>>")


class _Open:
    """An open element: where its text starts, and who gets it at the end."""

    __slots__ = ("tag", "start", "slot", "items")

    def __init__(self, tag, start, slot, items):
        self.tag, self.start, self.slot, self.items = tag, start, slot, items


class PageParser(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.open: list[_Open] = []
        self.texts: dict[str, list[list]] = {t: [] for t in TEXT_TAGS}
        self.lists: dict[str, list[list]] = {"ul": [], "ol": []}
        self.title, self.in_title = None, False
        self.meta = None
        self.alts: list[str] = []
        self.links: list[tuple[str, list]] = []
        self.skipped, self.skip_depth = None, 0

    def _end(self):
        e = self.open.pop()
        if e.slot is not None:
            e.slot[0] = " ".join("".join(self.pieces[e.start:]).split())
        if e.tag not in _INLINE:
            self.pieces.append(" ")

    def _end_to(self, tag):
        """Close ``tag`` and what is open inside it.  The end of an inline
        element doesn't close blocks that began inside it."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag == tag:
                while len(self.open) > i:
                    self._end()
                return
            if tag in _INLINE and self.open[i].tag not in _INLINE:
                return

    def _imply_ends(self, tag):
        if tag in P_CLOSERS and any(e.tag == "p" for e in self.open):
            self._end_to("p")
        if tag == "li":
            for e in reversed(self.open):
                if e.tag in ("ul", "ol"):
                    break
                if e.tag == "li":
                    self._end_to("li")
                    break

    def handle_starttag(self, tag, attrs):
        if self.skipped:
            self.skip_depth += tag == self.skipped
            return
        if tag in SKIP:
            self.skipped, self.skip_depth = tag, 1
            return
        if tag == "title":
            self.in_title = True
            self.title = [] if self.title is None else self.title + [None]  # only the first title counts
            return
        self._imply_ends(tag)
        if tag not in _INLINE:
            self.pieces.append(" ")
        values = dict(reversed(attrs)) if attrs else {}  # of a repeated attribute the first holds
        if tag == "meta" and self.meta is None and values.get("name") == "description":
            self.meta = values.get("content") or ""
        elif tag == "img" and values.get("alt"):
            self.alts.append(values["alt"].strip())
        if tag in VOID:
            return
        slot = [""] if tag in self.texts or tag == "a" and "href" in values else None
        if tag == "a" and slot is not None:
            self.links.append((values["href"] or "", slot))
        items = None
        if tag in self.texts:
            self.texts[tag].append(slot)
        if tag == "li":
            for e in self.open:
                if e.items is not None:
                    e.items.append(slot)
        elif tag in self.lists:
            items = []
            self.lists[tag].append(items)
        self.open.append(_Open(tag, len(self.pieces), slot, items))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # the slash means nothing in HTML, but for void elements

    def handle_endtag(self, tag):
        if self.skipped:
            self.skip_depth -= tag == self.skipped
            if not self.skip_depth:
                self.skipped = None
        elif tag == "title":
            self.in_title = False
        else:
            self._end_to(tag)

    def handle_data(self, data):
        if self.skipped:
            return
        if self.in_title:
            if None not in self.title:
                self.title.append(data)
        else:
            self.pieces.append(data)

    def finish(self) -> dict:
        self.close()
        while self.open:
            self._end()
        texts = {t: [s[0] for s in slots if s[0]] for t, slots in self.texts.items()}
        texts["li"] = [s[0] for t in ("ul", "ol") for items in self.lists[t] for s in items if s[0]]
        title = [t for t in self.title or [] if t is not None]
        return texts | {"title": " ".join("".join(title).split()), "meta_description": self.meta or "",
                        "img_alt": self.alts, "links_raw": [{"text": s[0], "href": h} for h, s in self.links]}


def parse_page(html: str | None) -> dict:
    """Everything that is read of a page, by column name."""
    parser = PageParser()
    parser.feed(html or "")
    return parser.finish()


def parse_pages(pages: DataFrame) -> DataFrame:
    """One row per page with the columns of ``SCHEMA``.  A null html is an
    empty page; tags with empty text are dropped.

    Output is yielded every few megabytes of html, so a task holds a few pages'
    rows and not a whole input batch's.  The parser is shipped by value, so
    executors need not have this package.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    kinds = {"title": pa.string(), "meta_description": pa.string(), "links_raw": pa.list_(_LINK)}

    def rows(batch, lo, hi, parsed):
        return pa.RecordBatch.from_arrays(
            [batch.column(0)[lo:hi], batch.column(1)[lo:hi],
             *(pa.array([p[c] for p in parsed], kinds.get(c, pa.list_(pa.string()))) for c in _COLUMNS)],
            names=["page_id", "url", *_COLUMNS])

    def run(batches):
        for batch in batches:
            lo, size, parsed = 0, 0, []
            for i in range(batch.num_rows):
                html = batch.column(2)[i].as_py()
                parsed.append(parse_page(html))
                size += len(html or "")
                if size > _FLUSH_BYTES:
                    yield rows(batch, lo, i + 1, parsed)
                    lo, size, parsed = i + 1, 0, []
            yield rows(batch, lo, batch.num_rows, parsed)

    return pages.selectExpr("cast(page_id as long) as page_id", "cast(url as string) as url", "html").mapInArrow(run, SCHEMA)
