"""SQL building blocks of the oracle queries.

Written apart from the implementation: patterns and character references are
spelled out here, and pages are read with regular expressions, which do for
the flat markup of the driver pages, where the implementation walks elements.
"""

from __future__ import annotations

# --- fixed values: patterns of flat HTML, URLs and words -----------------------
WS_CLASS = r"[\t\n\x0B\f\r\x1C-\x1F\x85 \p{Z}]"
GAP = r"[\t\n\f\r ]"
TITLE_RE = rf"(?is)<title(?:{GAP}[^>]*)?>(.*?)</title{GAP}*>"
META_RE = rf"(?is)<meta{GAP}(?:[^>]*{GAP})?name{GAP}*={GAP}*[\"']?description[\"']?(?:{GAP}[^>]*)?/?>"
CONTENT_RE = rf"(?is){GAP}content{GAP}*={GAP}*\"([^\"]*)\""
P_RE = rf"(?i)<p(?:{GAP}[^>]*)?>"
P_END_RE = (r"(?is)</?(?:address|article|aside|blockquote|body|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|"
            r"h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)[\t\n\f\r />].*$")
LINK_RE = rf"(?is)<a{GAP}(?:[^>]*?{GAP})?href{GAP}*={GAP}*\"([^\"]*)\"[^>]*>(.*?)</a{GAP}*>"
ALT_RE = rf"(?is)<img{GAP}(?:[^>]*?{GAP})?alt{GAP}*={GAP}*\"([^\"]*)\""
HIDDEN_RES = (r"(?s)<!--.*?-->", rf"(?is)<script(?:{GAP}[^>]*)?>.*?</script{GAP}*>", rf"(?is)<style(?:{GAP}[^>]*)?>.*?</style{GAP}*>")
JOINING_RE = (r"(?i)</?(?:a|abbr|b|bdi|bdo|cite|code|data|dfn|em|font|i|kbd|mark|q|s|samp|small|span|strong|sub|sup|time|"
              r"tt|u|var)(?:[\t\n\f\r /][^>]*)?>")
TAG_RE = r"</?[a-zA-Z][^>]*>"
REFERENCES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
              ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&amp;", "&"))
SCHEME_RE = r"^([a-zA-Z][a-zA-Z0-9+.-]*):"
HOST_RE = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)"
PATH_RE = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)"
DOTS_RE = r"(^|/)\.\.?(/|$)"
TOKEN_RE = r"[\p{L}\p{N}]+"
SCORED_KINDS = ("h1", "h2", "h3", "p", "div", "li")
ALL_KINDS = (*SCORED_KINDS, "strong", "em", "table")


def element_re(tag: str) -> str:
    return rf"(?is)<{tag}(?:{GAP}[^>]*)?>(.*?)</{tag}{GAP}*>"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx_replace(x: str, pattern: str, repl: str = "") -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(repl)}, 'g')"


def normalize_ws(x: str) -> str:
    return f"trim({rx_replace(x, WS_CLASS + '+', ' ')})"


def strip_ws(x: str) -> str:
    return rx_replace(x, "^" + WS_CLASS + "+|" + WS_CLASS + "+$", "")


def decode_entities(x: str) -> str:
    for ent, ch in REFERENCES:
        x = f"replace({x}, {lit(ent)}, {lit(ch)})"
    return x


def html_text(x: str) -> str:
    c = rx_replace(x, JOINING_RE, "")
    c = rx_replace(c, TAG_RE, " ")
    return normalize_ws(decode_entities(c))


def raw_text(x: str) -> str:
    return normalize_ws(decode_entities(x))


def strip_scripts(x: str) -> str:
    for pattern in HIDDEN_RES:
        x = rx_replace(x, pattern)
    return x


def texts(arr: str) -> str:
    return f"list_filter(list_transform({arr}, lambda x: {html_text('x')}), lambda x: x <> '')"


def extract_all(x: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract_all({x}, {lit(pattern)}, {group})"


def netloc(x: str) -> str:
    return f"regexp_extract({x}, {lit(HOST_RE)}, 1)"


def fold_dot_segments(u: str) -> str:
    path = f"regexp_extract({u}, {lit(PATH_RE)}, 1)"
    prefix = f"regexp_extract({u}, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1)"
    rest = f"regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*[^?#]*(.*)$', 1)"
    segs = f"string_split({path}, '/')[2:]"
    stack = (f"list_reduce({segs}, lambda acc, x: CASE WHEN x = '..' THEN acc[1:len(acc) - 1] "
             f"WHEN x = '.' THEN acc ELSE list_append(acc, x) END, []::VARCHAR[])")
    last = f"({segs})[-1]"
    folded = (f"{prefix} || '/' || array_to_string({stack}, '/') || "
              f"CASE WHEN {last} IN ('.', '..') AND len({stack}) > 0 THEN '/' ELSE '' END || {rest}")
    special = f"lower(regexp_extract({u}, {lit(SCHEME_RE)}, 1)) IN ('http', 'https')"
    return f"CASE WHEN {special} AND regexp_matches({path}, {lit(DOTS_RE)}) THEN {folded} ELSE {u} END"


def resolve_href(url: str, h: str) -> str:
    return fold_dot_segments(_join_href(url, h))


def _join_href(url: str, h: str) -> str:
    scheme = f"regexp_extract({url}, {lit(SCHEME_RE)}, 1)"
    origin = f"({scheme} || '://' || {netloc(url)})"
    path = f"regexp_extract({url}, {lit(PATH_RE)}, 1)"
    base_dir = f"({origin} || CASE WHEN {path} = '' THEN '/' ELSE regexp_extract({path}, '^(.*/)', 1) END)"
    return (f"CASE WHEN regexp_matches({h}, {lit(SCHEME_RE)}) THEN {h} "
            f"WHEN starts_with({h}, '//') THEN {scheme} || ':' || {h} "
            f"WHEN starts_with({h}, '/') THEN {origin} || {h} "
            f"WHEN starts_with({h}, '#') THEN regexp_replace({url}, '#.*$', '') || {h} "
            f"WHEN starts_with({h}, '?') THEN regexp_replace({url}, '[?#].*$', '') || {h} "
            f"WHEN {h} = '' THEN regexp_replace({url}, '#.*$', '') "
            f"ELSE {base_dir} || {h} END")


def page_arrays_cte(source: str = "pages") -> str:
    """CTE ``pa``: per page, the same arrays as ``sections.page_arrays``
    (links as parallel ``hrefs`` / ``inners`` lists)."""
    body = "body"
    meta_tag = f"regexp_extract({body}, {lit(META_RE)}, 0)"
    meta = f"regexp_extract({meta_tag}, {lit(CONTENT_RE)}, 1)"
    p_frag = (f"list_transform(regexp_split_to_array({body}, {lit(P_RE)})[2:], "
              f"lambda x: {rx_replace('x', P_END_RE, '')})")
    li_of = lambda tag: (f"flatten(list_transform({extract_all(body, element_re(tag))}, "  # noqa: E731
                         f"lambda b: {extract_all('b', element_re('li'))}))")
    alts = f"list_filter({extract_all(body, ALT_RE)}, lambda a: a <> '')"
    return f"""pa_src AS (
  SELECT page_id, url, {strip_scripts('html')} AS body FROM {source}
), pa AS (
  SELECT page_id, url, {netloc('url')} AS netloc,
    {raw_text(f"regexp_extract({body}, {lit(TITLE_RE)}, 1)")} AS title,
    {decode_entities(meta)} AS meta_description,
    {texts(extract_all(body, element_re('h1')))} AS h1,
    {texts(extract_all(body, element_re('h2')))} AS h2,
    {texts(extract_all(body, element_re('h3')))} AS h3,
    {texts(p_frag)} AS p,
    {texts(extract_all(body, element_re('div')))} AS div,
    {texts(f"list_concat({li_of('ul')}, {li_of('ol')})")} AS li,
    {texts(extract_all(body, element_re('strong')))} AS strong,
    {texts(extract_all(body, element_re('em')))} AS em,
    {texts(extract_all(body, element_re('table')))} AS "table",
    list_transform({alts}, lambda a: {strip_ws(decode_entities('a'))}) AS img_alt,
    {extract_all(body, LINK_RE, 1)} AS hrefs,
    {extract_all(body, LINK_RE, 2)} AS inners
  FROM pa_src
)"""


def sections_cte(kinds=SCORED_KINDS, name: str = "sec") -> str:
    """CTE ``sec`` (after ``pa``): long-form sections."""
    items = ", ".join(
        f"list_transform({k if k != 'table' else chr(34) + 'table' + chr(34)}, "
        f"lambda x, i: {{'section': {lit(k)}, 'ordinal': i, 'text': x}})" for k in kinds)
    return f"""{name} AS (
  SELECT page_id, url, s.section AS section, CAST(s.ordinal AS INTEGER) AS ordinal, s.text AS text
  FROM (SELECT page_id, url, unnest(list_concat({items})) AS s FROM pa)
)"""


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), {lit(TOKEN_RE)}, 0)"


def tf_cte(name: str, source: str, keys: list[str], text: str) -> str:
    """CTE ``{name}_tf(keys, term, tf)`` and ``{name}_n(keys, norm)``."""
    k = ", ".join(keys)
    return f"""{name}_tok AS (
  SELECT {k}, unnest({tokens(text)}) AS term FROM {source}
), {name}_tf AS (
  SELECT {k}, term, count(*) AS tf FROM {name}_tok GROUP BY {k}, term
), {name}_n AS (
  SELECT s.{keys[0]}{''.join(', s.' + c for c in keys[1:])}, coalesce(sqrt(sum(t.tf * t.tf)::DOUBLE), 0.0) AS norm
  FROM {source} s LEFT JOIN {name}_tf t ON {' AND '.join(f's.{c} = t.{c}' for c in keys)}
  GROUP BY {', '.join('s.' + c for c in keys)}
)"""


def verdict(score: str, cut: float, labels=("fit", "low_fit")) -> str:
    return f"CASE WHEN {score} >= {cut!r} THEN {lit(labels[0])} ELSE {lit(labels[1])} END"


def cosine(dot: str, na: str, nb: str) -> str:
    return f"CASE WHEN {na} = 0 OR {nb} = 0 THEN 0.0 ELSE CAST({dot} AS DOUBLE) / ({na} * {nb}) END"
