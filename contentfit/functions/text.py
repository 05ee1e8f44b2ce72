"""Scalar text and number functions as native Column expressions.

Everything here compiles to JVM expressions (regexp_replace, translate,
try_cast, ...); nothing crosses into Python.  Regexes are written so that
Java and RE2 (the DuckDB oracle) read them the same way: explicit
whitespace classes instead of a locale-dependent ``\\s``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ----------------------------------------------------------
# Whitespace as Python's str.split() sees it: ASCII controls, the information
# separators, NEL and every Unicode space separator (NBSP included).
WS_CLASS = r"[\t\n\x0B\f\r\x1C-\x1F\x85 \p{Z}]"
# Trailing punctuation removed from an intent label.
INTENT_TRAIL = r"[.?!,:;]+$"
# Characters deleted from an intent label, after everything else.
INTENT_DROP_CHARS = "\"'"
# Number inside text: optional sign, digits, optional fraction.
NUMBER_RE = r"[-+]?\d*\.?\d+"
# First JSON object in generated text: non-greedy, dot matches newline.
FIRST_JSON_RE = r"(?s)\{.*?\}"
# Inline elements: their tags join text without a break.  Every other tag
# (block elements, br, ...) breaks text with a space.
INLINE_TAGS = (
    "a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "dfn", "em",
    "font", "i", "kbd", "mark", "q", "s", "samp", "small", "span", "strong",
    "sub", "sup", "time", "tt", "u", "var",
)

def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_ws(x) -> Column:
    """Collapse every whitespace run to one space and trim (Python
    ``" ".join(s.split())``)."""
    return F.trim(F.regexp_replace(_c(x), WS_CLASS + "+", " "))


def strip_ws(x) -> Column:
    """Python ``str.strip()``: remove Unicode whitespace at both ends."""
    return F.regexp_replace(_c(x), "^" + WS_CLASS + "+|" + WS_CLASS + "+$", "")


def norm_label(x) -> Column:
    """C4: strip, lower, collapse whitespace (verdict text before a test)."""
    return F.lower(normalize_ws(x))


def clean_intent(x) -> Column:
    """null/empty -> ""; lower + strip; drop a trailing run of .?!,:;;
    collapse whitespace; delete quote characters.  Order matters: quotes go
    last, so '"foo."' keeps its dot."""
    t = strip_ws(F.lower(_c(x)))
    t = F.regexp_replace(t, INTENT_TRAIL, "")
    t = F.regexp_replace(t, WS_CLASS + "+", " ")
    t = F.translate(t, INTENT_DROP_CHARS, "")
    return F.coalesce(t, F.lit(""))


def label_text(x) -> Column:
    """Lower + strip of a generated label."""
    return F.lower(strip_ws(_c(x)))


def parse_number(x, trim_first: bool = False) -> Column:
    """Drop '%', comma to dot, first ``[-+]?\\d*\\.?\\d+`` -> double;
    null when nothing matches.  Scientific notation and thousands dots are
    misread on purpose (same as the reference)."""
    s = _c(x).cast("string")
    if trim_first:
        s = strip_ws(s)
    s = F.replace(F.replace(s, F.lit("%"), F.lit("")), F.lit(","), F.lit("."))
    m = F.regexp_extract(s, NUMBER_RE, 0)
    return F.when(m == "", F.lit(None).cast("double")).otherwise(m.try_cast("double"))


def pct_change(old, new, eps: float = 1e-8) -> Column:
    """(new-old)/max(old,eps)*100 rounded to 2; 0.0 when old <= 0."""
    o, n = _c(old), _c(new)
    raw = (n - o) / F.greatest(o, F.lit(eps)) * 100.0
    # "+ 0.0" turns a rounded -0.0 into 0.0.
    return F.when(o > 0, F.round(raw, 2) + F.lit(0.0)).otherwise(F.lit(0.0))


def round_score(x, digits: int = 6) -> Column:
    """C8."""
    return F.round(_c(x), digits)


def fmt_num(x, digits: int = 3) -> Column:
    """Number as text with fixed decimals; null -> "".  Decimal
    arithmetic, so both engines agree on half-way digits."""
    d = _c(x).cast("decimal(30,9)")
    s = F.round(d, digits).cast(f"decimal(30,{digits})").cast("string")
    return F.coalesce(s, F.lit(""))


def fmt_pct(x, digits: int = 2) -> Column:
    """C10: '+' when positive, fixed decimals, '%'; null -> ""."""
    c = _c(x)
    body = F.concat(F.when(c > 0, F.lit("+")).otherwise(F.lit("")), fmt_num(c, digits), F.lit("%"))
    return F.when(c.isNull(), F.lit("")).otherwise(body)


def first_json(x) -> Column:
    """First ``{...}`` (non-greedy) parsed as map<string,string>; null
    when absent or not valid strict JSON (single quotes rejected)."""
    m = F.regexp_extract(_c(x), FIRST_JSON_RE, 0)
    parsed = F.from_json(m, "map<string,string>", {"allowSingleQuotes": "false", "mode": "PERMISSIVE"})
    return F.when(m == "", F.lit(None).cast("map<string,string>")).otherwise(parsed)


def has_key(parsed, key: str) -> Column:
    """Parsed object holds ``key`` (null object -> false)."""
    return F.coalesce(F.map_contains_key(_c(parsed), F.lit(key)), F.lit(False))
