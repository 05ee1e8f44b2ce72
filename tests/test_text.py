"""Scalar text functions against the fixture values."""

import pytest
from pyspark.sql import functions as F

from contentfit.functions import text as tx

L = F.lit


@pytest.mark.parametrize("raw, expected", [
    ("reklam isteği.", "reklam isteği"),
    ("Google Reklam  Tanıtımı.", "google reklam tanıtımı"),
    ('"foo bar."', "foo bar."),
    ("reklam .", "reklam "),
    ("", ""),
])
def test_clean_intent(one, raw, expected):
    assert one(tx.clean_intent(L(raw))) == expected


def test_clean_intent_null(one):
    assert one(tx.clean_intent(L(None).cast("string"))) == ""


def test_normalize_ws_unicode(one):
    assert one(tx.normalize_ws(L("a  b\t\n c "))) == "a b c"


def test_normalize_ws_idempotent(one):
    x = tx.normalize_ws(L("  x   y  "))
    assert one(tx.normalize_ws(x)) == one(x)


@pytest.mark.parametrize("raw, expected", [
    ("12,5%", 12.5), ("abc", None), (".5", 0.5), ("-3", -3.0), ("1.234,5", 1.234), ("9.5e-05", 9.5),
])
def test_parse_number(one, raw, expected):
    assert one(tx.parse_number(L(raw))) == expected
    assert one(tx.parse_number(L("  " + raw + " "), trim_first=True)) == expected


@pytest.mark.parametrize("old, new, expected", [
    (0.703504, 0.515372, -26.74), (0.714652, 0.816071, 14.19), (0.0, 0.9, 0.0),
])
def test_pct_change(one, old, new, expected):
    assert one(tx.pct_change(L(old), L(new))) == expected


def test_formatting(one):
    assert one(tx.fmt_num(L(0.810164), 3)) == "0.810"
    assert one(tx.fmt_pct(L(12.57))) == "+12.57%"
    assert one(tx.fmt_pct(L(-26.74))) == "-26.74%"
    assert one(tx.fmt_num(L(None).cast("double"), 3)) == ""
    assert one(tx.fmt_pct(L(None).cast("double"))) == ""


def test_first_json(one):
    j = tx.first_json(L('x {"a":"1"} y'))
    assert one(j) == {"a": "1"}
    assert one(tx.first_json(L('{"a":{"b":1}}'))) is None
    assert one(tx.first_json(L("none"))) is None
    assert one(tx.first_json(L("{'a':'1'}"))) is None
    assert one(tx.has_key(j, "a")) is True
    assert one(tx.has_key(tx.first_json(L("none")), "a")) is False
