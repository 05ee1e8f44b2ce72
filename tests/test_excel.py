"""Workbooks made by hand, read as the search-performance export."""

import zipfile

import pytest

from contentfit.operators import terms as tm
from contentfit.sources.excel import _column, read_excel, sheet_rows
from contentfit.sources.tables import read_search_performance

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def cell(ref, v, strings):
    if v is None:
        return ""
    if isinstance(v, bool):
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)):
        return f'<c r="{ref}"><v>{v}</v></c>'
    if v.startswith("inline:"):
        return f'<c r="{ref}" t="inlineStr"><is><t>{v[7:]}</t></is></c>'
    if v.startswith("#"):
        return f'<c r="{ref}" t="e"><v>{v}</v></c>'
    strings.append(v)
    return f'<c r="{ref}" t="s"><v>{len(strings) - 1}</v></c>'


def workbook(path, sheets):
    strings, bodies = [], {}
    for name, rows in sheets.items():
        bodies[name] = "".join(
            f'<row r="{i}">' + "".join(cell(f"{chr(65 + j)}{i}", v, strings) for j, v in enumerate(row)) + "</row>"
            for i, row in enumerate(rows, 1))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="{REL}"><sheets>' + "".join(
            f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(bodies, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(
            f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(bodies) + 1)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>" + "".join(
            f"<si><r><t>{s[:2]}</t></r><r><t>{s[2:]}</t></r><rPh><t>aid</t></rPh></si>" for s in strings) + "</sst>")
        for i, body in enumerate(bodies.values(), 1):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {MAIN}><sheetData>{body}</sheetData></worksheet>")


ROWS = [["query", "position", "clicks", "impressions"], ["red shoes", 1.5, 9, 1], [None, None, None, None], ["inline:blue &amp; hats", 2, 5, 9],
        ["how to", None, None, 30], ["odd", "#N/A", "n/a", 2.5], [12, 1, 3.0, True]]


def test_typed_rows(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", {"Queries": ROWS, "Other": [["query"], ["no"]]})
    got = read_excel(spark, str(tmp_path), "query string, clicks long, impressions long, position double").collect()
    assert [tuple(r) for r in got] == [("red shoes", 9, 1, 1.5), ("blue & hats", 5, 9, 2.0), ("how to", None, 30, None),
                                       ("odd", None, None, None), ("12", 3, None, 1.0)]
    assert [r[0] for r in read_excel(spark, str(tmp_path), "query string", sheet="Other").collect()] == ["no"]


def test_feeds_the_priority_terms(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", {"S": ROWS[:5]})
    workbook(tmp_path / "b.xlsx", {"S": [["Gösterimler", "Tıklamalar", "En çok yapılan sorgular"], [100, 1, "more"]]})
    perf = read_search_performance(spark, str(tmp_path), "xlsx")
    assert {r["query"] for r in tm.priority_terms(perf, 1).collect()} == {"red shoes", "more"}


@pytest.mark.parametrize("name, make, message", [
    ("text.xlsx", lambda p: p.write_bytes(b"no archive"), "text.xlsx"),
    ("cut.xlsx", lambda p: (workbook(p, {"S": ROWS * 50}), p.write_bytes(p.read_bytes()[:900])), "cut.xlsx"),
    ("lacks.xlsx", lambda p: workbook(p, {"S": [["query"], ["a"]]}), "missing columns"),
    ("sheet.xlsx", lambda p: workbook(p, {"Wrong": ROWS}), "no sheet"),
])
def test_what_cannot_be_read_is_named(spark, tmp_path, name, make, message):
    make(tmp_path / name)
    with pytest.raises(Exception, match=message):
        read_excel(spark, str(tmp_path), "query string, clicks long", sheet="S").collect()


def test_references_and_empty_sheets(spark, tmp_path):
    assert [_column(r) for r in ("A1", "Z9", "AA10", "XFD1")] == [0, 25, 26, 16383]
    workbook(tmp_path / "e.xlsx", {"S": []})
    assert list(sheet_rows((tmp_path / "e.xlsx").read_bytes())) == []
    assert read_excel(spark, str(tmp_path), "query string").collect() == []
    with pytest.raises(TypeError):
        read_excel(spark, str(tmp_path), "d date")
