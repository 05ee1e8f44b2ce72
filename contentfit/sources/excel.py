"""Excel workbooks (.xlsx) as DataFrames.

Workbooks come through Spark's ``binaryFile`` source, so from any store that
Spark reads, a file to a task; a task walks a sheet's XML as a stream, with the
standard library, and sends its rows on in batches.  A workbook is read whole
into its task, which its format bounds (1,048,576 rows a sheet).

The first row with cells names the columns.  Wanted columns are taken by name,
in any order, and typed by the schema: text, whole numbers, numbers, booleans.
Empty cells, error cells and cells that don't fit their type are null; rows
without any cell are left out.  A file that isn't a workbook, lacks the sheet or
a wanted column, or is damaged raises an error that names it.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

BATCH_ROWS = 10_000
# --- fixed values of the format ---
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_DOCUMENT = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
_ARROW = {T.StringType: pa.string(), T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(),
          T.BooleanType: pa.bool_()}


class WorkbookError(ValueError):
    """A file that can't be read as the workbook that was asked for."""


def _text(element: ElementTree.Element) -> str:
    """Text of a string item: of its runs, but not of reading aids."""
    return "".join(t.text or "" for run in ([element] + element.findall(f"{_MAIN}r")) for t in run.findall(f"{_MAIN}t"))


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    with book.open("xl/sharedStrings.xml") as xml:
        out = []
        for _, e in ElementTree.iterparse(xml):
            if e.tag == f"{_MAIN}si":
                out.append(_text(e))
                e.clear()
        return out


def sheet_member(book: zipfile.ZipFile, sheet: str | None) -> str:
    """The archive member of a sheet, the first by default."""
    sheets = [(s.get("name"), s.get(f"{_DOCUMENT}id")) for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")]
    targets = {r.get("Id"): r.get("Target") for r in
               ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")).iter(f"{_PACKAGE}Relationship")}
    for name, rel in sheets:
        if sheet is None or name == sheet:
            target = targets[rel]
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    raise WorkbookError(f"no sheet {sheet!r} among {[n for n, _ in sheets]}")


def _column(reference: str) -> int:
    """0-based column of a cell reference such as ``AB12``."""
    n = 0
    for letter in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(letter) - 64
    return n - 1


def sheet_rows(data: bytes, sheet: str | None = None) -> Iterator[dict[int, str | bool]]:
    """Cells of each row that has some, by column; numbers are as written."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        shared, member = _shared(book), sheet_member(book, sheet)
        with book.open(member) as xml:
            for _, row in ElementTree.iterparse(xml):
                if row.tag != f"{_MAIN}row":
                    continue
                cells, at = {}, -1
                for c in row.iter(f"{_MAIN}c"):
                    at = _column(c.get("r")) if c.get("r") else at + 1
                    kind, value = c.get("t", "n"), c.findtext(f"{_MAIN}v")
                    if kind == "inlineStr":
                        item = c.find(f"{_MAIN}is")
                        value = _text(item) if item is not None else None
                    elif value is not None and kind == "s":
                        value = shared[int(value)]
                    elif value is not None and kind == "b":
                        value = value == "1"
                    elif kind == "e":
                        value = None
                    if value is not None and value != "":
                        cells[at] = value
                row.clear()
                if cells:
                    yield cells


def typed(value: str | bool | None, kind: T.DataType):
    """A cell's value as a column's type; null where it doesn't fit."""
    if value is None:
        return None
    if isinstance(kind, T.StringType):
        return ("TRUE" if value else "FALSE") if isinstance(value, bool) else value
    if isinstance(kind, T.BooleanType):
        return value if isinstance(value, bool) else {"true": True, "false": False}.get(value.strip().lower())
    if isinstance(value, bool):
        return None
    try:
        number = float(value)
    except ValueError:
        return None
    if isinstance(kind, T.DoubleType):
        return number
    whole = int(value) if re.fullmatch(r"[-+]?\d+", value.strip()) else int(number) if number.is_integer() else None
    bits = 31 if isinstance(kind, T.IntegerType) else 63
    return whole if whole is not None and -(1 << bits) <= whole < 1 << bits else None


def read_excel(spark: SparkSession, path: str, schema: T.StructType | str, sheet: str | None = None,
               names_of: dict[str, str] | None = None) -> DataFrame:
    """The rows of a sheet (the first by default) of every workbook under
    ``path``.  ``names_of`` has the schema's names for other headers."""
    known = dict(names_of or {})
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    for f in schema:
        if type(f.dataType) not in _ARROW:
            raise TypeError(f"column {f.name}: {f.dataType.simpleString()} isn't read from workbooks")

    def batch(rows: list[list]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else ([] for _ in schema)
        return pa.RecordBatch.from_arrays([pa.array(list(c), _ARROW[type(f.dataType)]) for f, c in zip(schema, columns)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for name, content in zip(files.column(0), files.column(1)):
                rows, at = [], None
                try:
                    for cells in sheet_rows(content.as_py(), sheet):
                        if at is None:
                            names = {known.get(str(v).strip(), str(v).strip()): i for i, v in reversed(cells.items())}
                            if missing := [f.name for f in schema if f.name not in names]:
                                raise WorkbookError(f"missing columns {missing}; present {list(names)}")
                            at = [names[f.name] for f in schema]
                            continue
                        rows.append([typed(cells.get(i), f.dataType) for i, f in zip(at, schema)])
                        if len(rows) == BATCH_ROWS:
                            yield batch(rows)
                            rows = []
                except (WorkbookError, zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError, EOFError, ValueError) as e:
                    raise WorkbookError(f"{name.as_py()}: {e}") from e
                yield batch(rows)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    return files.select("path", "content").mapInArrow(run, schema)
