"""XLSX workbooks as tables: one sheet, its first row the names, read as a stream by a task.

A sheet is one compressed part of the file, so one task reads it, row after row; the format ends at 1,048,576 rows. Only
the workbook's table of shared texts is held. Columns of numbers are doubles, of dates timestamps, of truth values
booleans, others texts; empty cells and error values are null; rows without any value are left out.
"""

from __future__ import annotations

import datetime
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterable, Iterator
from typing import Any, BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import open_file, settled

#: Number formats that show dates or times; those of a workbook's own by their letters.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}
KINDS = {"n": "double", "d": "timestamp", "b": "boolean"}
ROWS = 4096


def local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def column_of(reference: str) -> int:
    """Number of a cell's column, from 0."""
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def text_in(e: ET.Element) -> str:
    """The text of an item, without its phonetic guide."""
    return "".join(t.text or "" for child in e if local(child) in ("t", "r") for t in ([child] if local(child) == "t" else child) if local(t) == "t")


def sheets(book: zipfile.ZipFile) -> dict[str, str]:
    """The parts of the sheets by name, in order."""
    targets = {e.get("Id"): e.get("Target") for e in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    found = {}
    for e in ET.fromstring(book.read("xl/workbook.xml")).iter():
        if local(e) == "sheet":
            target = targets[next(v for k, v in e.attrib.items() if k.endswith("}id"))]
            found[e.get("name")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return found


def date_styles(book: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show dates."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ET.fromstring(book.read("xl/styles.xml"))
    own = {int(e.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", e.get("formatCode", "")) for e in root.iter() if local(e) == "numFmt"}
    dates = DATE_FORMATS | {k for k, v in own.items() if re.search("[dmyhs]", v, re.I)}
    cells = next((e for e in root if local(e) == "cellXfs"), ())
    return {i for i, e in enumerate(cells) if int(e.get("numFmtId", 0)) in dates}


def rows_in(source: BinaryIO, sheet: str | None = None) -> Iterator[dict[int, tuple[str, Any]]]:
    """The rows of a sheet: (kind, value) by column; kinds are n, d, b and t for text."""
    with zipfile.ZipFile(source) as book:
        parts = sheets(book)
        if sheet is not None and sheet not in parts:
            raise ValueError(f"there is no sheet {sheet!r}; there are {', '.join(parts)}")
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as f:
                for _, e in ET.iterparse(f):
                    if local(e) == "si":
                        shared.append(text_in(e))
                        e.clear()
        dates = date_styles(book)
        first = re.search(rb"date1904\s*=\s*[\"'](1|true)", book.read("xl/workbook.xml"))
        zero = datetime.datetime(1904, 1, 1) if first else datetime.datetime(1899, 12, 30)
        with book.open(parts[sheet] if sheet is not None else next(iter(parts.values()))) as f:
            holder = None
            for event, e in ET.iterparse(f, ("start", "end")):
                if event == "start":
                    holder = e if local(e) == "sheetData" else holder
                elif local(e) == "row":
                    yield {k: v for k, v in (cell_of(c, i, shared, dates, zero) for i, c in enumerate(x for x in e if local(x) == "c")) if v is not None}
                    holder.clear()


def cell_of(c: ET.Element, i: int, shared: list[str], dates: set[int], zero: datetime.datetime) -> tuple[int, tuple[str, Any] | None]:
    at = column_of(c.get("r")) if c.get("r") else i
    kind = c.get("t", "n")
    if kind == "inlineStr":
        inline = next((x for x in c if local(x) == "is"), None)
        return at, ("t", text_in(inline)) if inline is not None else None
    value = next((x.text for x in c if local(x) == "v"), None)
    if value is None or kind == "e":
        return at, None
    if kind == "s":
        return at, ("t", shared[int(value)])
    if kind == "b":
        return at, ("b", value == "1")
    if kind == "d":
        return at, ("d", datetime.datetime.fromisoformat(value))
    if kind == "str":
        return at, ("t", value)
    number = float(value)
    return at, ("d", zero + datetime.timedelta(seconds=round(number * 86400, 3))) if int(c.get("s", 0)) in dates else ("n", number)


def read_excel(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A sheet (the first, or one by name) as a table."""
    with open_file(path) as f:
        first = next(rows_in(f, sheet), {})
    if not first:
        raise ValueError(f"{path} has no row of names")
    at = sorted(first)
    plain = lambda v: str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)
    names = [plain(first[k][1]) for k in at]
    if len(set(names)) < len(names):
        raise ValueError(f"{path} has columns of one name")

    def read(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for p in batch.column(0).to_pylist():
                with open_file(p) as f:
                    rows = rows_in(f, sheet)
                    next(rows)
                    kinds, values, n = [], [], 0
                    for row in rows:
                        found = [row.get(k) for k in at]
                        if any(found):
                            n += 1
                            kinds.append([x[0] if x else None for x in found])
                            values.append([None if x is None else plain(x[1]) if x[0] != "n" else repr(x[1]) for x in found])
                        if len(values) == ROWS:
                            yield pa.RecordBatch.from_arrays([pa.array(range(n - ROWS, n), pa.int64()), pa.array(kinds, pa.list_(pa.string())), pa.array(values, pa.list_(pa.string()))], names=["_pos", "kinds", "values"])
                            kinds, values = [], []
                    if values:
                        yield pa.RecordBatch.from_arrays([pa.array(range(n - len(values), n), pa.int64()), pa.array(kinds, pa.list_(pa.string())), pa.array(values, pa.list_(pa.string()))], names=["_pos", "kinds", "values"])

    cells = settled(spark.createDataFrame([(path,)], "path string").mapInArrow(read, "_pos long, kinds array<string>, values array<string>"))
    found = cells.agg(*[F.collect_set(F.get("kinds", F.lit(i))).alias(f"k{i}") for i in range(len(at))]).first()
    # A column of several kinds is text; whole numbers then have no point.
    one = [found[f"k{i}"][0] if len(found[f"k{i}"]) == 1 else "t" for i in range(len(at))]
    text = lambda i: F.when(F.get("kinds", F.lit(i)) == "n", F.regexp_replace(F.get("values", F.lit(i)), r"\.0$", "")).otherwise(F.get("values", F.lit(i)))
    return cells.select(*[(text(i) if k == "t" else F.get("values", F.lit(i)).cast(KINDS[k])).alias(n) for i, (n, k) in enumerate(zip(names, one))])
