"""Workbooks made here part by part, read as tables."""

import datetime
import zipfile

import pytest

from stratalake.operators import spatial
from stratalake.sources import excel, readers

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def book(path, sheets, shared=(), date1904=False):
    with zipfile.ZipFile(path, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook {MAIN}><workbookPr date1904="{int(date1904)}"/><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("xl/styles.xml", f'<styleSheet {MAIN}><numFmts><numFmt numFmtId="164" formatCode="&quot;day&quot; 0.0"/><numFmt numFmtId="165" formatCode="yyyy\\-mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>')
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>" + "".join(f"<si>{s}</si>" for s in shared) + "</sst>")
        for i, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {MAIN}><sheetData>{rows}</sheetData></worksheet>")
    return str(path)


def test_cells_of_every_kind(spark, tmp_path):
    shared = ["<t>nr</t>", "<r><t>a</t></r><r><t>bc</t></r><rPh><t>no</t></rPh>", "<t>seen</t>", "<t>mixed</t>"]
    head = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>x</t></is></c><c r="D1" t="s"><v>2</v></c><c r="E1" t="str"><v>ok</v></c><c r="AA1" t="s"><v>3</v></c><c r="AB1"><v>2024</v></c></row>'
    rows = '<row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2" s="2"><f>1+1</f><v>2.5</v></c><c r="C2"><v>9</v></c><c r="D2" s="1"><v>45351.5</v></c><c r="E2" t="b"><v>1</v></c><c r="AA2"><v>7</v></c><c r="AB2"><v>1E3</v></c></row><row r="3"/>'
    rows += '<row r="4"><c r="A4" t="str"><v>z</v></c><c r="B4" t="e"><v>#N/A</v></c><c r="D4" s="3"><v>1</v></c><c r="E4" t="b"><v>0</v></c><c r="AA4" t="str"><v>seven</v></c></row>'
    path = book(tmp_path / "b.xlsx", {"first": head + rows, "other sheet": '<row><c t="str"><v>k</v></c></row><row><c><v>4</v></c></row>'}, shared)
    df = excel.read_excel(spark, path)
    assert df.dtypes == [("nr", "string"), ("x", "double"), ("seen", "timestamp"), ("ok", "boolean"), ("mixed", "string"), ("2024", "double")]
    assert [tuple(r) for r in df.collect()] == [("abc", 2.5, datetime.datetime(2024, 2, 29, 12), True, "7", 1000.0), ("z", None, datetime.datetime(1899, 12, 31), False, "seven", None)]
    assert [tuple(r) for r in excel.read_excel(spark, path, "other sheet").collect()] == [(4.0,)]
    with pytest.raises(ValueError, match="other sheet"):
        excel.read_excel(spark, path, "nope")


def test_a_table_of_surveys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(excel, "ROWS", 7)
    names = ["nr", "x", "y", "surface", "top", "bottom", "lith"]
    rows = [(f"b{i // 5}", i // 5 * 10.0, 3.0, 1.5, i % 5 / 2, i % 5 / 2 + 0.5, "ZK"[i % 2]) for i in range(40)]
    cell = lambda v: f'<c t="str"><v>{v}</v></c>' if isinstance(v, str) else f"<c><v>{v!r}</v></c>"
    path = book(tmp_path / "t.xlsx", {"s": "".join(f"<row>{''.join(map(cell, r))}</row>" for r in (names, *rows))})
    c = readers.read_table(spark, path, crs=28992)
    assert sorted(map(tuple, c.data.select(*names).collect())) == rows and len(c) == 8
    (tmp_path / "none.xlsx").write_bytes(b"no archive " * 50)
    with pytest.raises(Exception, match="zip"):
        excel.read_excel(spark, str(tmp_path / "none.xlsx"))


def test_many_points_are_a_constant(spark):
    points = [(i * 3.0, (i * 7) % 50 * 1.0) for i in range(200)]
    df = spark.createDataFrame([(i, i * 1.5, (i * 11) % 53 * 1.0) for i in range(400)], "nr int, x double, y double")
    near = {r.nr for r in spatial.select_with_points(df, points, 2.5).collect()}
    assert near == {r.nr for r in df.collect() if any((r.x - a) ** 2 + (r.y - b) ** 2 < 6.25 for a, b in points)}
    assert {r.nr for r in spatial.select_with_points(df, points, 2.5, invert=True).collect()} == set(range(400)) - near
