"""Shapefiles written by tasks and read in ranges, and files made here after the format's description."""

import datetime
import struct

import pytest

from stratalake.functions.geometry import Geometry, from_wkb, to_wkb
from stratalake.sources import shapefile

SQUARE = [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0), (0.0, 0.0)]  # clockwise, as files have outer rings
HOLE = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0)]
FAR = [(x + 10, y) for x, y in SQUARE]


def normal(g):
    """Points of each ring as a set, so that orientation and start don't matter."""
    return g.kind, sorted(sorted(r) for p in g.polygons for r in map(set, p.rings)) or g.coords


@pytest.mark.parametrize("shapes", [
    [Geometry("POINT", (1.5, -2.25)), None, Geometry("POINT", (3.0, 4.0))],
    [Geometry("LINESTRING", [(0.0, 0.0), (1.0, 2.0)]), Geometry("MULTILINESTRING", [[(0.0, 0.0), (1.0, 1.0)], [(5.0, 5.0), (6.0, 7.0), (8.0, 8.0)]])],
    [Geometry("POLYGON", [SQUARE]), Geometry("POLYGON", [SQUARE[::-1], HOLE]), Geometry("MULTIPOLYGON", [[SQUARE, HOLE[::-1]], [FAR]])],
    [Geometry("MULTIPOINT", [(0.0, 0.0), (7.0, 8.0)])],
])
def test_there_and_back(spark, tmp_path, shapes):
    day = datetime.date(2024, 2, 29)
    rows = [(i * 7, i / 3 if i else None, f"naïve {i}" if i != 1 else None, bool(i % 2), day, to_wkb(g) if g else None) for i, g in enumerate(shapes * 20)]
    df = spark.createDataFrame(rows, "id long, share double, a_long_name string, flag boolean, day date, geometry binary").repartition(3)
    with pytest.warns(UserWarning, match="a_long_name"):
        shapefile.write_shapefile(df, str(tmp_path / "s.shp"), "geometry", 'PROJCS["RD"]')
    assert (tmp_path / "s.prj").read_text() == 'PROJCS["RD"]' and not list(tmp_path.glob(".s*"))
    size = (tmp_path / "s.shp").stat().st_size
    assert struct.unpack(">i", (tmp_path / "s.shp").read_bytes()[24:28])[0] * 2 == size
    got = shapefile.read_shapefile(spark, str(tmp_path / "s.shp"), records=7)
    assert got.rdd.getNumPartitions() == -(-len(rows) // 7)
    assert dict(got.dtypes) == {"id": "bigint", "share": "double", "a_long_nam": "string", "flag": "boolean", "day": "date", "geometry": "binary"}
    want = {r[0]: r for r in rows}
    for r in got.collect():
        w = want.pop(r.id)
        assert tuple(r)[1:5] == w[1:5]
        assert (r.geometry is None) == (w[5] is None) and (r.geometry is None or normal(from_wkb(r.geometry)) == normal(from_wkb(w[5])))
    assert not want


def test_files_of_others(spark, tmp_path):
    """Heights, measures, a deleted row, gaps between records, numbers with decimals, another encoding."""
    contents = [struct.pack("<i3d", 11, 1.0, 2.0, 9.0), struct.pack("<i", 0), struct.pack("<i3d", 21, 3.0, 4.0, 7.0), struct.pack("<i2d", 1, 5.0, 6.0)]
    body, index = b"", b""
    for i, c in enumerate(contents):
        body += b"\0" * 4  # a gap that only the index knows of
        index += struct.pack(">2i", (100 + len(body)) // 2, len(c) // 2)
        body += struct.pack(">2i", i + 1, len(c) // 2) + c
    head = lambda n: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, n // 2) + struct.pack("<2i8d", 1000, 11, *[0.0] * 8)
    (tmp_path / "o.shp").write_bytes(head(100 + len(body)) + body)
    (tmp_path / "o.shx").write_bytes(head(100 + len(index)) + index)
    fields = [("NAME", "C", 8, 0), ("SIZE", "N", 8, 2), ("COUNT", "N", 5, 0)]
    table = struct.pack("<4BIHH20x", 3, 99, 1, 1, 4, 33 + 96, 22)
    table += b"".join(n.encode().ljust(11, b"\0") + k.encode() + b"\0" * 4 + bytes([w, d]) + b"\0" * 14 for n, k, w, d in fields) + b"\r"
    table += b" \xe9t\xe9     " + b"    1.25" + b"    7" + b"*gone    " + b"    0.00" + b"    0" + b" last    " + b"********" + b"     " + b"         " + b"    2.50" + b"   -3"
    (tmp_path / "o.dbf").write_bytes(table)
    got = shapefile.read_shapefile(spark, str(tmp_path / "o.dbf"), encoding="latin-1").collect()
    assert [(r.NAME, r.SIZE, r.COUNT, from_wkb(r.geometry).coords) for r in got] == [("été", 1.25, 7, (1.0, 2.0)), ("last", None, None, (3.0, 4.0)), (None, 2.5, -3, (5.0, 6.0))]


def test_points_of_surveys_and_errors(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, 2.0, 0.5), ("b", None, 2.0, 0.5)], "nr string, x double, y double, surface double")
    shapefile.write_shapefile(df, str(tmp_path / "p.shp"))
    got = {r.nr: r.geometry for r in shapefile.read_shapefile(spark, str(tmp_path / "p.shp")).collect()}
    assert from_wkb(got["a"]).coords == (1.0, 2.0) and got["b"] is None
    shapefile.write_shapefile(df.limit(0), str(tmp_path / "none.shp"))
    assert shapefile.read_shapefile(spark, str(tmp_path / "none.shp")).count() == 0
    with pytest.raises(ValueError, match="254"):
        shapefile.write_shapefile(df.selectExpr("repeat('x', 300) as nr", "x", "y"), str(tmp_path / "q.shp"))
    mixed = spark.createDataFrame([(1, to_wkb(Geometry("POINT", (1.0, 2.0)))), (2, to_wkb(Geometry("POLYGON", [SQUARE])))], "id int, g binary")
    with pytest.raises(ValueError, match="one kind"):
        shapefile.write_shapefile(mixed, str(tmp_path / "m.shp"), "g")
    assert shapefile.short_names(["abcdefghijk", "abcdefghijl", "ABCDEFGHIJ", "b"]) == ["abcdefghij", "abcdefgh_1", "ABCDEFGH_2", "b"]
