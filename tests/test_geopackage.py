"""Conditions, columns and boxes go into the statement that tasks send to a GeoPackage."""

import sqlite3
import struct

import pytest

from stratalake.sources import btree, readers, sinks


@pytest.fixture
def file(tmp_path):
    path = str(tmp_path / "a b.gpkg")
    with sqlite3.connect(path) as db:
        db.executescript("""
            create table gpkg_contents (table_name text primary key, data_type text, identifier text, srs_id integer);
            create table gpkg_geometry_columns (table_name text primary key, column_name text, geometry_type_name text, srs_id integer, z tinyint, m tinyint);
            create table "my points" (fid integer primary key, name text, depth real, geom blob);
            insert into gpkg_contents values ('my points', 'features', 'p', 28992);
            insert into gpkg_geometry_columns values ('my points', 'geom', 'POINT', 28992, 0, 0);
            create virtual table "rtree_my points_geom" using rtree(id, minx, maxx, miny, maxy);
            create view few as select name from "my points" where depth > 90;
        """)
        for i in range(100):
            db.execute('insert into "my points" values (?, ?, ?, ?)', (i + 1, None if i % 10 == 0 else f"n{i}", float(i), bytes([i])))
            db.execute('insert into "rtree_my points_geom" values (?, ?, ?, ?, ?)', (i + 1, i, i, -i, -i))
    return path


def test_the_statement(spark, file, monkeypatch):
    monkeypatch.setattr(readers, "GPKG_ROWS", 17)
    with readers.Geopackage(spark, file) as g:
        assert g.tree("my points") == "rtree_my points_geom"
        df = g.read_table("my points", ["name", "depth"], [("depth", ">=", 20), ("name", "is not", None)], (15.0, -40.0, 35.0, 0.0))
        assert df.dtypes == [("name", "string"), ("depth", "double")]
        want = {(f"n{i}", float(i)) for i in range(20, 36) if i % 10}
        assert {tuple(r) for r in df.collect()} == want and df.rdd.getNumPartitions() == 6
        assert g.read_table("my points").count() == 100 and g.read_table("few").count() == 9
        sql, values = readers.range_statement("my points", ["name"], [("depth", "<", 5)], "rtree_my points_geom", (1, 2, 3, 4))
        assert sql == 'select "name" from "my points" where rowid >= ? and rowid < ? and "depth" < ? and rowid in (select id from "rtree_my points_geom" where minx <= ? and maxx >= ? and miny <= ? and maxy >= ?)'
        assert values == (5, 3, 1, 4, 2)
        plan = g.db.execute("explain query plan " + sql, (1, 50, *values)).fetchall()
        assert any("VIRTUAL TABLE" in r[3] for r in plan)


def test_what_can_not_be_pushed_is_an_error(spark, file):
    with readers.Geopackage(spark, file) as g:
        for args in ({"columns": ["nope"]}, {"where": [("depth", "; drop", 1)]}, {"where": [("nope", "=", 1)]}):
            with pytest.raises(ValueError):
                g.read_table("my points", **args)
        with pytest.raises(ValueError, match="view"):
            g.read_table("few", ["name"])
        g.db.execute('drop table "rtree_my points_geom"')
        with pytest.raises(ValueError, match="R-tree"):
            g.read_table("my points", bbox=(0, 0, 1, 1))


ROWS = [(i, f"n{i}" * (i % 5), None if i % 7 == 0 else i / 4, float(i % 3), None if i % 11 == 0 else -1.5 * i, i % 2 == 0, bytes([i % 256]) * (i % 40)) for i in range(400)]
ROWS[200] = (200, "long" * 20_000, 1.0, 2.0, 3.0, True, b"\x01" * 70_000)  # more than a page each
SCHEMA = "nr long, name string, depth double, x double, y double, flag boolean, raw binary"


@pytest.mark.parametrize("mounted", [True, False])
def test_tables_are_made_by_tasks_and_numbered_through(spark, tmp_path, monkeypatch, mounted):
    monkeypatch.setattr(sinks, "GPKG_PART", 37)
    monkeypatch.setattr(sinks, "GPKG_BATCH", 10)
    if mounted:
        monkeypatch.setattr(type(spark.range(0)), "toLocalIterator", lambda *_: pytest.fail("rows stream through the driver"))
    else:
        monkeypatch.setattr(sinks, "shared_file", lambda *_: (_ for _ in ()).throw(ValueError("no mounted folder")))
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(5).orderBy("nr")
    path = str(tmp_path / "made by tasks.gpkg")
    for _ in range(2):  # a table that is there is written anew, others stay
        sinks.to_geopackage({"my rows": df, "plain": df.select("name"), "none": df.select("name").limit(0)}, path, 28992)
    with sqlite3.connect(path) as db:
        assert db.execute("pragma integrity_check").fetchall() == [("ok",)]
        got = db.execute('select * from "my rows" order by fid').fetchall()
        assert [r[:-1] for r in got] == [(k, *r) for k, r in enumerate(ROWS, 1)]
        assert [r[-1] for r in got] == [None if y is None else b"GP\x00\x01" + struct.pack("<iBI2d", 28992, 1, 1, x, y) for _, _, _, x, y, _, _ in ROWS]
        assert db.execute("select fid, name from plain order by fid").fetchall() == [(k, r[1]) for k, r in enumerate(ROWS, 1)]
        assert db.execute("select count(*) from none").fetchone() == (0,)
        assert db.execute("select table_name, data_type, srs_id from gpkg_contents order by 1").fetchall() == [("my rows", "features", 28992), ("none", "attributes", 28992), ("plain", "attributes", 28992)]
        assert db.execute("select * from gpkg_geometry_columns").fetchall() == [("my rows", "geom", "POINT", 28992, 0, 0)]
        db.execute('insert into "my rows" (nr) values (-1)')
        assert db.execute('select max(fid) from "my rows"').fetchone() == (401,)
        assert db.execute("pragma integrity_check").fetchall() == [("ok",)]
    with readers.Geopackage(spark, path) as g:
        back = g.read_table("my rows").where("nr >= 0").drop("geom").orderBy("fid").collect()
        assert [tuple(r)[1:] for r in back] == [(*r[:5], int(r[5]), bytearray(r[6])) for r in ROWS]


def test_columns_with_values_of_other_types(spark, tmp_path):
    path = str(tmp_path / "mixed.gpkg")
    with sqlite3.connect(path) as db:
        db.execute("create table t (fid integer primary key, name text, depth real, n integer, raw blob)")
        db.execute("insert into t values (1, 'a', 1.5, 2, x'01'), (2, null, 2, null, null)")
        db.execute("insert into t values (3, x'41', '7.5', 3.5, x'')")
    with readers.Geopackage(spark, path) as g:
        assert [tuple(r) for r in g.read_table("t").orderBy("fid").collect()] == [(1, "a", 1.5, 2, bytearray(b"\x01")), (2, None, 2.0, None, None), (3, "b'A'", 7.5, 3, bytearray())]


def test_pages_of_parts_become_one_tree(spark, tmp_path, monkeypatch):
    """Trees of one to three levels, with the page that SQLite locks in their midst, searched and changed afterwards."""
    monkeypatch.setattr(btree, "LOCK_BYTE", 512 * 40)
    monkeypatch.setattr(sinks, "GPKG_PAGE", 512)
    monkeypatch.setattr(sinks, "GPKG_PART", 3000)
    for n in (1, 5, 200, 9000):
        df = spark.range(n).selectExpr("id as nr", "id / 8 as depth", "repeat('a', int(id % 50)) as name", "case when id % 5 > 0 then id * 1.5D end as x", "id * 2.5D as y").repartitionByRange(4, "nr")
        path = str(tmp_path / f"{n}.gpkg")
        sinks.to_geopackage({"a": df, "b": df.select("nr", "name")}, path, 28992)
        with sqlite3.connect(path) as db:
            want = sorted((r.nr, r.depth, r.name, r.x, r.y) for r in df.collect())
            assert [tuple(r[1:6]) for r in db.execute("select * from a order by fid")] == want and [r[0] for r in db.execute("select fid from b order by fid")] == list(range(1, n + 1))
            assert all(db.execute("select nr, name from b where fid = ?", (k + 1,)).fetchone() == (want[k][0], want[k][2]) for k in range(0, n, 37))
            check = [r[0] for r in db.execute("pragma integrity_check")]
            assert check == ["ok"] or n >= 200 and check == ["*** in database main ***\nPage 41 is never used"]  # SQLite's own is another one
            db.execute("delete from a where fid % 3 = 0")
            db.execute("update b set name = name || name || name")
            db.executemany("insert into a (nr, name) values (?, ?)", [(k, "new" * 30) for k in range(500)])
            assert db.execute("select count(*), max(fid) from a").fetchone() == (n - n // 3 + 500, (n - (n % 3 == 0)) + 500)
            assert [r[0] for r in db.execute("pragma integrity_check")] == check
