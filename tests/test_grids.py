"""Grids with steps that are no binary fractions and irregular ones, against brute force over the stored coordinates."""

import math

import pytest

from stratalake.operators.combine import add_nearest_voxels, split_at_voxel_units
from stratalake.operators.voxel import Axis, VoxelModel
from stratalake.sources import mesh

CELLS = "x double, y double, z double, lith int"
AXES = {
    "tenths": [0.05 + i * 0.1 for i in range(12)],
    "thirds": [i / 3 for i in range(12)],
    "sevenths": [-3 + i * 0.7 for i in range(12)],
    "irregular": [-9.0, -4.0, -3.5, -1.0, 0.0, 0.1, 0.4, 2.0, 7.5, 8.0, 8.25, 20.0],
}


def grid(spark, xs, ys, zs):
    rows = [(x, y, z, (i * 7 + j * 5 + k * 3) % 11 or None) for i, x in enumerate(xs) for j, y in enumerate(ys) for k, z in enumerate(zs)]
    return VoxelModel.from_table(spark.createDataFrame(rows, CELLS)), {r[:3]: r[3] for r in rows}


def nearest(centres, v):
    return min(centres, key=lambda c: (abs(c - v), -c))


@pytest.mark.parametrize("name", AXES)
def test_index_is_that_of_the_nearest_stored_coordinate(spark, name):
    c = AXES[name]
    axis = Axis.of(c)
    assert axis.regular == (name != "irregular") and axis.centres == tuple(c)
    probes = [*c, *[(a + b) / 2 for a, b in zip(c, c[1:])], c[0] - 5, c[-1] + 5, *[a + d for a in c for d in (1e-12, -1e-12, 0.03, -0.02)]]
    df = spark.createDataFrame([(v,) for v in [*probes, None, math.nan]], "v double")
    got = df.select("v", axis.index(df.v).alias("i"), axis.nearest(df.v).alias("c")).collect()
    for v, r in zip(probes, got):
        assert r.c == nearest(c, v) and r.i == c.index(r.c) == axis.place(v), v
    assert [r.i for r in got[len(probes) :]] == [None, None]


@pytest.mark.parametrize("name", AXES)
def test_selections_keep_what_they_name(spark, name):
    c = AXES[name]
    m, cells = grid(spark, c[:4], c[:5], c)
    rows = lambda model: {(r.x, r.y, r.z): r.lith for r in model.df.collect()}
    assert rows(m) == rows(m.sel(z=slice(None, None), x=slice(-100, 100))) == rows(m.isel(z=slice(None))) == cells
    assert rows(m.slice_depth_interval(1000, -1000)) == cells
    assert rows(m.sel(z=[c[3], c[7]], x=c[2])) == {k: v for k, v in cells.items() if k[2] in (c[3], c[7]) and k[0] == c[2]}
    assert rows(m.sel(method="nearest", z=[c[3] + 0.01])) == {k: v for k, v in cells.items() if k[2] == c[3]}
    cut = m.isel(z=[0, 5, 6], y=slice(0, 2))
    assert rows(cut) == {k: v for k, v in cells.items() if k[2] in (c[0], c[5], c[6]) and k[1] in c[3:5]}
    assert cut.z.centres == (c[0], c[5], c[6]) and cut.shape == (2, 4, 3)
    bounds = spark.createDataFrame([(x, c[8]) for x in c[:4]], "x double, bound double")
    low = spark.createDataFrame([(x, c[2]) for x in c[:4]], "x double, bound double")
    assert rows(m.slice_depth_interval(bounds, low, how="majority")) == {k: v for k, v in cells.items() if c[2] <= k[2] <= c[8]}
    with pytest.raises(KeyError):
        m.sel(z=c[3] + 0.01)


def test_coordinates_that_differ_by_rounding_are_one(spark):
    rows = [(float(i), 0.0, z, i) for i in range(3) for z in ((0.3, 0.1 + 0.2) if i else (0.3,))] + [(float(i), 0.0, 0.4, 9) for i in range(3)]
    m = VoxelModel.from_table(spark.createDataFrame(rows[:1] + rows[2:3] + rows[4:], CELLS))
    assert m.z.size == 2 and m.df.select("z").distinct().count() == 2


@pytest.mark.parametrize("name", AXES)
def test_joins_against_brute_force(spark, name):
    c = AXES[name]
    m, cells = grid(spark, c[:4], c[:5], c)
    points = [(a, b) for a in (*c[:4], (c[1] + c[2]) / 2, c[0] - 0.01, c[0] - 100) for b in (*c[:5], c[2] + 0.01)]
    found = m.select_with_points(spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id int, x double, y double"), "id").collect()
    inside = lambda p: m.x.low <= p[0] <= m.x.high and m.y.low <= p[1] <= m.y.high
    want = {(i, nearest(c[:4], p[0]), nearest(c[:5], p[1]), z) for i, p in enumerate(points) if inside(p) for z in c}
    assert {(r.id, r.x, r.y, r.z) for r in found} == want and len(found) == len(want)
    data = [(i, *p, 0.0, -z, -z) for i, p in enumerate(points[:30]) for z in (*c, c[4] + 0.02)]
    got = add_nearest_voxels(spark.createDataFrame(data, "nr int, x double, y double, surface double, top double, bottom double"), m, "lith").collect()
    dy, dx, dz = m.resolution
    for r in got:
        at = nearest(c[:4], r.x), nearest(c[:5], r.y), nearest(c, -(r.top + r.bottom) / 2)
        near = abs(at[0] - r.x) <= dx and abs(at[1] - r.y) <= dy and abs(at[2] + (r.top + r.bottom) / 2) <= dz
        assert r.lith == (cells[at] if near else None)
    head = spark.createDataFrame([(1, c[1], c[2], 100.0)], "nr int, x double, y double, surface double")
    rows = spark.createDataFrame([(1, c[1], c[2], 100.0, 0.0, 300.0)], "nr int, x double, y double, surface double, top double, bottom double")
    cut = split_at_voxel_units(rows, head, VoxelModel.from_table(m.df.withColumnRenamed("lith", "unit")), "unit")
    assert cut.where("unit is not null").count() >= 8


@pytest.mark.parametrize("name", AXES)
def test_mesh_shares_corners(spark, name):
    c = AXES[name]
    m, cells = grid(spark, c[:4], c[:5], c)
    full = VoxelModel.from_table(m.df.na.fill(0, ["lith"]))
    points, made = mesh.voxel_mesh(full, "lith")
    at = {r.id: (r.x, r.y, r.z) for r in points.collect()}
    assert sorted(at) == list(range(5 * 6 * 13)) and len(set(at.values())) == len(at)
    assert [at[i] for i in sorted(at)] == sorted(at.values())
    for r in made.collect():
        corners = [at[i] for i in r.points]
        assert len(set(corners)) == 8 and all(min(p[k] for p in corners) < (r.x, r.y, r.z)[k] < max(p[k] for p in corners) for k in range(3))


def test_lines_of_a_table(spark):
    m, cells = grid(spark, [0.05 + 0.1 * i for i in range(10)], [0.05 + 0.1 * i for i in range(10)], [0.0])
    lines = {i: [(0.0, 0.0), (0.3, 0.4), (0.3, 0.4 + i * 0.01)] for i in range(60)} | {90: [(0.5, 0.5)], 91: [], 92: [(0.2, 0.2), (0.2, 0.2)]}
    df = spark.createDataFrame(list(lines.items()), "id int, path array<struct<x: double, y: double>>")
    got = m.sample_along_lines(df, "id", dist=0.2).collect()
    want = set()
    for i, path in lines.items():
        sizes = [math.dist(a, b) for a, b in zip(path, path[1:])]
        total = sum(sizes)
        for k in range(max(1, math.ceil(total / 0.2)) if path else 0):
            left, p = k * 0.2, path[0]
            for (a, b), s in zip(zip(path, path[1:]), sizes):
                if s and left <= s:
                    p = tuple(u + left / s * (v - u) for u, v in zip(a, b))
                    break
                left -= s
            want.add((i, round(k * 0.2, 9), round(nearest(m.x.centres, p[0]), 9), round(nearest(m.y.centres, p[1]), 9)))
    assert {(r.id, round(r.distance, 9), round(r.x, 9), round(r.y, 9)) for r in got} == want
    assert m.sample_along_lines(df, "id", nsamples=3).groupBy("id").count().where("count = 3").count() == len(lines) - 1
    one = m.sample_along_line([(0.0, 0.0), (0.3, 0.4)], nsamples=2)
    assert one.columns == ["distance", "x", "y", "z", "lith"] and one.count() == 2
    with pytest.raises(ValueError):
        m.sample_along_lines(df, "id")


def test_a_model_without_cells(spark):
    m = VoxelModel.from_table(spark.createDataFrame([], CELLS))
    assert m.shape == (0, 0, 0) and m.sel(x=slice(0, 1)).df.count() == 0
    with pytest.raises(KeyError):
        m.sel(x=1.0)


def test_mesh_of_a_grid_whose_last_row_is_not_full(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from stratalake.plans import queries as plans

    rows = [(i, [((i * 7 + k) % 5 - 2) / 8 for k in range(6)]) for i in range(56)]  # two rows of 25 cells and one of 6
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = db.execute(plans.oracle_sql()["voxel_mesh_tenths"]).fetchall()
    got = [(r.id, r.x, r.y, r.z) for r in plans.queries()["voxel_mesh_tenths"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) == 26 * 4 * 7 and sorted(got) == sorted(want)


def test_dense_has_every_cell_once(spark):
    c = AXES["irregular"]
    m, cells = grid(spark, c[:3], c[:4], c[:5])
    gone = {(c[0], c[3], c[4]), (c[2], c[0], c[0])}
    cut = VoxelModel.from_table(m.df.where(" and ".join(f"not (x = {x}D and y = {y}D and z = {z}D)" for x, y, z in gone)))
    got = [tuple(r) for r in cut.dense().df.collect()]
    assert sorted(got, key=str) == sorted(((*k, None if k in gone else v) for k, v in cells.items()), key=str)
    none = VoxelModel.from_table(spark.createDataFrame([], CELLS)).dense().df
    assert none.count() == 0 and none.columns == ["x", "y", "z", "lith"]
