"""Tables of geometries met by cells, and the union of polygons around a point, against brute force."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stratalake.functions.geometry import Geometry, polygon_wkb, to_wkb
from stratalake.operators import areas, spatial


def inside(shape, x, y):
    """(in it by the even-odd rule of any part, on an edge), in plain Python."""
    found, on = False, False
    for polygon in shape.polygons:
        odd = False
        for ring in polygon.rings:
            for (px, py), (qx, qy) in zip(ring, ring[1:]):
                if (x - px) * (qy - py) - (y - py) * (qx - px) == 0 and min(px, qx) <= x <= max(px, qx) and min(py, qy) <= y <= max(py, qy):
                    on = True
                if (y < py) != (y < qy) and x < (qx - px) * (y - py) / (qy - py) + px:
                    odd = not odd
        found |= odd
    return found, on


def star(rng, x, y, size, n):
    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    ring = [(x + size * rng.uniform(0.3, 1) * math.cos(a), y + size * rng.uniform(0.3, 1) * math.sin(a)) for a in angles]
    return [*ring, ring[0]]


@pytest.fixture(scope="module")
def shapes():
    rng = random.Random(5)
    out = [Geometry("POLYGON", [star(rng, rng.uniform(0, 100), rng.uniform(0, 100), rng.choice([0.5, 3, 20, 60]), rng.randint(3, 40))]) for _ in range(60)]
    out.append(Geometry("POLYGON", [[(10, 10), (50, 10), (50, 50), (10, 50), (10, 10)], [(20, 20), (30, 20), (30, 30), (20, 30), (20, 20)]]))
    out.append(Geometry("MULTIPOLYGON", [[[(60, 60), (70, 60), (70, 70), (60, 60)]], [[(80, 80), (90, 80), (90, 90), (80, 80)]]]))
    out.append(Geometry("POLYGON", [[(50 + 40 * math.cos(i / 300 * math.tau), 50 + 40 * math.sin(i / 300 * math.tau)) for i in range(300)]]))
    return out


@pytest.fixture(scope="module")
def points():
    rng = random.Random(6)
    return [(i, rng.uniform(-5, 105), rng.uniform(-5, 105)) for i in range(1500)] + [(2000 + i, float(x), float(y)) for i, (x, y) in enumerate((a, b) for a in range(0, 100, 10) for b in range(0, 100, 10))]


def tables(spark, shapes, points):
    geometries = spark.createDataFrame([(i, to_wkb(g)) for i, g in enumerate(shapes)] + [(900, None)], "area int, geometry binary")
    return spark.createDataFrame([*points, (9000, None, 3.0), (9001, math.nan, 3.0)], "nr int, x double, y double"), geometries


@pytest.mark.parametrize("predicate", ["intersects", "within", "dwithin"])
@pytest.mark.parametrize("small", [0, 100_000])
def test_table_of_areas(spark, shapes, points, predicate, small, monkeypatch):
    monkeypatch.setattr(areas, "SMALL_COVER", small)
    monkeypatch.setattr(areas, "CELL_POINTS", 20)
    df, geometries = tables(spark, shapes, points)

    def meets(g, x, y):
        found, on = inside(g, x, y)
        if predicate == "dwithin":
            near = any(segment(x, y, p, q) <= 1.5 for poly in g.polygons for r in poly.rings for p, q in zip(r, r[1:]))
            return found or on or near
        return found or on if predicate == "intersects" else found and not on

    want = Counter((n, k) for n, x, y in points for k, g in enumerate(shapes) if meets(g, x, y))
    got = spatial.spatial_join(df, geometries, "area", predicate=predicate, distance=1.5)
    assert got.columns == ["nr", "x", "y", "area"]
    assert Counter((r.nr, r.area) for r in got.collect()) == want


def segment(x, y, p, q):
    dx, dy = q[0] - p[0], q[1] - p[1]
    t = max(0.0, min(1.0, ((x - p[0]) * dx + (y - p[1]) * dy) / (dx * dx + dy * dy or 1)))
    return math.hypot(x - p[0] - t * dx, y - p[1] - t * dy)


def test_left_join_names_and_repeats(spark, shapes, points):
    df, geometries = tables(spark, shapes, points[:200] + points[:3])
    df = df.withColumn("area", F.lit("own"))
    got = spatial.spatial_join(df, geometries, "area", how="left")
    assert got.columns == ["nr", "x", "y", "area_left", "area_right"]
    want = Counter()
    for n, x, y in points[:200] + points[:3]:
        hits = [k for k, g in enumerate(shapes) if any(inside(g, x, y))]
        want.update((n, k) for k in hits or [None])
    want.update([(9000, None), (9001, None)])
    assert Counter((r.nr, r.area_right) for r in got.collect()) == want
    assert spatial.spatial_join(df, geometries, "area", how="left", drop_label_if_exists=True).columns == ["nr", "x", "y", "area"]
    none = geometries.limit(0)
    assert spatial.spatial_join(df, none, "area").count() == 0 and spatial.spatial_join(df, none, "area", how="left").count() == 205
    with pytest.raises(ValueError):
        spatial.spatial_join(df, geometries, "area", predicate="disjoint")


def test_points_and_lines_as_geometries(spark):
    rows = [("p", Geometry("POINT", (3.0, 4.0))), ("l", Geometry("LINESTRING", [(0.0, 0.0), (6.0, 8.0)])), ("m", Geometry("MULTIPOINT", [(1.0, 1.0), (2.0, 2.0)]))]
    geometries = spark.createDataFrame([(k, to_wkb(g)) for k, g in rows], "k string, geometry binary")
    df = spark.createDataFrame([(1, 3.0, 4.0), (2, 6.0, 8.0), (3, 2.0, 2.0), (4, 6.5, 8.0), (5, 50.0, 50.0)], "nr int, x double, y double")
    meet = lambda **o: sorted((r.nr, r.k) for r in spatial.spatial_join(df, geometries, "k", **o).collect())
    assert meet() == [(1, "l"), (1, "p"), (2, "l"), (3, "m")]
    assert meet(predicate="within") == []
    assert (4, "l") in meet(predicate="dwithin", distance=0.5) and (5, "l") not in meet(predicate="dwithin", distance=0.5)


def test_many_areas_leave_the_plan_small(spark):
    ids = spark.range(100_000).select(F.col("id").alias("area"), (F.col("id") % 400 * 2).cast("double").alias("x"), F.floor(F.col("id") / 400).cast("double").alias("y"))
    ring = F.array(*[F.struct((F.col("x") + a).alias("x"), (F.col("y") + b).alias("y")) for a, b in ((0, 0), (1.5, 0), (1.5, 0.5), (0, 0.5), (0, 0))])
    df = spark.range(2000).select(F.col("id").alias("nr"), (F.col("id") % 400 * 2 + 0.7).alias("x"), (F.floor(F.col("id") / 400) * 40 + 0.2).alias("y"))
    joined = spatial.spatial_join(df, ids.select("area", polygon_wkb(ring).alias("geometry")), "area")
    assert len(joined._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    assert joined.count() == 2000 and joined.where("area % 400 * 2 + 0.7 = x").count() == 2000


def test_selection_within_a_table(spark, shapes, points):
    df, geometries = tables(spark, shapes[:20], points)
    got = {r.nr for r in areas.select_within_table(df, geometries).collect()}
    assert got == {n for n, x, y in points if any(inside(g, x, y) == (True, False) for g in shapes[:20])}
    rest = {r.nr for r in areas.select_within_table(df, geometries, invert=True).collect()}
    assert rest == {n for n, _, _ in points} - got | {9000, 9001}


def stored(monkeypatch):
    """Rows of every table that an operator stores from now on."""
    sizes, real = [], areas.settled

    def settled(df):
        out = real(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(areas, "settled", settled)
    return sizes


def crowd(spark):
    """400 rows at 4 places, and 300 areas of 3 shapes: two of them hold 2 places each, one of these both, none the last."""
    at = F.col("id") % 4
    df = spark.range(400).select(F.col("id").alias("nr"), (at * 2 + 1).cast("double").alias("x"), F.lit(1.0).alias("y"))
    shift = F.when(F.col("id") % 3 < 2, F.col("id") % 3 * 2).otherwise(50)
    ring = F.array(*[F.struct((shift + a).cast("double").alias("x"), F.lit(float(b)).alias("y")) for a, b in ((0, 0), (4, 0), (4, 3), (0, 3), (0, 0))])
    return df, spark.range(300).select(F.col("id").alias("area"), polygon_wkb(ring).alias("geometry"))


def crowd_pairs():
    inside = lambda n, k: k % 3 < 2 and k % 3 * 2 < n % 4 * 2 + 1 < k % 3 * 2 + 4
    return Counter((n, k) for n in range(400) for k in range(300) if inside(n, k))


def test_equal_places_and_shapes_are_met_once(spark, monkeypatch):
    df, geometries = crowd(spark)
    sizes = stored(monkeypatch)
    got = Counter((r.nr, r.area) for r in spatial.spatial_join(df, geometries, "area").collect())
    assert got == crowd_pairs() and sum(got.values()) == 40_000
    assert max(sizes) <= 2000


@pytest.mark.parametrize("small", [0, 100_000])
def test_shared_places_against_brute_force(spark, shapes, points, small, monkeypatch):
    monkeypatch.setattr(areas, "SMALL_COVER", small)
    monkeypatch.setattr(areas, "CELL_POINTS", 20)
    monkeypatch.setattr(areas, "LABELS", 2)
    some = points[:60] + points[-60:]
    df, geometries = tables(spark, shapes, [(n + 10_000 * k, x, y) for n, x, y in some for k in range(8)])
    geometries = geometries.unionByName(geometries.where("area % 2 = 0")).unionByName(geometries.where("area % 4 = 0"))
    times = lambda k: 1 + (k % 2 == 0) + (k % 4 == 0)
    want = Counter({(n + 10_000 * c, k): times(k) for n, x, y in some for c in range(8) for k, g in enumerate(shapes) if any(inside(g, x, y))})
    got = Counter((r.nr, r.area) for r in spatial.spatial_join(df, geometries, "area").collect())
    assert got == want
    met = {n for n, _ in want}
    left = Counter((r.nr, r.area) for r in spatial.spatial_join(df, geometries, "area", how="left").collect())
    assert left == want + Counter((n, None) for n in {n + 10_000 * c for n, _, _ in some for c in range(8)} - met | {9000, 9001})


def test_left_join_stores_less_than_it_gives(spark, monkeypatch):
    df, geometries = crowd(spark)
    sizes = stored(monkeypatch)
    df = df.unionByName(spark.createDataFrame([(400, 30.0, 30.0), (401, None, 1.0)], df.schema))
    got = Counter((r.nr, r.area) for r in spatial.spatial_join(df, geometries, "area", how="left").collect())
    assert got == crowd_pairs() + Counter((n, None) for n in [*range(3, 400, 4), 400, 401]) and max(sizes) <= 2000
    # Rows with places of their own are met as they come; those without an area are told by place.
    sizes.clear()
    ring = F.array(*[F.struct((F.col("id") + a).cast("double").alias("x"), F.lit(float(b)).alias("y")) for a, b in ((0, -9), (900, -9), (900, 900), (0, 900), (0, -9))])
    many = spark.range(80).select(F.col("id").alias("area"), polygon_wkb(ring).alias("geometry"))
    own = spark.range(1000).select(F.col("id").alias("nr"), (F.col("id") - 99.5).alias("x"), F.lit(1.0).alias("y"))
    found = spatial.spatial_join(own, many, "area", how="left")
    want = Counter((n, k) for n in range(1000) for k in [k for k in range(80) if k < n - 99.5 < k + 900] or [None])
    assert Counter((r.nr, r.area) for r in found.collect()) == want
    assert max(sizes) < 20_000 < sum(want.values())


def test_selection_settles_each_place_once(spark, monkeypatch):
    df, geometries = crowd(spark)
    sizes = stored(monkeypatch)
    assert areas.select_within_table(df, geometries).count() == 300
    assert areas.select_within_table(df, geometries.where("area % 3 = 1"), invert=True).count() == 200
    assert max(sizes) <= 1000


def fan(angles):
    rays = [(math.cos(a), math.sin(a)) for a in angles]
    return [Geometry("POLYGON", [[(0.0, 0.0), p, q, (0.0, 0.0)]]) for p, q in zip(rays[::2], rays[1::2])]


@pytest.mark.parametrize(("gap", "kept"), [(0.0, True), (0.1, False), (1e-3, False), (1e-9, False)])
def test_union_closes_the_circle_or_not(spark, gap, kept):
    cuts = [0.05, 1.2, 2.7, 4.4]
    ends = [1.2, 2.7, 4.4, 0.05 + 2 * math.pi - gap]
    shapes = fan([a for pair in zip(cuts, ends) for a in pair])
    if not gap:  # the last ray is the first
        first = shapes[0].coords[0][1]
        shapes[-1] = Geometry("POLYGON", [[*shapes[-1].coords[0][:2], first, (0.0, 0.0)]])
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.2, 0.2), (3, 5.0, 5.0)], "nr int, x double, y double")
    assert {r.nr for r in spatial.select_within_polygons(df, shapes).collect()} == ({1, 2} if kept else {2})


def test_union_edges_holes_and_orientation(spark):
    left = [(0.0, 0.0), (2.0, 0.0), (2.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    right = [(2.0, 1.0), (2.0, 3.0), (5.0, 3.0), (5.0, 1.0), (2.0, 1.0)]
    ring = [[(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0), (0.0, 0.0)], [(3.0, 3.0), (6.0, 3.0), (6.0, 6.0), (3.0, 6.0), (3.0, 3.0)]]
    plug = [(3.0, 3.0), (3.0, 6.0), (6.0, 6.0), (6.0, 3.0), (3.0, 3.0)]
    df = spark.createDataFrame([(1, 2.0, 2.0), (2, 2.0, 1.0), (3, 2.0, 0.5), (4, 0.0, 0.0), (5, 4.0, 3.0), (6, 3.0, 3.0), (7, 6.0, 4.0), (8, 4.5, 4.5), (9, 9.0, 5.0)], "nr int, x double, y double")
    for a in (left, left[::-1]):
        for b in (right, right[::-1]):
            got = {r.nr for r in spatial.select_within_polygons(df, [Geometry("POLYGON", [a]), Geometry("POLYGON", [b])]).collect()}
            assert got == {1}, (a, b)
    for p in (plug, plug[::-1]):
        got = {r.nr for r in spatial.select_within_polygons(df, [Geometry("POLYGON", ring), Geometry("POLYGON", [p])]).collect()}
        assert got == {1, 2, 3, 5, 6, 7, 8}
    assert {r.nr for r in spatial.select_within_polygons(df, [Geometry("POLYGON", ring), Geometry("POLYGON", ring)]).collect()} == {1, 2, 3}
