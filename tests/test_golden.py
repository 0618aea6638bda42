"""Golden values of small survey tables."""

import pytest
from pyspark.sql import functions as F

from stratalake.collection import AlignmentWarning, Collection
from stratalake.functions import crs, geometry, geotech, text
from stratalake.operators import layers, selection, spatial, validation
from stratalake.operators.combine import add_nearest_voxels, split_at_voxel_units
from stratalake.operators.voxel import VoxelModel, sample_raster
from stratalake.predicates import column_name_from
from stratalake.sources import mesh, readers

SURVEYS = {
    "A": (2, 3, 0.2, -4.0, [0, 0.8, 1.5, 2.5, 3.7, 4.2], "KKZZK"),
    "B": (1, 4, 0.3, -3.6, [0, 0.6, 1.2, 2.5, 3.1, 3.9], "KKVVK"),
    "C": (4, 2, 0.25, -5.25, [0, 1.4, 1.8, 2.9, 3.8, 5.5], "KKKZZ"),
    "D": (3, 5, 0.1, -2.9, [0, 0.5, 1.2, 1.8, 2.5, 3.0], "KVKVZ"),
    "E": (1, 1, -0.1, -3.1, [0, 0.5, 1.2, 1.8, 2.5, 3.0], "ZZZZZ"),
}
VOXELS = {3.5: "23211 2311. 2111. 3211.", 2.5: "22111 22111 2111. 2321.", 1.5: "2321. 21133 22111 .221.", 0.5: "2221. 21111 2213. 32211"}


@pytest.fixture(scope="module")
def data(spark):
    rows = [(nr, x, y, s, e, float(a), float(b), li) for nr, (x, y, s, e, d, liths) in SURVEYS.items() for a, b, li in zip(d, d[1:], liths)]
    return spark.createDataFrame(rows, "nr string, x int, y int, surface double, end double, top double, bottom double, lith string")


@pytest.fixture(scope="module")
def cpts(spark):
    a = [(float(i + 1), q) for i, q in enumerate([0.227, 0.279, 0.327, 0.354, 0.357, 0.354, 0.363, 0.447, 0.761, 1.481])]
    b = [((i + 1) / 2, q) for i, q in enumerate([8.721, 12.733, 17.324, 17.036, 16.352, 15.781, 15.365, 15.509, 15.884, 15.982])]
    rows = [("a", 3, 2, 2.1, -7.9, d, q) for d, q in a] + [("b", 1, 1, 0.8, -4.2, d, q) for d, q in b]
    return spark.createDataFrame(rows, "nr string, x int, y int, surface double, end double, depth double, qc double")


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i + 0.5, y, -2.25 + k * 0.5, None if c == "." else int(c)) for y, line in VOXELS.items() for i, column in enumerate(line.split()) for k, c in enumerate(column)]
    return VoxelModel.from_table(spark.createDataFrame(rows, "x double, y double, z double, lith int"))


def ids(df):
    return "".join(sorted(r[0] for r in df.select("nr").distinct().collect()))


def values(df, name="top"):
    return {r.nr: round(r[name], 6) for r in df.collect()}


def test_selections(data):
    s = selection
    assert ids(s.select_by_values(data, "lith", ["V", "K"])) == "ABCD"
    assert ids(s.select_by_values(data, "lith", ["V", "K"], how="and")) == "BD"
    assert ids(s.select_by_values(data, "lith", ["V", "K"], how="and", invert=True)) == "ACE"
    assert ids(s.select_by_values(data, "bottom", slice(3.9, 10))) == "ABC"
    assert ids(s.select_by_values(data, "bottom", slice(3.9, 10), inclusive="neither")) == "AC"
    assert s.slice_by_values(data, "lith", "Z").count() == 10 and s.slice_by_values(data, "lith", "Z", invert=True).count() == 15
    assert s.slice_by_values(data, "bottom", slice(1.5, 3.1)).count() == 12
    assert s.slice_by_values(data, "bottom", slice(3.1, None), inclusive="neither").count() == 5
    assert ids(s.select_by_elevation(data, 0, 0.25)) == "ACD" and ids(s.select_by_elevation(data.drop("end"), end_min=-4, end_max=-3)) == "ABE"
    assert ids(s.select_by_length(data, max_length=3.0)) == "DE" and ids(s.select_by_length(data, 4, 5)) == "A"
    for bad, error in ((lambda: s.select_by_values(data, "no", 1), IndexError), (lambda: s.select_by_values(data, "lith", slice(1, 2)), TypeError)):
        with pytest.raises(error):
            bad()


def test_depth_slices(data, cpts):
    cut = selection.slice_depth_interval(data, 0.6, 2.4)
    assert (cut.count(), cut.agg(F.min("top"), F.max("bottom")).first()) == (14, (0.6, 2.4))
    cut = selection.slice_depth_interval(data, -2, -3, relative_to_vertical_reference=True)
    assert cut.count() == 11 and sorted({round(r.bottom, 2) for r in cut.groupBy("nr").agg(F.max("bottom").alias("bottom")).collect()}) == [2.9, 3.0, 3.2, 3.25, 3.3]
    assert selection.slice_depth_interval(data, 4).count() == 2 and selection.slice_depth_interval(data, -2, -1).count() == 0
    assert selection.slice_depth_interval(cpts, 0.6, 4.4).count() == 4 + 7
    assert selection.slice_depth_interval(cpts, lower=-0.1, relative_to_vertical_reference=True).count() == 3


def test_layers(data, cpts):
    assert values(layers.cumulative_thickness(data, "lith", "V"), "thickness") == {"B": 1.9, "D": 1.4}
    assert values(layers.cumulative_thickness(data, "lith", ["Z", "K"]), "thickness") == {"A": 4.2, "B": 2.0, "C": 5.5, "D": 1.6, "E": 3.0}
    assert values(layers.cumulative_thickness(cpts, "qc", slice(0.7, 13)), "thickness") == {"a": 2, "b": 1}
    assert values(layers.layer_top(data, "lith", "V")) == {"B": 1.2, "D": 0.5} and values(layers.layer_top(data, "lith", "V", 1)) == {"B": 1.2}
    assert values(layers.layer_top(data, "lith", ["Z", "V"], 1)) == values(layers.layer_top(data, "lith", ["Z", "V"], 1, 1))
    assert values(layers.layer_top(cpts, "qc", slice(0.7, 18))) == {"a": 8, "b": 0} and values(layers.layer_top(cpts, "qc", slice(0.7, 18), 2.5)) == {"b": 0}
    assert values(layers.layer_base(data, "lith", ["Z", "V"]), "base") == {"A": 3.7, "B": 3.1, "C": 5.5, "D": 3.0, "E": 3.0}
    with pytest.raises(ValueError):
        layers.layer_top(data, "lith", "V", 0)


@pytest.mark.parametrize(("wanted", "thick", "share", "expected"), [("Z", None, None, {"a": 0.7, "b": 0.5}), ("Z", 0.5, None, {"a": 1.2, "b": 2.05}), ("Z", 0.5, 0.8, {"a": 0.7, "b": 1.6}), (["L", "Z"], 0.5, None, {"a": 0.5, "b": 1.4}), ("Z", 1, 0.99, {"a": 1.2}), ("Z", 10, None, {})])
def test_layer_tops(spark, wanted, thick, share, expected):
    table = {"a": [(0, 0.5, "K"), (0.5, 0.7, "L"), (0.7, 1.1, "Z"), (1.1, 1.2, "L"), (1.2, 1.8, "Z"), (1.8, 2.8, "Z")], "b": [(0, 0.3, "K"), (0.3, 0.4, "L"), (0.4, 0.5, "K"), (0.5, 0.7, "Z"), (0.7, 0.8, "L"), (0.8, 1.4, "K"), (1.4, 1.6, "L"), (1.6, 1.8, "Z"), (1.8, 2.0, "Z"), (2.0, 2.05, "L"), (2.05, 2.1, "Z"), (2.1, 2.6, "Z")], "c": [(0, 0.2, "K"), (0.2, 0.4, "K")]}
    df = spark.createDataFrame([(n, 0.0, float(a), float(b), li) for n, v in table.items() for a, b, li in v], "nr string, surface double, top double, bottom double, lith string")
    assert values(layers.layer_top(df, "lith", wanted, thick, share)) == expected


@pytest.mark.parametrize(("share", "reach", "top"), [(0.4, 1, 3), (0.6, 1, 4), (0.5, 1, 3), (1, 6.5, None), (0.91, 6.5, 3)])
def test_top_of_sand(spark, share, reach, top):
    rows = list(zip([0.0, 1, 1.5, 3, 3.5, 4, 6], [1.0, 1.5, 3, 3.5, 4, 6, 10], "KVKZKZZ"))
    df = spark.createDataFrame([("a", *map(float, r[:2]), r[2]) for r in rows], "nr string, top double, bottom double, lith string")
    assert layers.top_of_sand(df, "lith", share, reach).first().top == top


def test_spatial(spark, data):
    grid = spark.createDataFrame([(f"nr{i * 5 + j + 1}", i + 1.0, j + 1.0) for i in range(5) for j in range(5)], "nr string, x double, y double")
    points, lines = [(1, 1), (4, 4), (1, 4), (4, 1)], "MULTILINESTRING ((1 1, 5 5), (1 5, 5 1))"
    polygon = "POLYGON ((2 1, 5 4, 4 5, 1 2, 2 1))"
    assert spatial.select_within_bbox(grid, 1, 1, 3, 3).count() == 9 and spatial.select_within_bbox(grid, 1, 1, 3, 3, invert=True).count() == 16
    assert spatial.select_with_points(grid, points, 1.1).count() == 16 and spatial.select_with_points(grid, points, 1.1, invert=True).count() == 9
    table = spark.createDataFrame([(str(i), float(a), float(b)) for i, (a, b) in enumerate(points)], "nr string, x double, y double")
    assert spatial.select_with_points(grid, table, 1.1).count() == 16 and spatial.select_with_points(grid, table, 1.1, invert=True).count() == 9
    assert spatial.select_with_lines(grid, lines, 1).count() == 21
    assert spatial.select_within_polygons(grid, polygon).count() == 3 and spatial.select_within_polygons(grid, polygon, 0.1).count() == 11
    assert spatial.spatial_join(grid, [("p", polygon)], "id").count() == 11 and spatial.spatial_join(grid, [("p", polygon)], "id", how="left").count() == 25
    halves = ["POLYGON ((1 1, 3 1, 3 5, 1 5))", "POLYGON ((3 1, 5 1, 5 5, 3 5))"]
    assert spatial.select_within_polygons(grid, halves).count() == 9  # the shared edge is inside
    c = Collection.of(data)
    assert len(c.select_with_points(points, 1.1)) == 3 and len(c.select_within_polygons("POLYGON ((2 1, 5 4, 4 5, 1 3, 2 1))", 0.7)) == 2
    for g in (polygon, lines, "POINT (1 2)", "MULTIPOINT ((1 2), (3 4))"):
        one = geometry.from_wkt(g)
        assert geometry.from_wkb(geometry.to_wkb(one)) == one and geometry.from_wkt(geometry.to_wkt(one)) == one
    wkb = grid.select("x", geometry.point_wkb(F.col("x") / 3, -F.col("y")).alias("w"), (-F.col("y")).alias("my")).collect()
    assert all(geometry.from_wkb(bytes(r.w)).coords == (r.x / 3, r.my) for r in wkb)


def test_collection(data):
    c = Collection.of(data)
    with_thickness = c.get_cumulative_thickness("lith", ["L", "Z"], include_in_header=True).header
    assert [r["L,Z_thickness"] for r in with_thickness.orderBy("nr").collect()] == [pytest.approx(v) if v else None for v in (2.2, None, 2.6, 0.5, 3.0)]
    other = Collection(c.header.where("nr != 'E'"), data)
    with pytest.warns(AlignmentWarning):
        assert not other.check_alignment()
    assert len(other.align()) == 5 and column_name_from(slice(0.7, 13), "qc[", "]_base") == "qc[0.7:13]_base"


def test_voxels(spark, data, cpts, model):
    assert (model.resolution, model.bounds, model.z_bounds, model.shape) == ((1, 1, 0.5), (0, 0, 4, 4), (-2.5, 0), (4, 4, 5))
    assert {r.nr for r in model.select_with_points(data.select("nr", "x", "y").distinct(), "nr").select("nr").collect()} == set("ABCE")
    assert model.slice_depth_interval(-0.4, -1.6).shape == (4, 4, 4) and model.slice_depth_interval(-0.5, -1.5).shape == (4, 4, 2)
    assert sorted(r.n for r in model.value_counts("lith").collect()) == [9, 27, 34]
    thick = {(r.x, r.y): r.thickness for r in model.thickness(F.col("lith") == 1).collect()}
    assert [thick[x, 3.5] for x in (0.5, 1.5, 2.5, 3.5)] == [1, 1, 1.5, 1] and thick[1.5, 0.5] == 2
    most = {(r.x, r.y): r.value for r in model.most_common("lith").collect()}
    assert [most[x, 0.5] for x in (0.5, 1.5, 2.5, 3.5)] == [2, 1, 2, 1]
    points, cells = mesh.voxel_mesh(model, "lith")
    assert (points.count(), cells.count()) == (142, 70) and sorted(r.id for r in points.collect()) == list(range(142))
    near = {(r.nr, r.top): r.lith2 for r in add_nearest_voxels(data, VoxelModel.from_table(model.df.withColumnRenamed("lith", "lith2")), "lith2").collect()}
    assert [near["A", t] for t in (0, 0.8, 1.5, 2.5, 3.7)] == [None, 1, 1, None, None] and near["B", 1.2] == 3
    head = data.select("nr", "x", "y").distinct()
    cut = split_at_voxel_units(data, head, VoxelModel.from_table(model.df.withColumnRenamed("lith", "unit")), "unit")
    assert cut.where("top >= bottom").count() == 0 and cut.groupBy("nr").agg(F.max("bottom").alias("b")).orderBy("nr").first().b == 4.2
    raster = spark.createDataFrame([(float(x), float(y), 1.0) for x in (1, 2, 3) for y in (2, 3, 4)], "x double, y double, value double")
    at = spark.createDataFrame([("a", 1, 5), ("b", 2, 4), ("c", 3, 3), ("d", 4, 2), ("e", 5, 1)], "nr string, x int, y int")
    assert [r.value for r in sample_raster(at, raster).orderBy("nr").collect()] == [None, 1, 1, None, None]


def test_functions(spark):
    qc, rf = [0.1, 0.1, 0.2, 0.3, 0.4, 0.5, 1, 2, 5, 10, 20], [9, 7, 5.5, 5, 4, 3, 3, 2, 1.5, 1, 1]
    df = spark.createDataFrame([(i, float(q), float(r)) for i, (q, r) in enumerate(zip(qc, rf))], "i int, qc double, rf double").withColumn("ic", geotech.calc_ic(F.col("qc"), F.col("rf")))
    rows = df.withColumn("l", geotech.calc_lithology(F.col("ic"), F.col("qc"), F.col("rf"))).orderBy("i").collect()
    assert rows[0].ic == pytest.approx(4.09490299) and [r.l for r in rows] == "V Kh Kh K K K K Kz Z Z Z".split()
    samples = [[10, 5, 10, 15, 20, 10, 10, 8, 4, 3, 2, 2, 1, 0, 0, 0], [20, 30, 15, 15, 10, 5, 5] + [0] * 9, [30, 40, 10, 10, 5, 5] + [0] * 10]
    names = [n for n, _ in geotech.CLASSES]
    g = spark.createDataFrame([(i, *map(float, s)) for i, s in enumerate(samples)], "i int, " + ", ".join(f"{n} double" for n in names))
    got = geotech.grainsize_percentiles(geotech.grainsize_percentiles(g, [10, 50, 90]), [10, 50, 90], only_sand=True).orderBy("i").collect()
    assert [r.d10 for r in got] == pytest.approx([63, 31.5, 21]) and [r.d50 for r in got] == pytest.approx([215, 90, 76.5]) and [r.d90 for r in got] == pytest.approx([855, 250, 180])
    assert [r.d10_sand for r in got] == pytest.approx([102.95, 70.2, 67.725], abs=1e-2) and [r.d90_sand for r in got] == pytest.approx([731.75, 292, 222])
    coords = spark.createDataFrame([("1.0 2.0",), ("2.1,2.0",), ("3.1;1.0",)], "c string").select(text.parse_coordinates(F.col("c")).alias("p")).collect()
    assert [tuple(r.p) for r in coords] == [(1, 2), (2.1, 2), (3.1, 1)]
    with pytest.raises(Exception, match="no coordinates"):
        spark.createDataFrame([("1.0,,2.3",)], "c string").select(text.parse_coordinates(F.col("c"))).collect()


def test_reference_systems(spark):
    df = spark.createDataFrame([("a", 140000.0, 440000.0), ("b", 37395.0, 857077.0)], "nr string, x double, y double")
    got = crs.transform_coordinates(df, 28992, 4326).orderBy("nr").collect()
    assert (got[0].x, got[0].y) == pytest.approx((5.169024734261481, 51.948244431668776), abs=1e-8)
    assert (got[1].x, got[1].y) == pytest.approx((3.51911014, 55.68101879), abs=1e-7)
    back = crs.transform_coordinates(spark.createDataFrame([("a", 5.1, 51.9)], "nr string, x double, y double"), 4326, 28992).first()
    assert (back.x, back.y) == pytest.approx((135233.28064173012, 434649.01993844495), abs=1e-2)
    utm = crs.transform_coordinates(spark.createDataFrame([("a", 641589.868, 5765293.564)], "nr string, x double, y double"), 32631, 28992).first()
    assert (utm.x, utm.y) == pytest.approx((132781, 448031), abs=1.5)


def test_validation(spark):
    rows = [("a", 0, 0.0, 1.0), ("a", 1, 1.0, 0.5), ("a", 2, 2.0, 3.0), ("b", 3, 1.0, 2.0), ("b", 4, 2.0, 4.0)]
    df = spark.createDataFrame(rows, "nr string, pos int, top double, bottom double").withColumn("surface", F.lit(1.0))
    use = validation.ValidationSettings
    assert ids(validation.validate(df, F.col("pos"), use())) == "b"
    assert [r.is_valid for r in validation.validate(df, F.col("pos"), use(FLAG_INVALID=True)).orderBy("pos").collect()] == [True, False, True, True, True]
    assert validation.validate(df, F.col("pos"), use(DROP_INVALID=False)).count() == 5


def test_gef_text():
    text_ = '#GEFID = 1,1,0\n#TESTID = T1\n#XYID = 31000, 10.5, 20.5\n#ZID = 31000, 1.5\n#COLUMNINFO = 1, m, length, 1\n#COLUMNINFO = 2, MPa, qc, 2\n#COLUMNINFO = 3, MPa, fs, 3\n#COLUMNVOID = 2, -99\n#MEASUREMENTVAR = 16, 2.5, m, end\n#EOH=\n1.0 2.0 0.1 !\n2.0 -99 0.1 !\n2.5 1 !\n'
    head, rows = readers.parse_gef(text_)
    assert head["nr"] == "T1" and head["end"] == -1.0 and (head["x"], head["y"]) == (10.5, 20.5)
    assert len(rows) == 2 and rows[0]["rf"] == pytest.approx(5) and rows[1]["qc"] is None and rows[1]["depth"] == 2.0


def test_normalised_depths(data):
    want = sorted((r.nr, r.top, r.bottom) for r in data.collect())
    for made in (data, data.withColumns({c: -F.col(c) for c in ("top", "bottom")}), data.withColumns({c: F.col("surface") - F.col(c) for c in ("top", "bottom")})):
        assert sorted((r.nr, round(r.top, 6), round(r.bottom, 6)) for r in layers.adjust_depths(made).collect()) == want


def test_many_edges_are_met_like_few(spark, monkeypatch):
    import math

    ring = [(50 + (40 - 15 * (i % 2)) * math.cos(2 * math.pi * i / 66), 50 + (40 - 15 * (i % 2)) * math.sin(2 * math.pi * i / 66)) for i in range(66)]
    hole = [(45.0, 45.0), (55.0, 45.0), (55.0, 55.0), (45.0, 55.0)]
    star = geometry.Geometry("POLYGON", [[*ring, ring[0]], [*hole, hole[0]]])
    box = geometry.Geometry("POLYGON", [[(i * 1.5, 10.0) for i in range(61)] + [(90.0, 60.0), (0.0, 60.0), (0.0, 10.0)]])
    grid = spark.range(41 * 41).selectExpr("string(id) as nr", "double(id % 41) * 2.5 as x", "double(floor(id / 41)) * 2.5 as y")
    checks = [
        lambda: spatial.select_within_polygons(grid, star),
        lambda: spatial.select_within_polygons(grid, star, 1.5),
        lambda: spatial.select_with_lines(grid, geometry.Geometry("LINESTRING", ring), 2.5),
        lambda: spatial.spatial_join(grid, [("s", star), ("b", box)], "label"),
        lambda: spatial.spatial_join(grid, [("b", box)], "label", predicate="within"),
        lambda: spatial.spatial_join(grid, [("s", star)], "label", predicate="dwithin", distance=2),
        lambda: spatial.spatial_join(grid, [("s", star)], "label", predicate="disjoint"),
    ]
    many = [sorted(map(str, f().collect())) for f in checks]
    monkeypatch.setattr(spatial, "MANY_EDGES", 10_000)
    few = [sorted(map(str, f().collect())) for f in checks]
    assert many == few and all(50 < len(x) < 41 * 41 for x in many)
    monkeypatch.undo()
    coast = [(50 + 40 * math.cos(2 * math.pi * i / 20_000), 50 + 40 * math.sin(2 * math.pi * i / 20_000)) for i in range(20_000)]
    assert abs(spatial.select_within_polygons(grid, geometry.Geometry("POLYGON", [coast])).count() - math.pi * 1600 / 6.25) < 15
