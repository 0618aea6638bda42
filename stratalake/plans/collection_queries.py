"""Queries of collections, meshes and transforms over the derived relations, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..collection import Collection
from ..functions import crs, geometry, text, units
from ..operators import header, spatial, validation
from ..sources import mesh
from . import derive
from .queries import EDGE, INSIDE, LINE, NEAR, POINTS, SHAPES, WKT, H, L, M, V, query, segment_sql

HEAD = 'select nr, x, y, surface, "end" from header where '
DATA = "select * from layers where nr in (select nr from header where "


def C(spark: SparkSession, sf_dir: str) -> Collection:
    return Collection(H(spark, sf_dir), L(spark, sf_dir), crs=28992)


def head(c: Collection) -> DataFrame:
    return c.header.select("nr", "x", "y", "surface", "end")


@query(HEAD + "nr in (select nr from layers where lith in ('V', 'L') group by nr having count(distinct lith) = 2)")
def collection_select_values(spark, d):
    return head(C(spark, d).select_by_values("lith", ["V", "L"], how="and"))


@query(HEAD + "nr in (select nr from layers where lith = 'Z')")
def collection_slice_values(spark, d):
    return head(C(spark, d).slice_by_values("lith", "Z"))


@query(HEAD + "nr in (select nr from layers where top > 12 and lith = 'K')")
def collection_condition(spark, d):
    return head(C(spark, d).select_by_condition((F.col("top") > 12) & (F.col("lith") == "K")))


@query(HEAD + "nr in (select nr from layers where bottom > 9 and top < 12)")
def collection_slice_depth(spark, d):
    return head(C(spark, d).slice_depth_interval(9, 12))


@query(DATA + """surface between 1 and 3 and "end" between -20 and -5)""")
def collection_elevation(spark, d):
    return C(spark, d).select_by_elevation(1, 3, -20, -5).data


@query(DATA + """surface - "end" between 8 and 16)""")
def collection_length(spark, d):
    return C(spark, d).select_by_length(8, 16).data


@query(DATA + "x between 8 and 40 and y between 4 and 32)")
def collection_bbox(spark, d):
    return C(spark, d).select_within_bbox(8, 4, 40, 32).data


@query(DATA + f"{NEAR})")
def collection_near_points(spark, d):
    return C(spark, d).select_with_points(POINTS, 6).data


@query(DATA + f"not ({segment_sql(LINE)} < 9))")
def collection_near_lines_invert(spark, d):
    return C(spark, d).select_with_lines(geometry.Geometry("LINESTRING", LINE), 3, invert=True).data


@query(DATA + f"{INSIDE} and not {EDGE})")
def collection_within_polygon(spark, d):
    return C(spark, d).select_within_polygons(WKT).data


@query(f"""with a as (select h.*, case when {INSIDE} or {EDGE} then 'one' end as a1, case when x between 30 and 50 and y between 20 and 45 then 'two' end as a2 from header h)
select nr, x, y, surface, "end", a1 as area from a where a1 is not null union all select nr, x, y, surface, "end", a2 from a where a2 is not null or a1 is null""")
def collection_spatial_join(spark, d):
    return C(spark, d).spatial_join(SHAPES, "area", include_in_header=True).header


@query("select nr, x, y, surface, \"end\" from header where nr in (7, 32, 65)")
def collection_get(spark, d):
    return head(C(spark, d).get([7, 32, 65]))


@query("""select h.nr, h.surface, t.t as "V_top" from header h left join (select nr, min(top) as t from layers where lith = 'V' group by nr) t using (nr)""")
def collection_layer_top(spark, d):
    return C(spark, d).get_layer_top("lith", "V", include_in_header=True).header.select("nr", "surface", "V_top")


@query("""select h.nr, h.surface, t.t as "Z,V_base" from header h left join (select nr, max(bottom) as t from layers where lith in ('Z', 'V') and bottom - top >= 1 group by nr) t using (nr)""")
def collection_layer_base(spark, d):
    return C(spark, d).get_layer_base("lith", ["Z", "V"], min_thickness=1, include_in_header=True).header.select("nr", "surface", "`Z,V_base`")


@query("""select nr, "end" from header""")
def collection_end_depth(spark, d):
    return C(spark, d).determine_end_depth()


@query("select nr, x, y, surface - top as top, surface - bottom as bottom, lith from layers")
def depth_relative_to_surface(spark, d):
    return header.depth_relative_to_surface(L(spark, d)).select("nr", "x", "y", "top", "bottom", "lith")


@query(r"select page_id, regexp_replace(url, '[^\p{L}\p{N}_.,:;!?()\-]', '', 'g') as cleaned from pages")
def clean_string(spark, d):
    return derive.table(spark, d, "pages").select("page_id", text.clean_string(F.col("url")).alias("cleaned"))


@query("select n_nationkey, case when n_nationkey % 3 = 0 then 'Unknown_height_system_(meters)' when n_nationkey % 3 = 1 then 'LAT depth' else n_name end as datum from nation")
def vertical_datum(spark, d):
    named = F.when(F.col("n_nationkey") % 3 == 1, "LAT").when(F.col("n_nationkey") % 3 == 2, F.col("n_name"))
    return derive.table(spark, d, "nation").select("n_nationkey", text.parse_vertical_datum(named).alias("datum"))


# Meshes


@query("select nr, x, y, (surface - depth) * 2.5 as z from measurements")
def mesh_measurement_points(spark, d):
    return mesh.continuous_points(M(spark, d), 2.5)


@query("select nr, 0 as end_no, x, y, surface - top as z from layers union all select nr, 1, x, y, surface - bottom from layers")
def mesh_layer_points(spark, d):
    return mesh.layer_points(L(spark, d))


RING = [(round(0.5 * math.cos(math.pi * i / 3), 9), round(0.5 * math.sin(math.pi * i / 3), 9)) for i in range(6)]


@query(f"""with r as (select * from (values {', '.join(f'({i}, {a!r}::double, {b!r}::double)' for i, (a, b) in enumerate(RING))}) t(i, dx, dy))
select nr, lith, (e * 6 + i)::int as k, round(x + dx, 6) as x, round(y + dy, 6) as y, case when e = 0 then surface - bottom else surface - top end as z from layers, r, (values (0), (1)) s(e)""")
def mesh_cylinders(spark, d):
    out = mesh.cylinders(L(spark, d), 0.5, n_sides=6).select("nr", "lith", F.posexplode("corners").alias("k", "p"))
    return out.select("nr", "lith", "k", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"), "p.z")


@query("""select v.x, v.y, v.z, v.lith, ox, oy, oz, nx, ny, nz from voxels v, (select min(x) - 0.5 as ox, min(y) - 0.5 as oy, min(z) - 0.25 as oz,
(count(distinct x) + 1)::int as nx, (count(distinct y) + 1)::int as ny, (count(distinct z) + 1)::int as nz from voxels)""")
def mesh_structured_grid(spark, d):
    meta, cells = mesh.structured_grid(V(spark, d))
    grid = dict(zip(("ox", "oy", "oz", "nx", "ny", "nz"), (*meta["origin"], *meta["dimensions"])))
    return cells.withColumns({k: F.lit(v) for k, v in grid.items()})


# Voxels


@query("""with k as (select *, z <= -5 - x as hi, z >= -12 - x as lo from voxels),
h as (select * from k where x in (select x from k where hi) and y in (select y from k where hi) and z in (select z from k where hi)),
b as (select * from h where x in (select x from h where lo) and y in (select y from h where lo) and z in (select z from h where lo))
select x, y, z, case when hi and lo then lith end as lith from b""")
def voxel_slice_grid_drop(spark, d):
    m = V(spark, d)
    xs = m.df.select("x").distinct()
    return m.slice_depth_interval(xs.select("x", (-5 - F.col("x")).alias("bound")), xs.select("x", (-12 - F.col("x")).alias("bound")), how="majority").df


@query("""with c as (select x, y, v as value, sum(case when lith = v then 1 else 0 end)::double as n from voxels, (values (1), (2), (3)) t(v) group by x, y, v)
select x, y, value, case when sum(n) over (partition by x, y) > 0 then n / sum(n) over (partition by x, y) end as share from c""")
def voxel_counts_dim_norm(spark, d):
    return V(spark, d).value_counts("lith", dim="z", normalize=True)


@query("select x, y, z, case lith when 1 then 'EC' when 2 then 'NI' when 3 then 'KK' end as unit from voxels")
def stratigraphy_lookup(spark, d):
    return derive.voxel_cells(spark, d).withColumn("unit", units.stratigraphy.name_of(2000 + 10 * F.col("lith"))).select("x", "y", "z", "unit")


# Validation

WORSE = """with b as (select nr, surface, case when nr % 7 = 0 and kind = 'click' then depth - 0.5 else depth end as depth, qc, cast(depth * 8 as bigint) as pos from measurements),
v as (select *, coalesce(depth <= lag(depth) over (partition by nr order by pos), false) as bad from b)
"""


@query(WORSE + "select nr, surface, depth, qc, pos, not bad as is_valid from v")
def validate_discrete(spark, d):
    worse = F.when((F.col("nr") % 7 == 0) & (F.col("kind") == "click"), F.col("depth") - 0.5).otherwise(F.col("depth"))
    df = M(spark, d).withColumn("pos", (F.col("depth") * 8).cast("long")).withColumn("depth", worse)
    out = validation.validate(df, F.col("pos"), validation.ValidationSettings(FLAG_INVALID=True))
    return out.select("nr", "surface", "depth", "qc", "pos", "is_valid")


# Geometries and reference systems


@query(HEAD + "x > 30 and x < 50 and y > 20 and y < 45")
def spatial_join_within(spark, d):
    return spatial.spatial_join(H(spark, d), SHAPES[1:], "area", predicate="within").drop("area")


@query(HEAD + f"{INSIDE} or {EDGE} or {segment_sql([(10.0, 5.0), (40.0, 12.0), (33.0, 40.0), (8.0, 30.0)], True)} <= 4")
def spatial_join_dwithin(spark, d):
    return spatial.spatial_join(H(spark, d), SHAPES[:1], "area", predicate="dwithin", distance=2).drop("area")


@query("select nr, x / 3 as x, 0.5 - y as y from header")
def wkb_points(spark, d):
    made = H(spark, d).select("nr", geometry.point_wkb(F.col("x") / 3, 0.5 - F.col("y")).alias("wkb"))
    x, y = geometry.wkb_point(F.col("wkb"))
    return made.select("nr", x.alias("x"), y.alias("y"))


def steps_sql(first: str, steps: list[tuple[str, str]], last: str) -> str:
    """Nested selects, each with one more column; ``last`` picks the columns."""
    for name, value in steps:
        first = f"select *, {value} as {name} from ({first})"
    return f"select {last} from ({first})"


def _rd_sql() -> str:
    """The oblique stereographic projection and the shift of seven parameters, as published."""
    k, r = crs._sphere(), {n: math.radians(v / 3600) for n, v in zip(("rx", "ry", "rz"), crs.ROTATION)}
    size, scale = 2 * k["R"] * crs.RD_SCALE, 1 + crs.SCALE * 1e-6
    g = size * math.tan(math.pi / 4 - k["lat"] / 2)
    h = 2 * size * math.tan(k["lat"]) + g

    def e2(ellipsoid: tuple[float, float]) -> float:
        return (2 - 1 / ellipsoid[1]) / ellipsoid[1]

    steps = [
        ("i", f"atan2(dx, {h!r} + dy)"),
        ("j", f"atan2(dx, {g!r} - dy) - i"),
        ("chi", f"{k['lat']!r} + 2 * atan((dy - dx * tan(j / 2)) / {size!r})"),
        ("lam", f"(j + 2 * i) / {k['n']!r} + {k['lon']!r}"),
        ("psi", f"0.5 * ln((1 + sin(chi)) / ({k['c']!r} * (1 - sin(chi)))) / {k['n']!r}"),
        ("p0", "2 * atan(exp(psi)) - pi() / 2"),
    ]
    for n in range(6):
        p = f"p{n}"
        iso = f"ln(tan({p} / 2 + pi() / 4) * pow((1 - {k['e']!r} * sin({p})) / (1 + {k['e']!r} * sin({p})), {k['e'] / 2!r}))"
        steps.append((f"p{n + 1}", f"{p} - ({iso} - psi) * cos({p}) * (1 - {k['e2']!r} * sin({p}) * sin({p})) / {1 - k['e2']!r}"))
    steps += [
        ("nn", f"{crs.BESSEL[0]!r} / sqrt(1 - {e2(crs.BESSEL)!r} * sin(p6) * sin(p6))"),
        ("gx", "nn * cos(p6) * cos(lam)"),
        ("gy", "nn * cos(p6) * sin(lam)"),
        ("gz", f"nn * {1 - e2(crs.BESSEL)!r} * sin(p6)"),
        ("wx", f"{crs.SHIFT[0]!r} + {scale!r} * (gx - {r['rz']!r} * gy + {r['ry']!r} * gz)"),
        ("wy", f"{crs.SHIFT[1]!r} + {scale!r} * ({r['rz']!r} * gx + gy - {r['rx']!r} * gz)"),
        ("wz", f"{crs.SHIFT[2]!r} + {scale!r} * (-{r['ry']!r} * gx + {r['rx']!r} * gy + gz)"),
        ("pp", "sqrt(wx * wx + wy * wy)"),
        ("th", f"atan2(wz * {crs.WGS84[0]!r}, pp * {crs.WGS84[0] * (1 - 1 / crs.WGS84[1])!r})"),
        ("la", f"atan2(wz + {e2(crs.WGS84) / (1 - e2(crs.WGS84)) * crs.WGS84[0] * (1 - 1 / crs.WGS84[1])!r} * pow(sin(th), 3), pp - {e2(crs.WGS84) * crs.WGS84[0]!r} * pow(cos(th), 3))"),
    ]
    first = f"select nr, x * 1000 + 100000 - {crs.RD_X!r} as dx, y * 1000 + 400000 - {crs.RD_Y!r} as dy from header"
    return steps_sql(first, steps, "nr, round(degrees(atan2(wy, wx)), 6) as lon, round(degrees(la), 6) as lat")


def _moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H(spark, sf_dir).withColumns({"x": F.col("x") * 1000 + 100000, "y": F.col("y") * 1000 + 400000})


@query(_rd_sql())
def transform_coordinates(spark, d):
    return crs.transform_coordinates(_moved(spark, d), 28992, 4326).select("nr", F.round("x", 6).alias("lon"), F.round("y", 6).alias("lat"))


@query("select nr, x * 1000 + 100000 as x, y * 1000 + 400000 as y from header")
def transform_there_and_back(spark, d):
    there = crs.transform_coordinates(crs.transform_coordinates(_moved(spark, d), 28992, 32631), 32631, 28992)
    return there.select("nr", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))


@query("select nr, round(6378137 * radians(3 + x / 50), 3) as x, round(6378137 * ln(tan(pi() / 4 + radians(50 + y / 50) / 2)), 3) as y from header")
def transform_web_mercator(spark, d):
    degrees = H(spark, d).select("nr", (3 + F.col("x") / 50).alias("x"), (50 + F.col("y") / 50).alias("y"))
    return crs.transform_coordinates(degrees, 4326, 3857).select("nr", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


#: Fixed values of GRS 80 and of the European equal-area grid, as published, for SQL of their own: e^2, e, half the axis.
E2, E1 = "0.0066943800229034::double", "0.0818191910428158::double"


def _q_sql(sin: str) -> str:
    return f"((1 - {E2}) * ({sin} / (1 - {E2} * {sin} * {sin}) - ln((1 - {E1} * {sin}) / (1 + {E1} * {sin})) / (2 * {E1})))"


_EQUAL_AREA = steps_sql(
    "select nr, radians(3 + x / 50) as lam, sin(radians(50 + y / 50)) as s, sin(radians(52)) as s0 from header",
    [("qp", _q_sql("1.0::double")), ("b", f"asin({_q_sql('s')} / qp)"), ("b0", f"asin({_q_sql('s0')} / qp)"), ("r", "6378137 * sqrt(qp / 2)"),
     ("dd", f"6378137 * cos(radians(52)) / sqrt(1 - {E2} * s0 * s0) / (r * cos(b0))"), ("dl", "lam - radians(10)"),
     ("k", "r * sqrt(2 / (1 + sin(b0) * sin(b) + cos(b0) * cos(b) * cos(dl)))")],
    "nr, round(4321000 + k * dd * cos(b) * sin(dl), 2) as x, round(3210000 + k / dd * (cos(b0) * sin(b) - sin(b0) * cos(b) * cos(dl)), 2) as y",
)


@query(_EQUAL_AREA)
def transform_equal_area(spark, d):
    degrees = H(spark, d).select("nr", (3 + F.col("x") / 50).alias("x"), (50 + F.col("y") / 50).alias("y"))
    return crs.transform_coordinates(degrees, 4258, 3035).select("nr", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))
