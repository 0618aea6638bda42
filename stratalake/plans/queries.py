"""A query an operator over the derived relations, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geotech, text, units
from ..operators import combine, header, layers, selection, spatial, validation, voxel
from ..predicates import column_name_from
from ..roles import Roles
from ..sources import mesh, sinks
from . import derive

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
L, H, M, V = derive.layers, derive.header, derive.measurements, derive.voxels
POLYGON = [(10.0, 5.0), (40.0, 12.0), (33.0, 40.0), (8.0, 30.0)]
WKT = "POLYGON ((" + ", ".join(f"{a} {b}" for a, b in [*POLYGON, POLYGON[0]]) + "))"
POINTS = [(10.0, 10.0), (30.0, 20.0), (50.0, 40.0)]
LINE = [(0.0, 0.0), (32.0, 24.0), (60.0, 10.0)]


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = derive.with_relations(sql)
        return f

    return register


def ray_sql(x: str = "x", y: str = "y", ring: list = POLYGON) -> tuple[str, str]:
    """(inside by crossings, on an edge) in SQL."""
    closed = [*ring, ring[0]]
    cross, edge = [], []
    for (px, py), (qx, qy) in zip(closed, closed[1:]):
        if py != qy:
            cross.append(f"case when (({y} < {py!r}::double) <> ({y} < {qy!r}::double)) and {x} < {qx - px!r}::double * ({y} - {py!r}::double) / {qy - py!r}::double + {px!r}::double then 1 else 0 end")
        edge.append(f"(({x} - {px!r}::double) * {qy - py!r}::double - ({y} - {py!r}::double) * {qx - px!r}::double = 0 and {x} between {min(px, qx)!r} and {max(px, qx)!r} and {y} between {min(py, qy)!r} and {max(py, qy)!r})")
    return f"(({' + '.join(cross)}) % 2 = 1)", f"({' or '.join(edge)})"


def segment_sql(points: list, closed: bool = False) -> str:
    """Least squared distance to the segments in SQL."""
    points = [*points, points[0]] if closed else points
    parts = []
    for (px, py), (qx, qy) in zip(points, points[1:]):
        dx, dy = qx - px, qy - py
        t = f"greatest(0.0::double, least(1.0::double, ((x - {px!r}::double) * {dx!r}::double + (y - {py!r}::double) * {dy!r}::double) / {dx * dx + dy * dy!r}::double))"
        parts.append(f"(x - ({px!r}::double + {t} * {dx!r}::double)) ** 2 + (y - ({py!r}::double + {t} * {dy!r}::double)) ** 2")
    return f"least({', '.join(parts)})"


INSIDE, EDGE = ray_sql()


@query("""
with s as (select nr from header where x between 8 and 40 and y between 4 and 32),
t as (select nr, greatest(top, 2) as top, least(bottom, 6) as bottom, lith from layers where bottom > 2 and top < 6 and nr in (select nr from s)),
a as (select nr, sum(bottom - top) as "Z_thickness" from t where lith = 'Z' group by nr)
select h.nr, h.x, h.y, h.surface, a."Z_thickness" from header h join (select distinct nr from t) using (nr) left join a on a.nr = h.nr""")
def sand_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: sand thickness between 2 m and 6 m depth of the surveys inside a box."""
    data = selection.slice_depth_interval(spatial.select_within_bbox(L(spark, sf_dir), 8, 4, 40, 32), 2, 6)
    head = data.groupBy("nr").agg(*[F.first(c).alias(c) for c in ("x", "y", "surface")])
    sand = layers.cumulative_thickness(data, "lith", "Z").withColumnRenamed("thickness", column_name_from("Z", suffix="_thickness"))
    return head.join(sand, "nr", "left")


@query("select * from layers")
def scan_layers(spark, d):
    return L(spark, d)


@query("select * from measurements")
def scan_measurements(spark, d):
    return M(spark, d)


@query("""select nr, x, y, surface from header""")
def to_header(spark, d):
    return header.to_header(L(spark, d))


@query("""select nr, surface, x, y, top, bottom as depth, lith from layers""")
def standardize(spark, d):
    return header.standardize_column_names(L(spark, d).withColumnRenamed("bottom", "BOTTOM_DEPTH"))


@query("""select nr, bottom, row_number() over (partition by nr order by top, bottom) = 1 as first_row,
lead(nr) over (partition by nr order by top, bottom) is null as last_row from layers""")
def first_last_row(spark, d):
    df = L(spark, d)
    return df.select("nr", "bottom", header.first_row_survey(df).alias("first_row"), header.last_row_survey(df).alias("last_row"))


@query("""select nr, bottom, surface - max(bottom) over (partition by nr) as end_depth from layers""")
def end_depth(spark, d):
    df = L(spark, d)
    return df.select("nr", "bottom", layers.determine_end_depth(df).alias("end_depth"))


@query("""select nr, bottom, bottom - top as thickness from layers""")
def thickness_layered(spark, d):
    return layers.with_thickness(L(spark, d)).select("nr", "bottom", "thickness")


@query("""select nr, depth, depth - lag(depth, 1, 0::double) over (partition by nr order by depth) as thickness from measurements""")
def thickness_discrete(spark, d):
    return layers.with_thickness(M(spark, d)).select("nr", "depth", "thickness")


@query("select * from layers where nr in (select nr from layers where lith = 'V')")
def select_eq(spark, d):
    return selection.select_by_values(L(spark, d), "lith", "V")


@query("select * from layers where nr in (select nr from layers where lith in ('V', 'L'))")
def select_any(spark, d):
    return selection.select_by_values(L(spark, d), "lith", ["V", "L"])


@query("select * from layers where nr in (select nr from layers where lith in ('V', 'L') group by nr having count(distinct lith) = 2)")
def select_all(spark, d):
    return selection.select_by_values(L(spark, d), "lith", ["V", "L"], how="and")


@query("select * from layers where nr in (select nr from layers where bottom between 3.5 and 10)")
def select_range(spark, d):
    return selection.select_by_values(L(spark, d), "bottom", slice(3.5, 10))


@query("select * from layers where nr not in (select nr from layers where lith in ('V', 'L'))")
def select_invert(spark, d):
    return selection.select_by_values(L(spark, d), "lith", ["V", "L"], invert=True)


@query("select * from layers where lith in ('Z', 'K')")
def slice_values(spark, d):
    return selection.slice_by_values(L(spark, d), "lith", ["Z", "K"])


@query("select * from layers where lith not in ('Z', 'K')")
def slice_values_invert(spark, d):
    return selection.slice_by_values(L(spark, d), "lith", ["Z", "K"], invert=True)


@query("select * from layers where bottom > 1.5 and bottom < 6.25")
def slice_range_neither(spark, d):
    return selection.slice_by_values(L(spark, d), "bottom", slice(1.5, 6.25), inclusive="neither")


@query("select * from layers where lith = 'V' and top > 4")
def select_condition(spark, d):
    return selection.select_by_condition(L(spark, d), (F.col("lith") == "V") & (F.col("top") > 4))


@query("""select nr, x, y, surface, "end" from header where surface between 1 and 3 and "end" between -20 and -5""")
def elevation(spark, d):
    return selection.select_by_elevation(H(spark, d), 1, 3, -20, -5)


@query("""select * from layers where nr in (select nr from layers group by nr having max(bottom) between 8 and 16)""")
def length(spark, d):
    return selection.select_by_length(L(spark, d), 8, 16)


@query("select nr, x, y, surface, greatest(top, 1.5) as top, least(bottom, 6.0) as bottom, lith from layers where bottom > 1.5 and top < 6")
def slice_depth(spark, d):
    return selection.slice_depth_interval(L(spark, d), 1.5, 6)


@query("select nr, x, y, surface, greatest(top, surface + 2) as top, least(bottom, surface + 5) as bottom, lith from layers where bottom > surface + 2 and top < surface + 5")
def slice_depth_nap(spark, d):
    return selection.slice_depth_interval(L(spark, d), -2, -5, relative_to_vertical_reference=True)


@query("select * from layers where bottom > 1.5 and top < 6")
def slice_depth_noupdate(spark, d):
    return selection.slice_depth_interval(L(spark, d), 1.5, 6, update_layer_boundaries=False)


@query("select * from measurements where depth between 1.5 and 6")
def slice_depth_discrete(spark, d):
    return selection.slice_depth_interval(M(spark, d), 1.5, 6)


@query("""select nr, x, y, surface, "end" from header where x between 8 and 40 and y between 4 and 32""")
def bbox(spark, d):
    return spatial.select_within_bbox(H(spark, d), 8, 4, 40, 32)


@query("""select nr, x, y, surface, "end" from header where not (x between 8 and 40 and y between 4 and 32)""")
def bbox_invert(spark, d):
    return spatial.select_within_bbox(H(spark, d), 8, 4, 40, 32, invert=True)


NEAR = " or ".join(f"(x - {a}) ** 2 + (y - {b}) ** 2 < 36" for a, b in POINTS)


@query(f"""select nr, x, y, surface, "end" from header where {NEAR}""")
def near_points(spark, d):
    return spatial.select_with_points(H(spark, d), POINTS, 6)


@query(f"""select nr, x, y, surface, "end" from header where not ({NEAR})""")
def near_points_invert(spark, d):
    return spatial.select_with_points(H(spark, d), POINTS, 6, invert=True)


@query("""select nr, x, y, surface, "end" from header h where exists (select 1 from supplier s where
(x - cast(s_suppkey * 7 % 64 as double)) ** 2 + (y - cast(s_suppkey * 5 % 48 as double)) ** 2 < 2.25)""")
def near_point_table(spark, d):
    points = derive.table(spark, d, "supplier").select(F.col("s_suppkey").alias("nr"), (F.col("s_suppkey") * 7 % 64).cast("double").alias("x"), (F.col("s_suppkey") * 5 % 48).cast("double").alias("y"))
    return spatial.select_with_points(H(spark, d), points, 1.5)


@query(f"""select nr, x, y, surface, "end" from header where {segment_sql(LINE)} < 9""")
def near_lines(spark, d):
    from ..functions.geometry import Geometry

    return spatial.select_with_lines(H(spark, d), Geometry("LINESTRING", LINE), 3)


@query(f"""select nr, x, y, surface, "end" from header where {INSIDE} and not {EDGE}""")
def within_polygon(spark, d):
    return spatial.select_within_polygons(H(spark, d), WKT)


@query(f"""select nr, x, y, surface, "end" from header where {INSIDE} or {EDGE} or {segment_sql(POLYGON, True)} < 4""")
def within_polygon_buffer(spark, d):
    return spatial.select_within_polygons(H(spark, d), WKT, buffer=2)


AREAS = f"""with areas as (select h.*, case when ({INSIDE} or {EDGE}) then 'one' end as a1, case when x between 30 and 50 and y between 20 and 45 then 'two' end as a2 from header h)"""
SHAPES = [("one", WKT), ("two", "POLYGON ((30 20, 50 20, 50 45, 30 45, 30 20))")]


@query(AREAS + """ select nr, x, y, surface, "end", a1 as area from areas where a1 is not null union all select nr, x, y, surface, "end", a2 from areas where a2 is not null""")
def spatial_join_inner(spark, d):
    return spatial.spatial_join(H(spark, d), SHAPES, "area")


@query(AREAS + """ select nr, x, y, surface, "end", a1 as area from areas where a1 is not null union all select nr, x, y, surface, "end", a2 from areas where a2 is not null
union all select nr, x, y, surface, "end", null from areas where a1 is null and a2 is null""")
def spatial_join_left(spark, d):
    return spatial.spatial_join(H(spark, d), SHAPES, "area", how="left")


@query("select nr, sum(bottom - top) as thickness from layers where lith in ('Z', 'K') group by nr")
def cum_thickness(spark, d):
    return layers.cumulative_thickness(L(spark, d), "lith", ["Z", "K"])


@query("""select h.nr, h.surface, t.t as "L,Z_thickness" from header h left join (select nr, sum(bottom - top) as t from layers where lith in ('L', 'Z') group by nr) t using (nr)""")
def cum_thickness_header(spark, d):
    from ..collection import Collection

    c = Collection.of(L(spark, d)).get_cumulative_thickness("lith", ["L", "Z"], include_in_header=True)
    return c.header.select("nr", "surface", "`L,Z_thickness`")


@query("""select nr, sum(t) as thickness from (select nr, qc, depth - lag(depth, 1, 0::double) over (partition by nr order by depth) as t from measurements) where qc between 10 and 60 group by nr""")
def cum_thickness_discrete(spark, d):
    return layers.cumulative_thickness(M(spark, d), "qc", slice(10, 60))


@query("select nr, min(top) as top from layers where lith = 'V' group by nr")
def layer_top(spark, d):
    return layers.layer_top(L(spark, d), "lith", "V")


RUNS = """with r0 as (select nr, lith = 'Z' as ok, top, bottom, lag(lith = 'Z') over (partition by nr order by top, bottom) as was from layers),
r1 as (select *, sum(case when ok is not distinct from was then 0 else 1 end) over (partition by nr order by top, bottom rows between unbounded preceding and current row) as run from r0),
runs as (select nr, run, bool_or(ok) as ok, min(top) as top, max(bottom) as bottom from r1 group by nr, run)
"""


@query(RUNS + "select nr, min(top) as top from runs where ok and bottom - top >= 4 group by nr")
def layer_top_thick(spark, d):
    return layers.layer_top(L(spark, d), "lith", "Z", min_thickness=4)


SHARE = """select a.nr, a.top, sum(case when b.ok then least(b.bottom, a.top + {t}) - b.top else 0 end) / {t} as share
from {r} a join {r} b on a.nr = b.nr and b.top >= a.top and b.top < a.top + {t} where a.ok group by a.nr, a.top"""


@query(RUNS + f"select nr, min(top) as top from ({SHARE.format(t=4, r='runs')}) where share > 0.75 or abs(share - 0.75) <= 1e-8 + 1e-5 * 0.75 group by nr")
def layer_top_frac(spark, d):
    return layers.layer_top(L(spark, d), "lith", "Z", min_thickness=4, min_fraction=0.75)


@query("select nr, max(bottom) as base from layers where lith in ('Z', 'V') and bottom - top >= 1 group by nr")
def layer_base(spark, d):
    return layers.layer_base(L(spark, d), "lith", ["Z", "V"], min_thickness=1)


@query("with s as (select nr, lith = 'Z' as ok, top, bottom from layers) select h.nr, t.top from header h left join (select nr, min(top) as top from (" + SHARE.format(t=2, r="s") + ") where share >= 0.5 group by nr) t on t.nr = h.nr")
def top_of_sand(spark, d):
    return layers.top_of_sand(L(spark, d), fraction=0.5, reach=2.0)


@query("""with c as (select nr, top, bottom, lith, lag(lith) over (partition by nr order by top, bottom) as was from layers)
select nr, bottom, sum(case when lith = was then 0 else 1 end) over (partition by nr order by top, bottom rows between unbounded preceding and current row) as run from c""")
def run_labels(spark, d):
    df = L(spark, d)
    return df.select("nr", "bottom", layers.run_label(F.col("lith"), Roles.of(df).window()).alias("run"))


IC = "sqrt((3.47 - log10(qc / 0.1)) ** 2 + (log10(rf) + 1.22) ** 2)"
CPT = "with c as (select event_id, value / 10 + 0.1 as qc, cast(event_id % 90 as double) / 10 + 0.1 as rf from events)"


def _cpt(spark, d):
    return derive.table(spark, d, "events").select("event_id", (F.col("value") / 10 + 0.1).alias("qc"), ((F.col("event_id") % 90).cast("double") / 10 + 0.1).alias("rf"))


@query(CPT + f" select event_id, round({IC}, 6) as ic from c")
def calc_ic(spark, d):
    return _cpt(spark, d).select("event_id", F.round(geotech.calc_ic(F.col("qc"), F.col("rf")), 6).alias("ic"))


@query(CPT + f""", i as (select *, {IC} as ic from c) select event_id, case when ic >= 3.6 and rf <= 8 then 'Kh' when (rf > 5 and qc < 1.5) or rf > 6 then 'V'
when ic >= 3.6 and rf > 8 then 'V' when ic < 2.6 then 'Z' when ic < 2.95 then 'Kz' when ic < 3.6 then 'K' else 'NBE' end as lith from i""")
def calc_lithology(spark, d):
    df = _cpt(spark, d).withColumn("ic", geotech.calc_ic(F.col("qc"), F.col("rf")))
    return df.select("event_id", geotech.calc_lithology(F.col("ic"), F.col("qc"), F.col("rf")).alias("lith"))


def _grain(spark, d):
    parts = {n: ((F.col("p_partkey") * (i + 3) + F.col("p_size") * (i + 1)) % 17).cast("double") for i, (n, _) in enumerate(geotech.CLASSES)}
    return derive.table(spark, d, "part").select("p_partkey", *[v.alias(n) for n, v in parts.items()], (F.col("p_partkey") % 3).cast("double").alias(geotech.COARSEST))


def _percentiles_sql(names: list[str], only_sand: bool) -> str:
    picked = [(n, s, i) for i, (n, s) in enumerate(geotech.CLASSES) if not only_sand or 63 < s <= 2000]
    values = ", ".join(f"cast((p_partkey * {i + 3} + p_size * {i + 1}) % 17 as double)" for _, _, i in picked)
    sizes = [63.0 if only_sand else 0.0] + [s for _, s, _ in picked]
    out = []
    for n in names:
        p = float(n[1:].split("_")[0])
        j = f"len(list_filter(xp, lambda v: v <= {p}))"
        out.append(f"round(case when tot > 0 then case when {j} = 0 then g[1] when {j} = len(xp) then g[len(xp)] else g[{j}] + (g[{j} + 1] - g[{j}]) / (xp[{j} + 1] - xp[{j}]) * ({p} - xp[{j}]) end end, 6) as {n}")
    return f"""with a as (select p_partkey, [{values}] as v from part), b as (select p_partkey, list_transform(range(1, len(v) + 1), lambda i: list_sum(v[1:i])) as s, list_sum(v) as tot from a),
c as (select p_partkey, tot, list_transform(list_prepend(0.0::double, s), lambda q: q / nullif(tot, 0) * 100) as xp, [{', '.join(f'{s!r}::double' for s in sizes)}] as g from b)
select p_partkey, {', '.join(out)} from c"""


@query(_percentiles_sql(["d10", "d50", "d90"], False))
def grain_percentiles(spark, d):
    out = geotech.grainsize_percentiles(_grain(spark, d), [10, 50, 90])
    return out.select("p_partkey", *[F.round(c, 6).alias(c) for c in ("d10", "d50", "d90")])


@query(_percentiles_sql(["d10_sand", "d50_sand"], True))
def grain_percentiles_sand(spark, d):
    out = geotech.grainsize_percentiles(_grain(spark, d), [10, 50], only_sand=True)
    return out.select("p_partkey", *[F.round(c, 6).alias(c) for c in ("d10_sand", "d50_sand")])


def _sum_sql(which) -> str:
    return " + ".join(f"cast((p_partkey * {i + 3} + p_size * {i + 1}) % 17 as double)" for i, (_, s) in enumerate(geotech.CLASSES) if which(s))


@query(f"select p_partkey, {_sum_sql(lambda s: s == 63)} as perc_fines, {_sum_sql(lambda s: 63 < s <= 2000)} as perc_sand, {_sum_sql(lambda s: s > 2000)} + cast(p_partkey % 3 as double) as perc_gravel from part")
def grain_fractions(spark, d):
    return geotech.grainsize_fractions(_grain(spark, d)).select("p_partkey", "perc_fines", "perc_sand", "perc_gravel")


@query("select x, y, z, lith from voxels where x between 2 and 10 and z in (-31.75, -30.25)")
def voxel_sel(spark, d):
    return V(spark, d).sel(x=slice(2, 10), z=[-31.75, -30.25]).df


@query("select x, y, z, lith from voxels where x < 3 and z in (select distinct z from voxels order by z limit 2)")
def voxel_isel(spark, d):
    return V(spark, d).isel(x=slice(0, 3), z=[0, 1]).df


@query("select x, y, z, lith from voxels where x in (2.5, 7.5) and z = -30.25")
def voxel_nearest(spark, d):
    return V(spark, d).sel(method="nearest", x=[2.3, 7.0], z=-30.2).df


GRID = """with g as (select min(x) - 0.5 as xlo, max(x) + 0.5 as xhi, min(y) - 0.5 as ylo, max(y) + 0.5 as yhi, count(distinct x) as nx, count(distinct y) as ny, count(distinct z) as nz, min(z) - 0.25 as zlo from voxels),
s as (select h.nr, xlo + 0.5 + least(greatest(floor(h.x - xlo), 0), nx - 1) as cx, ylo + 0.5 + least(greatest(floor(h.y - ylo), 0), ny - 1) as cy from header h, g where h.x between xlo and xhi and h.y between ylo and yhi)
"""


@query(GRID + "select s.nr, v.x, v.y, v.z, v.lith from s join voxels v on v.x = s.cx and v.y = s.cy")
def voxel_points(spark, d):
    return V(spark, d).select_with_points(H(spark, d).select("nr", "x", "y"), "nr")


@query("""with p as (select cast(i as double) * 2.5 as distance, 1.0 + cast(i as double) * 2.5 * 0.8 as px, 2.0 + cast(i as double) * 2.5 * 0.6 as py from range(0, 6) t(i))
select p.distance, v.x, v.y, v.z, v.lith from p join voxels v on v.x = least(floor(p.px + 1e-9), (select max(x) - 0.5 from voxels)) + 0.5 and v.y = least(floor(p.py + 1e-9), (select max(y) - 0.5 from voxels)) + 0.5""")
def voxel_line(spark, d):
    return V(spark, d).sample_along_line([(1.0, 2.0), (13.0, 11.0)], dist=2.5)


@query("select x, y, z, lith from voxels where z - 0.25 < -10.1 and z + 0.25 > -20.3")
def voxel_slice_overlap(spark, d):
    return V(spark, d).slice_depth_interval(-10.1, -20.3).df


@query("select x, y, z, lith from voxels where z <= -10.1 and z >= -20.3")
def voxel_slice_majority(spark, d):
    return V(spark, d).slice_depth_interval(-10.1, -20.3, how="majority").df


@query("select x, y, z, case when z + 0.25 <= -10.1 and z - 0.25 >= -20.3 then lith end as lith from voxels")
def voxel_slice_inner(spark, d):
    return V(spark, d).slice_depth_interval(-10.1, -20.3, how="inner", drop=False).df


@query("select x, y, z, case when z <= -5 - x and z >= -12 - x then lith end as lith from voxels")
def voxel_slice_grid(spark, d):
    m = V(spark, d)
    xs = m.df.select("x").distinct()
    return m.slice_depth_interval(xs.select("x", (-5 - F.col("x")).alias("bound")), xs.select("x", (-12 - F.col("x")).alias("bound")), how="majority", drop=False).df


@query("select x, y, sum(case when lith = 1 and z between -20 and -5 then 0.5::double else 0::double end) as thickness from voxels group by x, y")
def voxel_thickness(spark, d):
    return V(spark, d).thickness(F.col("lith") == 1, (-5, -20))


@query("""with c as (select x, y, lith, count(*) as n from voxels where lith is not null group by all),
r as (select *, row_number() over (partition by x, y order by n desc, lith) as k from c)
select x, y, lith as value, n * 0.5::double as thickness from r where k = 1""")
def voxel_most_common(spark, d):
    return V(spark, d).most_common("lith")


@query("select lith as value, count(*) as n from voxels where lith is not null group by lith")
def voxel_counts(spark, d):
    return V(spark, d).value_counts("lith")


@query("select x, y, v as value, sum(case when lith = v then 1 else 0 end)::bigint as n from voxels, (values (1), (2), (3)) t(v) group by x, y, v")
def voxel_counts_dim(spark, d):
    return V(spark, d).value_counts("lith", dim="z")


@query("select lith as value, count(*)::double / (select count(lith) from voxels) as share from voxels where lith is not null group by lith")
def voxel_counts_norm(spark, d):
    return V(spark, d).value_counts("lith", normalize=True)


@query("""with w as (select vec_id from embeddings), c as (select x, y, z, lith, lag(lith) over (partition by x, y order by z) as was from voxels)
select x, y, z, lith, sum(case when lith = was then 0 else 1 end) over (partition by x, y order by z rows between unbounded preceding and current row) - 1 as run from c""")
def voxel_run_labels(spark, d):
    from pyspark.sql import Window

    return derive.voxel_cells(spark, d).withColumn("run", layers.run_label(F.col("lith"), Window.partitionBy("x", "y").orderBy("z")) - 1)


@query("""with g as (select min(x) - 0.5 as xlo, min(y) - 0.5 as ylo, min(z) - 0.25 as zlo, count(distinct x) as nx, count(distinct y) as ny, count(distinct z) as nz from voxels),
q as (select l.*, surface - (top + bottom) / 2 as zq, xlo + 0.5 + least(greatest(floor(l.x - xlo), 0), nx - 1) as cx, ylo + 0.5 + least(greatest(floor(l.y - ylo), 0), ny - 1) as cy,
zlo + 0.25 + 0.5 * least(greatest(floor((surface - (top + bottom) / 2 - zlo) / 0.5), 0), nz - 1) as cz from layers l, g)
select q.nr, q.x, q.y, q.surface, q.top, q.bottom, q.lith, case when abs(q.x - cx) <= 1 and abs(q.y - cy) <= 1 and abs(zq - cz) <= 0.5 then v.code end as code
from q left join (select x, y, z, lith as code from voxels) v on v.x = cx and v.y = cy and v.z = cz""")
def nearest_voxel_join(spark, d):
    cells = derive.voxel_cells(spark, d).withColumnRenamed("lith", "code")
    return combine.add_nearest_voxels(L(spark, d), voxel.VoxelModel.from_table(cells), "code")


@query(GRID + """, k as (select s.nr, v.z, v.lith as code from s join voxels v on v.x = s.cx and v.y = s.cy),
k1 as (select *, lag(code) over (partition by nr order by z) as was from k), k2 as (select *, sum(case when code = was then 0 else 1 end) over (partition by nr order by z rows between unbounded preceding and current row) as run from k1),
b as (select nr, code, min(z) - 0.25 as elevation from k2 where code is not null group by nr, run, code),
u as (select nr, x, y, surface, top, bottom, lith, null::int as code, 0 as src from layers union all
select b.nr, null, null, null, null, h.surface - b.elevation, null, b.code, 1 from b join header h on h.nr = b.nr where b.elevation < h.surface),
f as (select nr, bottom, src, first_value(x ignore nulls) over w as x, first_value(y ignore nulls) over w as y, first_value(surface ignore nulls) over w as surface, first_value(top ignore nulls) over w as top,
first_value(lith ignore nulls) over w as lith, first_value(code ignore nulls) over w as code from u window w as (partition by nr order by bottom, src rows between current row and unbounded following)),
e as (select *, row_number() over (partition by nr, bottom order by src) as k from f where surface is not null),
t as (select *, lag(bottom) over (partition by nr order by bottom) as above from e where k = 1)
select nr, x, y, surface, greatest(top, coalesce(above, top)) as top, bottom, lith, code from t where bottom > greatest(top, coalesce(above, top))""")
def voxel_boundary_join(spark, d):
    cells = derive.voxel_cells(spark, d).withColumnRenamed("lith", "code")
    return combine.split_at_voxel_units(L(spark, d), H(spark, d), voxel.VoxelModel.from_table(cells), "code")


BROKEN = """with b as (select nr, x, y, surface, top, case when nr % 10 = 0 and lith = 'V' then top - 1 else bottom end as bottom, lith, cast(bottom * 8 as bigint) as pos from layers),
v as (select *, (top >= bottom) or coalesce(top <= lag(top) over w, false) or coalesce(bottom <= lag(bottom) over w, false) as bad from b window w as (partition by nr order by pos))
"""


def _broken(spark, d):
    worse = F.when((F.col("nr") % 10 == 0) & (F.col("lith") == "V"), F.col("top") - 1).otherwise(F.col("bottom"))
    return L(spark, d).withColumn("pos", (F.col("bottom") * 8).cast("long")).withColumn("bottom", worse)


@query(BROKEN + "select nr, top, bottom, pos, not bad as is_valid from v")
def validate_flag(spark, d):
    use = validation.ValidationSettings(FLAG_INVALID=True)
    return validation.validate(_broken(spark, d), F.col("pos"), use).select("nr", "top", "bottom", "pos", "is_valid")


@query(BROKEN + "select nr, top, bottom, pos from v where nr not in (select nr from v where bad)")
def validate_drop(spark, d):
    return validation.validate(_broken(spark, d), F.col("pos"), validation.ValidationSettings()).select("nr", "top", "bottom", "pos")


@query("select nr, x, y, surface, top, bottom, lith from layers")
def adjust_depth(spark, d):
    df = L(spark, d)
    return layers.adjust_depths(df.withColumns({c: F.col("surface") - F.col(c) for c in ("top", "bottom")}))


@query("""select x, y, z, lith, case lith when 1 then 'organic' when 2 then 'clay' when 3 then 'loam' end as unit from voxels""")
def enum_lookup(spark, d):
    return derive.voxel_cells(spark, d).withColumn("unit", units.lithology.name_of(F.col("lith")))


@query("""select h.nr, h.x, h.y, h.surface from header h where h.nr in (select nr from layers where top > 10)""")
def header_align(spark, d):
    from ..collection import Collection

    c = Collection.of(L(spark, d))
    return c.with_data(c.data.where("top > 10")).align().header.select("nr", "x", "y", "surface")


@query("""select l.nr, l.bottom, h."end" from layers l join header h using (nr)""")
def add_header_column(spark, d):
    from ..collection import Collection

    return Collection(H(spark, d), L(spark, d)).add_header_column_to_data("end").data.select("nr", "bottom", "end")


@query("""select nr, surface - top as "Start depth", surface - bottom as "End depth", surface - max(bottom) over (partition by nr) as "Total depth", lith from layers""")
def kingdom_interval(spark, d):
    return sinks.kingdom_intervals(L(spark, d)).select("nr", "`Start depth`", "`End depth`", "`Total depth`", "lith")


@query("""select row_number() over (order by nr) as id, nr, surface, m as "MD", round(-surface / 0.75 + m / 0.8, 6) as "TWT" from header, (values (0), (1)) t(m)""".replace("row_number() over (order by nr)", "dense_rank() over (order by nr)"))
def kingdom_tdchart(spark, d):
    return sinks.kingdom_tdchart(L(spark, d)).withColumn("TWT", F.round("TWT", 6))


@query("""select nr, lith, x as x_top, y as y_top, surface - top + 0.01 as z_top, coalesce(lead(x) over w, x) as x_bottom, coalesce(lead(y) over w, y) as y_bottom, surface - bottom + 0.01 as z_bottom
from layers window w as (partition by nr order by top, bottom)""")
def qgis_segments(spark, d):
    return sinks.segments_3d(L(spark, d)).select("nr", "lith", "x_top", "y_top", "z_top", "x_bottom", "y_bottom", "z_bottom")


CORNERS = """with o as (select x + dx as x, y + dy as y, z + dz as z from voxels, (values (-0.5::double), (0.5::double)) a(dx), (values (-0.5::double), (0.5::double)) b(dy), (values (-0.25::double), (0.25::double)) c(dz) where lith is not null)"""


@query(CORNERS + " select distinct x, y, z from o")
def mesh_points(spark, d):
    return mesh.voxel_mesh(V(spark, d), "lith")[0].select("x", "y", "z")


@query("select x, y, z, lith as value, 8::bigint as n_points from voxels where lith is not null")
def mesh_cells(spark, d):
    points, cells = mesh.voxel_mesh(V(spark, d), "lith")
    return cells.select("x", "y", "z", F.col("lith").alias("value"), F.size("points").cast("long").alias("n_points"))


@query("""select nr, x - 0.5 as xlo, x + 0.5 as xhi, y - 0.5 as ylo, y + 0.5 as yhi, surface - bottom as zlo, surface - top as zhi, lith from layers""")
def layer_boxes(spark, d):
    boxes = mesh.layer_boxes(L(spark, d), 0.5)
    ends = [f(F.col(f"corners.{a}")).alias(f"{a}{k}") for a in "xyz" for k, f in (("lo", F.array_min), ("hi", F.array_max))]
    return boxes.select("nr", *ends, "lith")


@query("""select nr, x, y, surface, top, bottom, null::double as qc, null as kind, lith from layers union all select nr, x, y, surface, null, depth, qc, kind, null from measurements""")
def union_collections(spark, d):
    return L(spark, d).unionByName(M(spark, d).withColumnRenamed("depth", "bottom"), allowMissingColumns=True).select("nr", "x", "y", "surface", "top", "bottom", "qc", "kind", "lith")


@query("""with p as (select c_custkey, c_acctbal, cast(c_custkey % 17 as double) as a, cast(c_nationkey as double) / 2 as b from customer)
select c_custkey, a + b as total from p""")
def parse_coordinates(spark, d):
    c = derive.table(spark, d, "customer")
    joined = F.concat_ws(" ", (F.col("c_custkey") % 17).cast("double").cast("string"), (F.col("c_nationkey").cast("double") / 2).cast("string"))
    pair = text.parse_coordinates(joined)
    return c.select("c_custkey", (pair["a"] + pair["b"]).alias("total"))


@query("select page_id, try_cast(regexp_extract(url, '([0-9]+)', 1) as double) as number from pages")
def safe_float(spark, d):
    return derive.table(spark, d, "pages").select("page_id", text.safe_float(F.regexp_extract("url", "([0-9]+)", 1)).alias("number"))


@query("""select s_suppkey, cast(s_suppkey % 5 as double) + case when s_suppkey % 7 = 0 then 0::double else cast(s_suppkey % 7 as double) end as total from supplier""")
def text_blocks(spark, d):
    s = derive.table(spark, d, "supplier")
    block = F.concat((F.col("s_suppkey") % 5).cast("string"), F.lit(","), F.when(F.col("s_suppkey") % 7 == 0, "-999999").otherwise((F.col("s_suppkey") % 7).cast("string")), F.lit(";"))
    rows = text.text_to_rows(block, ",", ";", -999999)
    cell = lambda i: F.coalesce(F.get(F.get(rows, F.lit(0)), F.lit(i)), F.lit(0.0))
    return s.select("s_suppkey", (cell(0) + cell(1)).alias("total"))


@query("""with r as (select cast(i as double) + 0.5 as x, cast(j as double) + 0.5 as y, cast(i * 100 + j as double) as value from range(0, 32) a(i), range(0, 24) b(j))
select h.nr, h.x, h.y, case when h.x <= 32 and h.y <= 24 then r.value end as height from header h left join r on r.x = least(floor(h.x), 31) + 0.5 and r.y = least(floor(h.y), 23) + 0.5""")
def raster_values(spark, d):
    grid = spark.range(32 * 24).select((F.floor(F.col("id") / 24) + 0.5).cast("double").alias("x"), (F.col("id") % 24 + 0.5).cast("double").alias("y"), (F.floor(F.col("id") / 24) * 100 + F.col("id") % 24).cast("double").alias("value"))
    return voxel.sample_raster(H(spark, d).select("nr", "x", "y"), grid, "height")


@query("select nr, rule, count(*) as n from (" + BROKEN + """, w as (select nr, unnest(list_filter([case when top >= bottom then 'top is not above bottom' end,
case when top <= lag(top) over q then 'top is not below the top before' end, case when bottom <= lag(bottom) over q then 'bottom is not below the bottom before' end], lambda r: r is not null)) as rule from b window q as (partition by nr order by pos)) select * from w) group by nr, rule""")
def validation_errors(spark, d):
    return validation.errors(_broken(spark, d), F.col("pos"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import collection_queries, file_queries, grid_queries, table_queries  # noqa: F401  register their own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import collection_queries, file_queries, grid_queries, table_queries  # noqa: F401

    return dict(ORACLE)
