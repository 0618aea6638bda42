"""Queries of grids with any coordinates, of tables of lines and of tables of areas, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Geometry, polygon_wkb
from ..operators import areas, combine, spatial, voxel
from ..sources import mesh
from . import derive
from .queries import H, L, query, ray_sql

#: Coordinates of surveys brought into the small grids: many of them lie on cell centres and half-way between two.
SMALL = """l as (select nr, x * 0.05::double as x, y * 0.05::double as y, surface, top * 0.1::double as top, bottom * 0.1::double as bottom, lith from layers)"""


def small(spark, d) -> DataFrame:
    scaled = [(F.col(c) * f).alias(c) for c, f in (("x", 0.05), ("y", 0.05))]
    return L(spark, d).select("nr", *scaled, "surface", (F.col("top") * 0.1).alias("top"), (F.col("bottom") * 0.1).alias("bottom"), "lith")


def tenths(spark, d) -> voxel.VoxelModel:
    return voxel.VoxelModel.from_table(derive.tenth_cells(spark, d))


def uneven(spark, d) -> voxel.VoxelModel:
    return voxel.VoxelModel.from_table(derive.tenth_cells(spark, d, "pos * pos * 0.01D - 40.3D"))


def nearest_sql(grid: str, rows: str, **values: str) -> str:
    """CTEs nx, ny, nz: the nearest coordinate by brute force for each distinct value, of two as near the larger."""
    return ", ".join(f"n{a} as (select v, arg_min(c, (abs(c - v), -c)) as c from (select distinct {e} as v from {rows}), (select distinct {a} as c from {grid}) group by v)" for a, e in values.items())


def nearest_join_sql(grid: str) -> str:
    cells = nearest_sql(grid, "q", x="x", y="y", z="zq")
    step = lambda a, mean: f"(select (max({a}) - min({a})) / (count(distinct {a}) - 1) from {grid})" if mean else f"(select lead(z) over (order by z) - z as s from (select distinct z from {grid}) order by z limit 1)"
    return f"""with {SMALL}, q as (select *, surface - (top + bottom) / 2 as zq from l), {cells}
select q.nr, q.x, q.y, q.surface, q.top, q.bottom, q.lith, case when abs(q.x - nx.c) <= {step('x', True)} and abs(q.y - ny.c) <= {step('y', True)} and abs(zq - nz.c) <= {step('z', grid == 'tenths')} then g.code end as code
from q join nx on nx.v = q.x join ny on ny.v = q.y join nz on nz.v = zq left join {grid} g on g.x = nx.c and g.y = ny.c and g.z = nz.c"""


@query("select x, y, z, code from tenths where x between 0.3 and 1.2::double + 1e-9 and z in (select z from (select distinct z, dense_rank() over (order by z) as k from tenths) where k in (2, 4, 8))")
def voxel_sel_tenths(spark, d):
    return tenths(spark, d).sel(x=slice(0.3, 1.2 + 1e-9), z=[-6.25, -6.05, -5.65]).df


@query("select x, y, z, code from tenths")
def voxel_sel_all_tenths(spark, d):
    return tenths(spark, d).sel(x=slice(None, None), y=slice(None, None), z=slice(-7, 7)).slice_depth_interval(100, -100).df


@query(nearest_join_sql("tenths"))
def nearest_voxel_tenths(spark, d):
    return combine.add_nearest_voxels(small(spark, d), tenths(spark, d), "code")


@query(nearest_join_sql("uneven"))
def nearest_voxel_uneven(spark, d):
    return combine.add_nearest_voxels(small(spark, d), uneven(spark, d), "code")


@query(f"""with p as (select nr, x * 0.05::double as x, y * 0.05::double as y from header), b as (select min(x) - 0.05::double as xlo, max(x) + 0.05::double as xhi, min(y) - 1::double / 6 as ylo, max(y) + 1::double / 6 as yhi from tenths),
i as (select p.* from p, b where x between xlo - 1e-9 and xhi + 1e-9 and y between ylo - 1e-9 and yhi + 1e-9), {nearest_sql("tenths", "i", x="x", y="y")}
select i.nr, g.x, g.y, g.z, g.code from i join nx on nx.v = i.x join ny on ny.v = i.y join tenths g on g.x = nx.c and g.y = ny.c""")
def voxel_points_tenths(spark, d):
    points = H(spark, d).select("nr", (F.col("x") * 0.05).alias("x"), (F.col("y") * 0.05).alias("y"))
    return tenths(spark, d).select_with_points(points, "nr")


@query("select x, y, z, code from uneven where z <= -1.5 and z >= -30")
def voxel_sel_uneven(spark, d):
    return uneven(spark, d).sel(z=slice(None, None)).slice_depth_interval(-1.5, -30, how="majority").df


def borders_sql(axis: str) -> str:
    c, step = f"select distinct {axis} as c from tenths", f"(select (max({axis}) - min({axis})) / (count(distinct {axis}) - 1) from tenths)"
    return f"""e{axis} as (select row_number() over (order by e) - 1 as k, e from (select min(c) - {step} / 2 as e from ({c}) union all select max(c) + {step} / 2 from ({c})
union all select (c + n) / 2 from (select c, lead(c) over (order by c) as n from ({c})) where n is not null))"""


@query(f"with {borders_sql('x')}, {borders_sql('y')}, {borders_sql('z')} select (ex.k * (select count(*) from ey) + ey.k) * (select count(*) from ez) + ez.k as id, ex.e as x, ey.e as y, ez.e as z from ex, ey, ez")
def voxel_mesh_tenths(spark, d):
    m = tenths(spark, d).dense()  # the table's last row of cells may end before the grid does
    return mesh.voxel_mesh(m.with_variable("code", F.coalesce("code", F.lit(0))), "code")[0]


@query("""with p as (select nr, x / 4 as ax, y / 4 as ay, x / 4 + 6 as bx, y / 4 + 8 as by, x / 4 + 6 as cx, y / 4 + 8 + surface as cy, surface from header),
s as (select nr, ax, ay, surface, cast(k as double) * 2.5 as distance from p, range(0, 6) t(k) where cast(k as double) * 2.5 < 10 + surface),
q as (select nr, distance, case when distance <= 10 then ax + distance / 10 * 6 else ax + 6 end as px, case when distance <= 10 then ay + distance / 10 * 8 else ay + 8 + (distance - 10) end as py from s),
g as (select max(x) - 0.5 as xm, max(y) - 0.5 as ym from voxels)
select q.nr, q.distance, v.x, v.y, v.z, v.lith from q, g, voxels v where v.x = least(floor(px + 1e-9), xm) + 0.5 and v.y = least(floor(py + 1e-9), ym) + 0.5 and v.z > -1""")
def voxel_lines(spark, d):
    """Each survey's own line of two stretches, of lengths 10 and its surface."""
    point = lambda x, y: F.struct((x + 0.0).alias("x"), (y + 0.0).alias("y"))
    x, y = F.col("x") / 4, F.col("y") / 4
    path = F.array(point(x, y), point(x + 6, y + 8), point(x + 6, y + 8 + F.col("surface")))
    model = derive.voxels(spark, d).sel(z=slice(-1, None))
    return model.sample_along_lines(H(spark, d).select("nr", path.alias("path")), "nr", dist=2.5)


#: An area around each supplier: a quadrangle of whole coordinates, many of whose edges pass through surveys.
CORNERS = ((0, 0), (7, 1), (9, 8), (2, 6))


def supplier_areas(spark, d) -> DataFrame:
    s = derive.table(spark, d, "supplier").select(F.col("s_suppkey").alias("area"), (F.col("s_suppkey") * 7 % 60).cast("double").alias("x"), (F.col("s_suppkey") * 11 % 44).cast("double").alias("y"))
    ring = F.array(*[F.struct((F.col("x") + a).alias("x"), (F.col("y") + b).alias("y")) for a, b in (*CORNERS, CORNERS[0])])
    return s.select("area", polygon_wkb(ring).alias("geometry"))


IN_AREA, ON_AREA = ray_sql("(h.x - s.x)", "(h.y - s.y)", [(float(a), float(b)) for a, b in CORNERS])
AREA_SQL = "with s as (select s_suppkey as area, (s_suppkey * 7 % 60)::double as x, (s_suppkey * 11 % 44)::double as y from supplier)"


@query(f'{AREA_SQL} select h.nr, h.x, h.y, h.surface, h."end", s.area from header h join s on {IN_AREA} or {ON_AREA}')
def polygon_table_join(spark, d):
    return spatial.spatial_join(H(spark, d), supplier_areas(spark, d), "area")


@query(f'{AREA_SQL} select h.nr, h.x, h.y, h.surface, h."end", s.area from header h left join s on {IN_AREA} and not {ON_AREA}')
def polygon_table_left(spark, d):
    return spatial.spatial_join(H(spark, d), supplier_areas(spark, d), "area", how="left", predicate="within")


@query(f'{AREA_SQL} select h.nr, h.x, h.y, h.surface, h."end" from header h where not exists (select 1 from s where {IN_AREA} and not {ON_AREA})')
def polygon_table_select(spark, d):
    return areas.select_within_table(H(spark, d), supplier_areas(spark, d), invert=True)


#: Triangles around the survey places (24, 20): the first fan closes the circle there, the second leaves a gap.
FAN = [(34.0, 20.0), (24.0, 32.0), (12.0, 20.0), (24.0, 10.0)]


@query("""with t as (select * from header where abs(x - 24) * case when y > 20 then 12 else 10 end + abs(y - 20) * case when x > 24 then 10 else 12 end < case when x > 24 then 10 else 12 end * case when y > 20 then 12 else 10 end)
select nr, x, y from t union all select nr, x + 1000, y from t where not (y = 20 and x >= 24) and not (x = 24 and y <= 20) and not (x > 24 and y < 20)""")
def within_union_vertex(spark, d):
    """Points in the union of triangles that meet in one vertex: four close the circle there, three of them don't."""
    fan = [Geometry("POLYGON", [[(24.0, 20.0), p, q, (24.0, 20.0)]]) for p, q in zip(FAN, [*FAN[1:], FAN[0]])]
    points = H(spark, d).select("nr", "x", "y")
    three = spatial.select_within_polygons(points, fan[:3]).withColumn("x", F.col("x") + 1000)
    return spatial.select_within_polygons(points, fan).unionByName(three)
