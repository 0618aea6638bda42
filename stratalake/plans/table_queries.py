"""Queries of tables that are written and read again, of collections as a whole and of models' metadata, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..collection import Collection
from ..operators import voxel
from ..sources import readers, sinks
from ..storage import shared_file
from . import derive
from .queries import H, L, M, V, query

HEAD = 'select nr, x, y, surface, "end" from header'


def C(spark: SparkSession, d: str) -> Collection:
    return Collection(H(spark, d), L(spark, d), crs=28992, vertical_datum=5709)


@query("select nr, x, y, surface, top, bottom, lith from layers")
def read_csv_table(spark, d):
    path = shared_file(spark, "layers.csv")
    C(spark, d).to_csv(path)
    return readers.read_table(spark, path).data.select("nr", "x", "y", "surface", "top", "bottom", "lith")


@query("select nr, x, y, surface, depth, case when qc > 90 then null else qc end as qc from measurements")
def read_parquet_measurements(spark, d):
    """Discrete rows with NaN for missing values, elevations in place of depths."""
    path = shared_file(spark, "cpts.parquet")
    nan = F.when(F.col("qc") > 90, F.lit(float("nan"))).otherwise(F.col("qc"))
    M(spark, d).select("nr", "x", "y", F.col("surface").alias("mv"), "depth", nan.alias("qc")).write.parquet(path)
    return readers.read_table(spark, path, column_mapper={"mv": "surface"}).data.select("nr", "x", "y", "surface", "depth", "qc")


@query("""select nr, x, y, surface, surface - max(bottom) over (partition by nr) as "end", top, bottom, lith from layers""")
def read_cores(spark, d):
    """Inclined cores: tops and bottoms below a datum, the header from aggregates of the layers."""
    cores = L(spark, d).select("nr", "x", "y", (F.col("top") - F.col("surface")).alias("upper"), (F.col("bottom") - F.col("surface")).alias("lower"), "lith")
    c = readers.read_cores(cores, {"upper": "top", "lower": "bottom"})
    return c.data.select("nr", "x", "y", "surface", "end", "top", "bottom", "lith")


@query("select cast(l.nr as varchar) as nr, h.x, h.y, h.surface, h.\"end\", l.top, l.bottom, l.lith from layers l join header h using (nr)")
def read_header_and_data(spark, d):
    head, data = shared_file(spark, "head.parquet"), shared_file(spark, "data.parquet")
    H(spark, d).withColumnsRenamed({"nr": "id", "surface": "mv"}).write.parquet(head)
    L(spark, d).select(F.col("nr").alias("id"), "top", "bottom", "lith").write.parquet(data)
    c = readers.read_header_and_data(spark, head, data, {"id": "nr", "mv": "surface"})
    return c.data.select("nr", "x", "y", "surface", "end", "top", "bottom", "lith")


@query(HEAD)
def geopackage_header(spark, d):
    return _geopackage(spark, d).header.select("nr", "x", "y", "surface", "end")


@query("select nr, top, bottom, lith from layers")
def geopackage_data(spark, d):
    return _geopackage(spark, d).data.select("nr", "top", "bottom", "lith")


def _geopackage(spark: SparkSession, d: str) -> Collection:
    path, c = shared_file(spark, "surveys.gpkg"), C(spark, d)
    sinks.to_geopackage({"header": c.header.select("nr", "x", "y", "surface", "end"), "data": c.data}, path, 28992)
    return readers.read_collection_geopackage(spark, path)


@query("select nr, x, y, surface, top, bottom, lith, 28992 as crs, 5709 as datum from layers")
def collection_saved(spark, d):
    path = shared_file(spark, "collection")
    C(spark, d).save(path)
    c = Collection.load(spark, path)
    return c.data.select("nr", "x", "y", "surface", "top", "bottom", "lith", F.lit(c.crs).alias("crs"), F.lit(c.vertical_datum).alias("datum"))


@query("""select nr, round(6378137 * radians(3 + x / 50), 3) as x, round(6378137 * ln(tan(pi() / 4 + radians(50 + y / 50) / 2)), 3) as y, lith from layers""")
def collection_to_crs(spark, d):
    degrees = lambda df: df.withColumns({"x": 3 + F.col("x") / 50, "y": 50 + F.col("y") / 50})
    c = Collection(degrees(H(spark, d)), degrees(L(spark, d)), crs=4326).to_crs(3857)
    return c.data.select("nr", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), "lith")


@query("""select nr, x, y, surface, "end" from header where exists (select 1 from layers l where l.nr = header.nr and lith = 'V' and top > 3)""")
def collection_aligned(spark, d):
    """A header aligned with data that lost surveys."""
    c = C(spark, d).with_data(L(spark, d).where("lith = 'V' and top > 3"))
    return c.align().header.select("nr", "x", "y", "surface", "end")


@query("select nr, min(x) as x, min(y) as y, min(surface) as surface from layers where lith <> 'K' group by nr")
def collection_reset_header(spark, d):
    return C(spark, d).with_data(L(spark, d).where("lith <> 'K'")).reset_header().header.select("nr", "x", "y", "surface")


@query("select (select count(*) from header) as surveys, (select count(*) from header where x is not null and y is not null) as points, (select count(distinct nr) from layers) as with_data")
def collection_counts(spark, d):
    c = C(spark, d)
    return c.data.agg(F.count_distinct("nr").alias("with_data")).select(F.lit(len(c)).cast("long").alias("surveys"), F.lit(c.n_points).cast("long").alias("points"), "with_data")


@query("""select (max(x) - min(x)) / (count(distinct x) - 1) as dx, (max(y) - min(y)) / (count(distinct y) - 1) as dy, (max(z) - min(z)) / (count(distinct z) - 1) as dz, min(x) - 0.5::double as xmin, max(y) + 0.5::double as ymax,
min(z) - 0.25::double as zmin, max(z) + 0.25::double as zmax, count(distinct x)::int as nx, count(distinct y)::int as ny, count(distinct z)::int as nz from voxels""")
def model_metadata(spark, d):
    m = V(spark, d)
    dy, dx, dz = m.resolution
    ny, nx, nz = m.shape
    values = {"dx": dx, "dy": dy, "dz": dz, "xmin": m.bounds[0], "ymax": m.bounds[3], "zmin": m.z_bounds[0], "zmax": m.z_bounds[1], "nx": nx, "ny": ny, "nz": nz}
    return m.df.agg(F.count("*").alias("n")).select(*[F.lit(v).alias(k) for k, v in values.items()])


@query("select x, y, z, lith from voxels where x between 3.5 and 9.5 and y between 2.5 and 8.5")
def model_lower_left(spark, d):
    """Cells named by their lower left bottom corner; a box keeps those that it touches."""
    corners = derive.voxel_cells(spark, d).withColumns({"x": F.col("x") - 0.5, "y": F.col("y") - 0.5, "z": F.col("z") - 0.25})
    return voxel.VoxelModel.from_lower_left(corners, 1.0, 0.5, bbox=(3.6, 2.6, 9.4, 8.4)).df


@query("select x, y, z, lith, coalesce(lith, 0) + 10 as code from voxels where z > -3")
def model_with_variable(spark, d):
    m = V(spark, d).with_variable("code", F.coalesce("lith", F.lit(0)) + 10)
    return m.sel(z=slice(-3, None)).df

