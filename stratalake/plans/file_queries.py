"""Queries of the file readers: survey files written from the derived relations as texts, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geotech
from ..sources import netcdf, readers, shapefile, sinks
from . import derive
from .queries import H, L, M, query

Parts = list["str | Column"]


def text(*parts: str | Column) -> Column:
    """A text of constants and columns."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def inside(path: str, *parts: str | Column) -> Parts:
    """XML elements around parts, the outermost first."""
    names = path.split("/")
    return ["".join(f"<{n}>" for n in names), *parts, "".join(f"</{n}>" for n in reversed(names))]


def one_text(rows: DataFrame, order: str, piece: Column, by: list[str], **sums: Column) -> DataFrame:
    """A row a survey, with the texts of its rows one after the other."""
    pieces = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), piece.alias("t")))), lambda s: s["t"]), "")
    return rows.groupBy(*by).agg(pieces.alias("body"), *[v.alias(k) for k, v in sums.items()])


def payload(end: Parts, body: Parts) -> Column:
    place = ['<standardizedLocation><location srsName="urn:ogc:def:crs:EPSG::28992"><pos>', F.col("x"), " ", F.col("y"), "</pos></location></standardizedLocation>"]
    head = [*inside("broId", F.col("nr")), *place, *inside("deliveredVerticalPosition/offset", F.col("surface"))]
    return text("<answer><dispatchDocument><survey>", *head, *end, *body, "</survey></dispatchDocument></answer>")


#: Where the kinds of layered surveys keep the end depth and the layers, and the names of these.
LAYERED = {
    "bhrgt": ("boring/finalDepthBoring", "boreholeSampleDescription/descriptiveBoreholeLog", "layer", "geotechnicalSoilName"),
    "bhrp": ("boring/boredTrajectory/endDepth", "boreholeSampleDescription/result", "soilLayer", "standardSoilName"),
    "bhrg": ("boring/Boring/finalDepthBoring", "boreholeSampleDescription/BoreholeSampleDescription/descriptiveBoreholeLog/DescriptiveBoreholeLog", "layer", "soilNameNEN5104"),
    "sfr": ("soilUncovering/SoilUncovering/endDepthSoilFace", "soilFaceDescription/SoilFaceDescription/soilProfile/SoilProfile", "SoilLayer", "soilNameNEN5104"),
}


def layered_files(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    end, log, row, name = LAYERED[kind]
    piece = text(*inside(row, *inside("upperBoundary", F.col("top")), *inside("lowerBoundary", F.col("bottom")), *inside(f"soil/{name}", F.col("lith"))))
    surveys = one_text(L(spark, sf_dir), "bottom", piece, ["nr", "x", "y", "surface"], deep=F.max("bottom"))
    return surveys.select(F.col("nr").cast("string").alias("path"), payload(inside(end, F.col("deep")), inside(log, F.col("body"))).cast("binary").alias("content"))


def _layered(kind: str):
    name = LAYERED[kind][3]

    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = readers.surveys_of(layered_files(spark, sf_dir, kind), readers.schema_of(kind))
        return c.data.select("nr", "x", "y", "surface", "end", "top", "bottom", name)

    read.__name__ = f"read_{kind}"
    return query(f"""select cast(nr as varchar) as nr, x, y, surface, surface - max(bottom) over (partition by nr) as "end", top, bottom, lith as "{name}" from layers""")(read)


for _kind in LAYERED:
    _layered(_kind)


@query("""select cast(nr as varchar) as nr, x, y, surface, min(surface - depth) over (partition by nr) as "end", depth, depth as penetrationlength, case when qc > 90 then null else qc end as coneresistance from measurements""")
def read_cpt(spark, d):
    piece = text(F.col("depth"), ",", F.when(F.col("qc") > 90, F.lit(-999999.0)).otherwise(F.col("qc")), ";")
    surveys = one_text(M(spark, d), "depth", piece, ["nr", "x", "y", "surface"], deep=F.max("depth"))
    end = inside("conePenetrometerSurvey/trajectory/finalDepth", F.col("deep"))
    values = ['<test><cptResult><encoding><TextEncoding tokenSeparator="," blockSeparator=";"/></encoding>', *inside("values", F.col("body")), "</cptResult></test>"]
    names = ["<parameters><penetrationLength>yes</penetrationLength><coneResistance>yes</coneResistance></parameters>"]
    files = surveys.select(F.col("nr").cast("string").alias("path"), payload(end, [*names, *values]).cast("binary").alias("content"))
    return readers.surveys_of(files, readers.schema_of("cpt")).data.select("nr", "x", "y", "surface", "end", "depth", "penetrationlength", "coneresistance")


GRAINS = ", ".join(f'cast((p_partkey * {i + 3} + p_size * {i + 1}) % 17 as double) as "{n}"' for i, (n, _) in enumerate(geotech.CLASSES))


@query(f"""select cast(p_partkey as varchar) as nr, 1.0::double as top, 1.5::double as bottom, {GRAINS}, cast(p_partkey % 3 as double) as "{geotech.COARSEST}" from part""")
def read_bhrgt_samples(spark, d):
    key, size = F.col("p_partkey"), F.col("p_size")
    parts = {n: ((key * (i + 3) + size * (i + 1)) % 17).cast("double") for i, (n, _) in enumerate(geotech.CLASSES)} | {geotech.COARSEST: (key % 3).cast("double")}
    body = [x for n, v in parts.items() for x in inside(n, v)]
    interval = inside("boreholeSampleAnalysis/investigatedInterval", *inside("beginDepth", "1.0"), *inside("endDepth", "1.5"), *body)
    rows = derive.table(spark, d, "part").withColumns({"nr": key, "x": F.lit(1.0), "y": F.lit(2.0), "surface": F.lit(0.5)})
    files = rows.select(key.cast("string").alias("path"), payload(inside("boring/finalDepthBoring", "4"), interval).cast("binary").alias("content"))
    return readers.surveys_of(files, readers.schema_of("bhrgt_samples")).data.select("nr", "top", "bottom", *parts)


@query("""select cast(nr as varchar) as nr, x, y, surface, min(surface - depth) over (partition by nr) as "end", depth, depth as length, case when qc > 90 then null else qc end as qc, depth / 4 as fs, case when qc > 90 or qc = 0 then null else round(depth / 4 / qc * 100, 6) end as rf from measurements""")
def read_gef(spark, d):
    piece = text(F.col("depth"), " ", F.when(F.col("qc") > 90, F.lit(-1.0)).otherwise(F.col("qc")), " ", F.col("depth") / 4, "\n")
    surveys = one_text(M(spark, d), "depth", piece, ["nr", "x", "y", "surface"])
    info = "#COLUMNINFO= 1, m, length, 1\n#COLUMNINFO= 2, MPa, cone, 2\n#COLUMNINFO= 3, MPa, friction, 3\n#COLUMNVOID= 2, -1.0\n"
    content = text(info, "#TESTID= ", F.col("nr"), "\n#XYID= 31000, ", F.col("x"), ", ", F.col("y"), "\n#ZID= 31000, ", F.col("surface"), "\n#EOH=\n", F.col("body"))
    rows = readers.gef_rows(surveys.select(F.col("nr").cast("string").alias("path"), content.cast("binary").alias("content")))
    return rows.select("nr", "x", "y", "surface", "end", "depth", "length", "qc", "fs", F.round("rf", 6).alias("rf"))


@query("""select cast(nr as varchar) as nr, x, y, surface, surface - max(bottom) over (partition by nr) as "end", top, bottom, lith as lithology from layers""")
def read_boris(spark, d):
    piece = text('<lithoInterval baseDepth="', F.col("bottom"), '"><lithology code="', F.col("lith"), '"/></lithoInterval>')
    surveys = one_text(L(spark, d), "bottom", piece, ["nr", "x", "y", "surface"])
    content = text('<xml><pointSurvey id="', F.col("nr"), '">', *inside("x", F.col("x")), *inside("y", F.col("y")), *inside("surfaceLevel", F.col("surface")), F.col("body"), "</pointSurvey></xml>")
    return readers.boris_rows(surveys.select(F.col("nr").cast("string").alias("path"), content.cast("binary").alias("content"))).select("nr", "x", "y", "surface", "end", "top", "bottom", "lithology")


@query("select x, y, z, lith from voxels where x between 3 and 11 and y between 2 and 14")
def read_netcdf(spark, d):
    """The voxel model written as a classic NetCDF file, and a box of it read back."""
    from ..operators.voxel import VoxelModel
    from ..storage import shared_file

    model, path = derive.voxels(spark, d), shared_file(spark, "voxels.nc")
    netcdf.write_netcdf(model.df, path, {a: getattr(model, a).centres for a in "xyz"})
    return VoxelModel.from_netcdf(spark, path, ["lith"], (3, 2, 11, 14)).df


@query("""select nr, surface, "end", x, y from header""")
def read_shapefile(spark, d):
    """The header written as a shapefile by tasks, and read back in ranges of records."""
    from ..functions.geometry import wkb_point
    from ..storage import shared_file

    path = shared_file(spark, "header.shp")
    sinks.to_shapefile(H(spark, d).select("nr", "x", "y", "surface", "end"), path)
    rows = shapefile.read_shapefile(spark, path, records=20_000)
    x, y = wkb_point(F.col("geometry"))
    return rows.select("nr", "surface", "end", x.alias("x"), y.alias("y"))


@query("""select nr, surface, "end", x, y from header""")
def read_geoparquet(spark, d):
    """The header written as GeoParquet and read back."""
    from ..functions.geometry import wkb_point
    from ..storage import shared_file

    path = shared_file(spark, "header")
    sinks.to_geoparquet(H(spark, d).select("nr", "x", "y", "surface", "end"), path, 28992)
    x, y = wkb_point(F.col("geometry"))
    return spark.read.parquet(path).select("nr", "surface", "end", x.alias("x"), y.alias("y"))
