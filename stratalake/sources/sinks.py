"""Exports: 3-D segments, interval and time-depth tables, GeoParquet and GeoPackage."""

from __future__ import annotations

import json
import os
import re
import shutil
import sqlite3
import struct
import uuid
from collections.abc import Iterable, Iterator
from contextlib import closing
from itertools import accumulate
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import point_wkb
from ..roles import Roles, col
from ..storage import settled, shared_file
from . import btree


def segments_3d(df: DataFrame) -> DataFrame:
    """A 3-D line a row, as end points in elevations, lifted by a centimetre to show in a viewer.

    Discrete rows reach up to the row before; inclined layers go to the next row's coordinates.
    """
    roles = Roles.of(df)
    roles.need("x", "y", "surface", "depth")
    w = roles.window()
    x, y, depth, surface = (col(getattr(roles, r)) for r in ("x", "y", "depth", "surface"))
    if roles.layered:
        ends = {"x_top": x, "y_top": y, "_t": col(roles.top), "x_bottom": F.coalesce(F.lead(x).over(w), x), "y_bottom": F.coalesce(F.lead(y).over(w), y)}
    else:
        ends = {"x_top": F.coalesce(F.lag(x).over(w), x), "y_top": F.coalesce(F.lag(y).over(w), y), "_t": F.lag(depth, 1, 0.0).over(w), "x_bottom": x, "y_bottom": y}
    out = df.withColumns(ends)
    return out.withColumns({"z_top": surface - F.col("_t") + 0.01, "z_bottom": surface - depth + 0.01}).drop("_t")


def segment_wkt(segments: DataFrame) -> DataFrame:
    point = lambda k: F.concat_ws(" ", *[F.col(f"{a}_{k}").cast("string") for a in "xyz"])
    return segments.withColumn("wkt", F.concat(F.lit("LINESTRING Z ("), point("top"), F.lit(", "), point("bottom"), F.lit(")")))


def kingdom_intervals(df: DataFrame) -> DataFrame:
    """Elevations of each layer, with the survey's total depth."""
    roles = Roles.of(df)
    roles.need("surface", "top", "depth")
    surface = col(roles.surface)
    last = F.max(col(roles.depth)).over(Window.partitionBy(col(roles.nr)))
    out = df.withColumns({"Total depth": surface - last, "_s": surface - col(roles.top), "_e": surface - col(roles.depth)}).drop(roles.top, roles.depth)
    return out.withColumnsRenamed({"_s": "Start depth", "_e": "End depth"})


def kingdom_tdchart(df: DataFrame, tdstart: int = 1, vw: float = 1500, vs: float = 1600) -> DataFrame:
    """Two time-depth rows a survey. Ids are dense: surveys are ranked in ranges, so that no task holds them all."""
    roles = Roles.of(df)
    nr, surface = col(roles.nr), col(roles.surface)
    heads = df.groupBy(nr.alias("nr")).agg(F.first(surface).alias("surface"))
    spans = heads.repartitionByRange("nr").withColumn("_part", F.spark_partition_id())
    # Computed once: ids need the same ranges where ranks and where their sizes are counted.
    ranked = settled(spans.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy("nr"))))
    sizes = ranked.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    ids = ranked.join(F.broadcast(before), F.col("_part") == F.col("_p")).select((F.col("_rank") + F.col("_before") + (tdstart - 1)).alias("id"), "nr", "surface")
    rows = ids.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("MD"))
    return rows.withColumn("TWT", -F.col("surface") / (vw / 2 / 1000) + F.col("MD") / (vs / 2 / 1000))


def to_kingdom(df: DataFrame, path: str, tdstart: int = 1, vw: float = 1500, vs: float = 1600) -> None:
    kingdom_intervals(df).write.mode("overwrite").csv(f"{path}/intervals", header=True)
    kingdom_tdchart(df, tdstart, vw, vs).orderBy("id", "MD").write.mode("overwrite").csv(f"{path}/tdchart", header=True)


def to_geoparquet(header: DataFrame, path: str, crs: int | None = None) -> None:
    """The header with its points as WKB, in Parquet files that carry the ``geo`` metadata, a file a partition.

    Spark's writer has no key for a file's metadata, so tasks write their files with Arrow under names of their own;
    files of tasks that did not succeed are deleted.
    """
    roles = Roles.of(header)
    made = header.withColumn("geometry", point_wkb(col(roles.x), col(roles.y)))
    column = {"encoding": "WKB", "geometry_types": ["Point"]}
    if crs:
        column["crs"] = {"type": "ProjectedCRS" if crs not in (4326, 4258) else "GeographicCRS", "name": f"EPSG:{crs}", "id": {"authority": "EPSG", "code": crs}}
    geo = json.dumps({"version": "1.1.0", "primary_column": "geometry", "columns": {"geometry": column}})
    folder = header.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(header.sparkSession._jsc.hadoopConfiguration())
    system.delete(folder, True)
    system.mkdirs(folder)
    uri = system.makeQualified(folder).toString()

    def write(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, writer = f"part-{uuid.uuid4().hex}.parquet", None
        fs, inside = (pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")) if uri.startswith("file:") else pafs.FileSystem.from_uri(uri)
        for batch in it:
            if writer is None:
                writer = pq.ParquetWriter(f"{inside}/{name}", batch.schema.with_metadata({"geo": geo}), filesystem=fs)
            writer.write_batch(batch)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    kept = {r.name for r in made.mapInArrow(write, "name string").collect()}
    for status in system.listStatus(folder):
        if status.getPath().getName() not in kept:
            system.delete(status.getPath(), True)


#: Rows of a file that one task makes of a GeoPackage's table, and rows that it holds at a time.
GPKG_PART, GPKG_BATCH = 500_000, 50_000
#: Bytes of a page of new files.
GPKG_PAGE = 32_768


#: A point's blob: magic and version, flags, reference system; byte order, kind, coordinates.
GPKG_POINT = np.dtype([("magic", "S4"), ("srs", "<i4"), ("order", "u1"), ("kind", "<u4"), ("x", "<f8"), ("y", "<f8")])


def gpkg_points(x: pa.Array, y: pa.Array, crs: int | None) -> list[bytes | None]:
    points = np.empty(len(x), GPKG_POINT)
    points["magic"], points["srs"], points["order"], points["kind"] = b"GP\x00\x01", crs or 0, 1, 1
    for name, values in (("x", x), ("y", y)):
        points[name] = values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    data, size = points.tobytes(), GPKG_POINT.itemsize
    out = [data[k : k + size] for k in range(0, len(data), size)]
    for k in np.flatnonzero(~(x.is_valid().to_numpy(zero_copy_only=False) & y.is_valid().to_numpy(zero_copy_only=False))):
        out[k] = None
    return out


def gpkg_values(columns: list[pa.Array], at: tuple[int, int] | None, crs: int | None) -> Iterator[tuple]:
    """Rows of a GeoPackage's table; at: the columns of coordinates, of which the last one, a point's blob, is made."""
    plain = lambda c: c.to_numpy(zero_copy_only=False).tolist() if not c.null_count and (pa.types.is_integer(c.type) or pa.types.is_floating(c.type)) else c.to_pylist()
    return zip(*map(plain, columns), *([gpkg_points(columns[at[0]], columns[at[1]], crs)] if at else []))


def gpkg_parts(df: DataFrame, folder: str, create: str, insert: str, at: tuple[int, int] | None, crs: int | None) -> list[str]:
    """SQLite files with one table each that tasks make of df's rows, numbered through in the order of its partitions.

    The rows are staged first, as a row's number needs the sizes of the partitions before it.
    """
    spark, staged = df.sparkSession, f"{folder}/{uuid.uuid4().hex}"
    df.toDF(*[f"c{k}" for k in range(len(df.columns))]).write.option("maxRecordsPerFile", GPKG_PART).parquet(f"file://{staged}")
    sizes = spark.read.parquet(f"file://{staged}").groupBy(F.col("_metadata.file_name").alias("name")).count().collect()
    # part-<partition>-<job>-c<file>: files of a partition follow each other.
    order = sorted((*map(int, re.match(r"part-(\d+)-.*?c(\d+)\.", r["name"]).groups()), r["name"], r["count"]) for r in sizes)
    starts = [1, *accumulate((r[3] for r in order), initial=1)][1:]
    files = [(r[2], start) for r, start in zip(order, starts)]

    def build(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number in (k for batch in it for k in batch.column(0).to_pylist()):
            name, start = files[number]
            made = f"{folder}/{uuid.uuid4().hex}"  # of this attempt
            with closing(sqlite3.connect(made)) as db, pq.ParquetFile(f"{staged}/{name}") as source:
                db.execute(f"pragma page_size = {GPKG_PAGE}")
                db.execute("pragma journal_mode = off")
                db.execute("pragma synchronous = off")
                db.execute(create)
                for batch in source.iter_batches(GPKG_BATCH):
                    fids = pa.array(range(start, start + batch.num_rows), pa.int64())
                    db.executemany(insert, gpkg_values([fids, *batch.columns], at and (at[0] + 1, at[1] + 1), crs))
                    start += batch.num_rows
                db.commit()
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([made])], names=["number", "made"])

    made = spark.range(0, len(files), 1, max(1, len(files))).mapInArrow(build, "number long, made string").collect()
    shutil.rmtree(staged)
    return [r.made for r in sorted(made)]


def to_geopackage(tables: dict[str, DataFrame], path: str, crs: int | None = None) -> None:
    """Tables as layers of a GeoPackage, one SQLite file.

    Tasks make files with some of the rows each, in the folder that driver and executors share; the driver brings their
    pages or, where rows are longer than pages, their records into one, as they are. Where that folder is no mounted one, rows stream through the driver a partition at a time.
    """
    layers = []
    for name, df in tables.items():
        try:
            roles = Roles.of(df)
            spatial = roles.has_xy
        except KeyError:
            spatial = False
        kinds = {"string": "text", "double": "real", "float": "real"}
        columns = [f'"{c}" {kinds.get(t, "integer" if t in ("int", "bigint", "smallint", "tinyint", "boolean") else "blob")}' for c, t in df.dtypes]
        create = f'create table "{name}" (fid integer primary key, {", ".join(columns)}{", geom blob" if spatial else ""})'
        insert = f'insert into "{name}" values ({", ".join("?" * (1 + len(columns) + spatial))})'
        at = (df.columns.index(roles.x), df.columns.index(roles.y)) if spatial else None
        df = df.select(*[(c.cast("string") if t.startswith(("date", "timestamp")) else c.cast("binary") if t == "void" else c).alias(n) for n, t in df.dtypes for c in [col(n)]])
        layers.append((name, df, create, insert, at))
    spark = next(iter(tables.values())).sparkSession if tables else None
    try:
        folder = str(Path(shared_file(spark, "rows")).parent) if tables else ""
    except ValueError:
        folder = ""
    parts = {name: gpkg_parts(df, folder, create, insert, at, crs) for name, df, create, insert, at in layers} if folder else {}
    with closing(sqlite3.connect(path)) as db, db:
        db.executescript(f"""
            pragma page_size = {GPKG_PAGE};
            create table if not exists gpkg_contents (table_name text primary key, data_type text not null, identifier text, srs_id integer);
            create table if not exists gpkg_geometry_columns (table_name text primary key, column_name text, geometry_type_name text, srs_id integer, z tinyint, m tinyint);
        """)
        for name, df, create, insert, at in layers:
            db.execute(f'drop table if exists "{name}"')
            db.execute(create)
            if not folder:
                db.executemany(insert, ((fid, *row, *(gpkg_points(*[pa.array([row[k]], pa.float64()) for k in at], crs) if at else [])) for fid, row in enumerate(df.toLocalIterator(), 1)))
            db.execute("insert or replace into gpkg_contents values (?, ?, ?, ?)", (name, "features" if at else "attributes", name, crs))
            if at:
                db.execute("insert or replace into gpkg_geometry_columns values (?, 'geom', 'POINT', ?, 0, 0)", (name, crs))
    for name, made in parts.items():
        if not btree.splice(path, name, made):
            with closing(sqlite3.connect(path)) as db:
                for part in made:
                    db.execute("attach ? as part", (part,))
                    db.execute(f'insert into main."{name}" select * from part."{name}"')
                    db.commit()
                    db.execute("detach part")
        for part in made:
            os.unlink(part)
    if folder:
        shutil.rmtree(folder)


def to_shapefile(header: DataFrame, path: str, crs_wkt: str | None = None) -> None:
    """The points of a header as a shapefile: see :func:`shapefile.write_shapefile`."""
    from .shapefile import write_shapefile

    write_shapefile(header, path, wkt=crs_wkt)
