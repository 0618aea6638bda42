"""Mesh relations (points, cells) of surveys and voxel models, and a text writer of the legacy VTK format."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.voxel import VoxelModel
from ..roles import Roles, col


def _points(*triples: tuple[Column, Column, Column]) -> Column:
    return F.array(*[F.struct(x.alias("x"), y.alias("y"), z.alias("z")) for x, y, z in triples])


def continuous_points(df: DataFrame, vertical_factor: float = 1.0) -> DataFrame:
    """(nr, x, y, z) of discrete rows."""
    roles = Roles.of(df)
    return df.select(col(roles.nr), col(roles.x).alias("x"), col(roles.y).alias("y"), ((col(roles.surface) - col(roles.depth)) * vertical_factor).alias("z"))


def layer_points(df: DataFrame, vertical_factor: float = 1.0) -> DataFrame:
    """Two points a layer, its top and its bottom."""
    roles = Roles.of(df)
    x, y, s = (col(getattr(roles, r)) for r in ("x", "y", "surface"))
    ends = _points((x, y, (s - col(roles.top)) * vertical_factor), (x, y, (s - col(roles.depth)) * vertical_factor))
    return df.select("*", F.posexplode(ends).alias("end_no", "p")).select(col(roles.nr), "end_no", "p.x", "p.y", "p.z")


def layer_boxes(df: DataFrame, radius: float, vertical_factor: float = 1.0) -> DataFrame:
    """df with the eight corners of a box a layer."""
    roles = Roles.of(df)
    x, y, s = (col(getattr(roles, r)) for r in ("x", "y", "surface"))
    top = col(roles.top) if roles.layered else F.lag(col(roles.depth), 1, 0.0).over(roles.window())
    z = [(s - col(roles.depth)) * vertical_factor, (s - top) * vertical_factor]
    flat = [(x - radius, y - radius), (x + radius, y - radius), (x + radius, y + radius), (x - radius, y + radius)]
    return df.withColumn("corners", _points(*[(a, b, c) for c in z for a, b in flat]))


def cylinders(df: DataFrame, radius: float, n_sides: int = 12, vertical_factor: float = 1.0) -> DataFrame:
    """df with the rings (bottom, then top) of a prism of n_sides around each layer."""
    roles = Roles.of(df)
    x, y, s = (col(getattr(roles, r)) for r in ("x", "y", "surface"))
    top = col(roles.top) if roles.layered else F.lag(col(roles.depth), 1, 0.0).over(roles.window())
    around = [(x + radius * math.cos(2 * math.pi * i / n_sides), y + radius * math.sin(2 * math.pi * i / n_sides)) for i in range(n_sides)]
    return df.withColumn("corners", _points(*[(a, b, (s - d) * vertical_factor) for d in (col(roles.depth), top) for a, b in around]))


def voxel_mesh(model: VoxelModel, variable: str) -> tuple[DataFrame, DataFrame]:
    """(points, cells): distinct corners with dense ids, and for each cell with a value the ids of its eight corners.

    A corner is named by its numbers on the cells' borders, so neighbours share it. Its id counts the corners before it:
    within its (x, y) column by rank, over columns by a running sum over the columns of one x, and over the x's.
    """
    cells = model.cells().where(col(variable).isNotNull())
    around = [(a, b, c) for c in (0, 1) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))]
    corners = F.array(*[F.struct((F.col("_i") + a).alias("i"), (F.col("_j") + b).alias("j"), (F.col("_k") + c).alias("k")) for a, b, c in around])
    loose = cells.select(F.explode(corners).alias("p")).select("p.*").distinct()
    per_column = loose.groupBy("i", "j").agg(F.count("*").alias("n"))
    per_x = per_column.groupBy("i").agg(F.sum("n").alias("n"))
    start_x = per_x.select(F.col("i").alias("_x"), (F.sum("n").over(Window.orderBy("i")) - F.col("n")).alias("_sx"))
    start_y = per_column.select(F.col("i").alias("_px"), F.col("j").alias("_py"), (F.sum("n").over(Window.partitionBy("i").orderBy("j")) - F.col("n")).alias("_sy"))
    rank = F.row_number().over(Window.partitionBy("i", "j").orderBy("k")) - 1
    numbered = loose.withColumn("_rank", rank).join(start_x, F.col("i") == F.col("_x")).join(start_y, (F.col("i") == F.col("_px")) & (F.col("j") == F.col("_py")))
    numbered = numbered.select((F.col("_rank") + F.col("_sx") + F.col("_sy")).alias("id"), "i", "j", "k")
    edge = lambda axis, c: F.get(F.from_json(F.lit(json.dumps(axis.edges)), "array<double>"), F.col(c))
    points = numbered.select("id", edge(model.x, "i").alias("x"), edge(model.y, "j").alias("y"), edge(model.z, "k").alias("z"))
    keyed = cells.select("*", F.posexplode(corners).alias("_at", "_p"))
    ids = numbered.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_n{c}") for c in "ijk"])
    met = keyed.join(ids, (F.col("_p.i") == F.col("_ni")) & (F.col("_p.j") == F.col("_nj")) & (F.col("_p.k") == F.col("_nk")))
    names = ["x", "y", "z", *[c for c in model.df.columns if c not in ("x", "y", "z")]]
    grouped = met.groupBy(*map(col, names)).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_id"))), lambda s: s["_id"]).alias("points"))
    return points, grouped


def structured_grid(model: VoxelModel) -> tuple[dict, DataFrame]:
    """Origin, spacing and dimensions (points) of a structured grid, and all cells in the order of its data."""
    meta = {"origin": (model.x.low, model.y.low, model.z.low), "spacing": (model.x.step, model.y.step, model.z.step), "dimensions": (model.x.size + 1, model.y.size + 1, model.z.size + 1)}
    return meta, model.df.orderBy("z", "y", "x")


def write_vtk(points: DataFrame, cells: DataFrame, variable: str, path: str, cell_type: int = 12) -> None:
    """An unstructured grid as ASCII; one file, so the rows stream through the driver."""
    n, m = points.count(), cells.count()
    with open(path, "w") as f:
        f.write(f"# vtk DataFile Version 3.0\nmesh\nASCII\nDATASET UNSTRUCTURED_GRID\nPOINTS {n} double\n")
        for p in points.orderBy("id").toLocalIterator():
            f.write(f"{p.x} {p.y} {p.z}\n")
        ordered = cells.orderBy("z", "y", "x")
        f.write(f"CELLS {m} {9 * m}\n")
        for c in ordered.select("points").toLocalIterator():
            f.write("8 " + " ".join(map(str, c.points)) + "\n")
        f.write(f"CELL_TYPES {m}\n" + f"{cell_type}\n" * m)
        f.write(f"CELL_DATA {m}\nSCALARS {variable} double 1\nLOOKUP_TABLE default\n")
        for c in ordered.select(variable).toLocalIterator():
            f.write(f"{c[0]}\n")
