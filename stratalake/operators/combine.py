"""Surveys met with voxel models."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..roles import Roles, col
from .voxel import KEYS, VoxelModel


def add_nearest_voxels(data: DataFrame, model: VoxelModel, data_vars: str | list[str], tolerances: tuple[float, float, float] | None = None) -> DataFrame:
    """Add variables of the nearest voxel to each row, null where it is further away on an axis than the tolerance.

    A row's elevation is that of its layer's middle, or of its depth. The nearest cell is computed, so this is an
    equi-join on its three numbers.
    """
    roles = Roles.of(data)
    roles.need("x", "y", "surface", "depth")
    names = [data_vars] if isinstance(data_vars, str) else list(data_vars)
    middle = (col(roles.top) + col(roles.depth)) / 2 if roles.layered else col(roles.depth)
    at = {"x": col(roles.x).cast("double"), "y": col(roles.y).cast("double"), "z": col(roles.surface) - middle}
    dy, dx, dz = model.resolution
    reach = dict(zip("xyz", tolerances or (dx, dy, dz)))
    rows = data.withColumns({f"_{a}": v for a, v in at.items()}).withColumns({f"_c{k}": getattr(model, a).index(F.col(f"_{a}")) for a, k in KEYS.items()})
    cells = model.cells().select(*KEYS.values(), *[col(n).alias(f"_v_{n}") for n in names])
    same = reduce(and_, [F.col(f"_c{k}") == F.col(k) for k in KEYS.values()])
    near = reduce(and_, [F.abs(F.col(f"_{a}") - getattr(model, a).centre(F.col(f"_c{k}"))) <= reach[a] for a, k in KEYS.items()])
    joined = rows.join(cells, same, "left")
    kept = [c for c in data.columns if c not in names]
    return joined.select(*map(col, kept), *[F.when(near, col(f"_v_{n}")).alias(n) for n in names])


def unit_boundaries(model: VoxelModel, variable: str) -> DataFrame:
    """(x, y, variable, elevation): the lower boundary of each run of equal values going up a voxel column; runs of nulls
    are left out."""
    below = F.lag(col(variable)).over(Window.partitionBy("x", "y").orderBy("z"))
    cells = model[variable].withColumn("_below", below)
    starts = cells.where(col(variable).isNotNull() & (F.col("_below").isNull() | (F.col("_below") != col(variable))))
    return starts.select("x", "y", variable, (F.col("z") - model.z.step / 2).alias("elevation"))


def reset_tops(data: DataFrame) -> DataFrame:
    """Raise tops to the bottom above where they lie higher, and drop layers without thickness."""
    roles = Roles.of(data)
    above = F.lag(col(roles.depth)).over(Window.partitionBy(col(roles.nr)).orderBy(col(roles.depth)))
    return data.withColumn(roles.top, F.greatest(col(roles.top), F.coalesce(above, col(roles.top)))).where(col(roles.depth) > col(roles.top))


def split_at_voxel_units(data: DataFrame, header: DataFrame, model: VoxelModel, variable: str) -> DataFrame:
    """Rows of the surveys split where the model's unit changes, with the unit as a new column.

    Boundaries come in as rows of their own, take the values of the next row below, and yield to rows at one depth.
    """
    roles = Roles.of(data)
    roles.need("surface", "depth")
    nr, depth = roles.nr, roles.depth
    h = Roles.of(header)
    # The runs of a column are found once, however many surveys stand in it.
    known = h.surface is not None
    points = header.select(col(h.nr).alias(nr), col(h.x).cast("double").alias("_x"), col(h.y).cast("double").alias("_y"), *([col(h.surface).alias("_surface")] if known else []))
    points = model.snap(points, F.col("_x"), F.col("_y"))
    runs = unit_boundaries(model, variable).withColumns({"_i": model.x.index(F.col("x")), "_j": model.y.index(F.col("y"))})
    bounds = points.join(runs, (F.col("_ci") == F.col("_i")) & (F.col("_cj") == F.col("_j")))
    if not known:
        bounds = bounds.join(data.groupBy(nr).agg(F.first(col(roles.surface)).alias("_surface")), nr)
    bounds = bounds.where(F.col("elevation") < F.col("_surface"))
    new = bounds.select(nr, (F.col("_surface") - F.col("elevation")).alias(depth), col(variable), F.lit(1).alias("_src"))
    rows = data.withColumns({variable: F.lit(None).cast(model.df.schema[variable].dataType), "_src": F.lit(0)}).unionByName(new, allowMissingColumns=True)
    # From the deepest row up, so that the frame ends at the current row and grows by one.
    up = Window.partitionBy(col(nr)).orderBy(F.desc(depth), F.desc("_src"))
    fill = [c for c in rows.columns if c not in (nr, depth, "_src")]
    below = up.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    above = F.lead(F.struct(col(depth), F.lit(1))).over(up)
    filled = rows.select(nr, col(depth), *[F.last(col(c), ignorenulls=True).over(below).alias(c) for c in fill], above.alias("_above"))
    # Of rows at one depth the last on the way up stays: one of the survey's own, if there is any.
    last = F.col("_above").isNull() | ~F.col("_above")[depth].eqNullSafe(col(depth))
    out = filled.where(col(roles.surface).isNotNull() & last).select(*map(col, data.columns), col(variable))
    return reset_tops(out) if roles.layered else out
