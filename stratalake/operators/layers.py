"""Depth analytics: thickness, layer tops and bases, runs, and the depth convention."""

from __future__ import annotations

import warnings
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..predicates import value_mask
from ..roles import Roles, col


class MixedDepthWarning(UserWarning):
    """Surveys of a table follow different depth conventions."""


def determine_end_depth(df: DataFrame) -> Column:
    roles = Roles.of(df)
    roles.need("surface", "depth")
    return col(roles.surface) - F.max(col(roles.depth)).over(Window.partitionBy(col(roles.nr)))


def thickness(df: DataFrame) -> Column:
    """Layer thickness; for discrete rows the step from the depth before, the first row's being its depth."""
    roles = Roles.of(df)
    roles.need("depth")
    if roles.layered:
        return F.abs(col(roles.top) - col(roles.depth))
    return col(roles.depth) - F.lag(col(roles.depth), 1, 0.0).over(roles.window())


def with_thickness(df: DataFrame) -> DataFrame:
    return df if "thickness" in df.columns else df.withColumn("thickness", thickness(df))


def cumulative_thickness(df: DataFrame, column: str, values: Any) -> DataFrame:
    """(nr, thickness) of the matching rows; surveys without one are absent."""
    nr = Roles.of(df).nr
    measured = with_thickness(df)
    return measured.where(value_mask(measured, column, values)).groupBy(nr).agg(F.sum("thickness").alias("thickness"))


def run_label(value: Column, window) -> Column:
    """Number of the run of equal values a row is in, from 1; each null starts a run."""
    before = F.lag(value).over(window)
    new = F.when(value.isNotNull() & before.isNotNull() & (value == before), 0).otherwise(1)
    return F.sum(new).over(window.rowsBetween(Window.unboundedPreceding, 0))


def bounded(df: DataFrame) -> DataFrame:
    """(nr, top, bottom) beside the other columns; discrete rows reach from the depth before to their own."""
    roles = Roles.of(df)
    roles.need("depth", error=ValueError)
    if roles.layered:
        return df.withColumns({"_top": col(roles.top), "_bottom": col(roles.depth)})
    return df.withColumns({"_top": F.lag(col(roles.depth), 1, 0.0).over(roles.window()), "_bottom": col(roles.depth)})


def merged_runs(df: DataFrame, column: str, values: Any) -> DataFrame:
    """(nr, ok, top, bottom) of the runs of rows that match alike."""
    nr = Roles.of(df).nr
    rows = bounded(df).withColumn("_ok", F.coalesce(value_mask(df, column, values), F.lit(False)))
    down = Window.partitionBy(col(nr)).orderBy("_top", "_bottom")
    rows = rows.select(nr, "_ok", "_top", "_bottom", F.lag("_ok").over(down).alias("_was"))
    # A running count of changes needs two windows over one order: one exchange and one sort serve both.
    rows = rows.withColumn("_run", F.sum(F.when(F.col("_ok").eqNullSafe(F.col("_was")), 0).otherwise(1)).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(nr, "_run").agg(F.first("_ok").alias("ok"), F.min("_top").alias("top"), F.max("_bottom").alias("bottom")).drop("_run")


def layer_top(df: DataFrame, column: str, values: Any, min_thickness: float | None = None, min_fraction: float | None = None) -> DataFrame:
    """(nr, top) of the first matching layer.

    With min_thickness the first run of matching rows at least so thick counts; with min_fraction too, the first run
    from which on that share of the next min_thickness metres matches.
    """
    nr = Roles.of(df).nr
    Roles.of(df).need("depth", error=ValueError)
    if min_thickness is not None and min_thickness <= 0:
        raise ValueError("min_thickness must be above 0")
    if min_fraction is not None and not 0 <= min_fraction <= 1:
        raise ValueError("min_fraction must lie between 0 and 1")
    if min_thickness is None:
        return bounded(df).where(value_mask(df, column, values)).groupBy(nr).agg(F.min("_top").alias("top"))
    runs = merged_runs(df, column, values)
    if min_fraction is None:
        return runs.where(F.col("ok") & (F.col("bottom") - F.col("top") >= min_thickness)).groupBy(nr).agg(F.min("top").alias("top"))
    share = share_below(runs, nr, min_thickness)
    close = F.abs(F.col("share") - min_fraction) <= 1e-8 + 1e-5 * abs(min_fraction)
    return share.where((F.col("share") > min_fraction) | close).groupBy(nr).agg(F.min("top").alias("top"))


def share_below(rows: DataFrame, nr: str, reach: float) -> DataFrame:
    """(nr, top, share): from each matching row's top, the share of the next reach metres that matches.

    Running sums in place of pairs of rows: each matching row sets a mark at the end of its reach, and in the order of
    depth, marks before rows that begin there, the sum of matching lengths up to the mark less the sum above the row is
    what matches. Only the last row before the mark can reach beyond it. The work is linear in the rows of a survey,
    and both windows share the exchange on it.
    """
    length = F.when(F.col("ok") & F.col("bottom").isNotNull(), F.col("bottom") - F.col("top")).otherwise(0.0)
    down = Window.partitionBy(nr).orderBy("top")
    above = F.sum("_len").over(down.rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.sum("_len").over(down.rangeBetween(Window.currentRow, Window.currentRow))
    rows = rows.where(F.col("top").isNotNull()).withColumn("_len", length).withColumn("_above", above)
    mark = lambda at, row: F.struct(at.cast("double").alias("at"), F.lit(row).alias("row"))
    marks = F.when(F.col("ok"), F.array(mark(F.col("top"), 1), mark(F.col("top") + reach, 0))).otherwise(F.array(mark(F.col("top"), 1)))
    events = rows.select(nr, "ok", "top", "bottom", "_len", "_above", F.explode(marks).alias("_m")).select("*", "_m.at", "_m.row")
    upto = Window.partitionBy(nr).orderBy("at", "row", "bottom").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_row = F.col("row") == 1
    events = events.withColumns({
        "_sum": F.sum(F.when(is_row, F.col("_len")).otherwise(0.0)).over(upto),
        "_last": F.last(F.when(is_row, F.struct("ok", "bottom")), ignorenulls=True).over(upto),
    })
    beyond = F.when(F.col("_last.ok"), F.greatest(F.col("_last.bottom") - F.col("at"), F.lit(0.0))).otherwise(0.0)
    return events.where(~is_row).select(nr, "top", ((F.col("_sum") - F.col("_above") - F.coalesce(beyond, F.lit(0.0))) / reach).alias("share"))


def layer_base(df: DataFrame, column: str, values: Any, min_thickness: float = 0) -> DataFrame:
    """(nr, base): the bottom of the last matching row that is thick enough by itself."""
    nr = Roles.of(df).nr
    rows = bounded(df).where(value_mask(df, column, values))
    if min_thickness:
        rows = rows.where(F.col("_bottom") - F.col("_top") >= min_thickness)
    return rows.groupBy(nr).agg(F.max_by("_bottom", F.struct("_top", "_bottom")).alias("base"))


def top_of_sand(df: DataFrame, lith: str = "lith", fraction: float = 0.5, reach: float = 1.0, sand: tuple[str, ...] = ("Z", "G")) -> DataFrame:
    """(nr, top) for every survey: the first sand layer from which on reach metres hold that share of sand; else null.

    Shares that differ from the wanted one by rounding count as equal to it.
    """
    roles = Roles.of(df)
    roles.need("top", "depth")
    rows = df.select(col(roles.nr).alias("nr"), F.coalesce(col(lith).isin(*sand), F.lit(False)).alias("ok"), col(roles.top).alias("top"), col(roles.depth).alias("bottom"))
    found = share_below(rows, "nr", reach).where(F.col("share") >= fraction - 1e-9).groupBy("nr").agg(F.min("top").alias("top"))
    return rows.select("nr").distinct().join(found, "nr", "left")


def adjust_depths(df: DataFrame) -> DataFrame:
    """Depths positive downward from the surface, whichever convention the table follows.

    One aggregate decides for the whole table: the surveys' first tops all equal the surface (elevations), or all lie
    at 0 (depths of either sign); where surveys differ the table stays and a MixedDepthWarning tells so.
    """
    roles = Roles.of(df)
    roles.need("surface", "depth")
    near = lambda a, b: F.abs(a - b) <= 1e-8 + 1e-5 * F.abs(b)
    depth, surface = col(roles.depth), col(roles.surface)
    if roles.layered:
        top = col(roles.top)
        rows = df.groupBy(roles.nr).agg(F.first(surface).alias("s"), F.max(top).alias("hi"), F.min(top).alias("lo"), F.min(F.abs(top)).alias("near"), F.max(depth).alias("deep"), F.min(depth).alias("low"))
        # The first layer is the one next to the surface: the highest top of elevations, the smallest of depths.
        flags = rows.agg(
            F.bool_and(near(F.col("hi"), F.col("s")) & (F.col("low") < F.col("hi"))).alias("elevations"),
            F.bool_and(F.col("near") <= 1e-8).alias("depths"),
        ).first()
    else:
        order = Window.partitionBy(col(roles.nr)).orderBy("_pos")
        rows = df.withColumn("_pos", F.monotonically_increasing_id()).select(col(roles.nr).alias("nr"), surface.alias("s"), depth.alias("z"), (depth - F.lag(depth).over(order)).alias("step"), F.row_number().over(order).alias("i"))
        rows = rows.groupBy("nr").agg(F.max(F.when(F.col("i") == 1, F.col("s"))).alias("s"), F.max(F.when(F.col("i") == 1, F.col("z"))).alias("z"), F.avg("step").alias("step"))
        start = F.col("z") - F.col("step")
        flags = rows.agg(F.bool_and(F.coalesce(near(start, F.col("s")), F.lit(False))).alias("elevations"), F.bool_and(F.coalesce(near(start, F.lit(0.0)), F.lit(False))).alias("depths")).first()
    columns = [c for c in (roles.top, roles.depth) if c]
    if flags.depths:
        return df.withColumns({c: F.abs(col(c)) for c in columns})
    if flags.elevations:
        return df.withColumns({c: surface - col(c) for c in columns})
    if flags.elevations is not None:
        warnings.warn("surveys follow different depth conventions; depths stay as they are", MixedDepthWarning, stacklevel=2)
    return df
