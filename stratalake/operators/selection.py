"""Selections of surveys and of rows, by value, elevation, length and depth."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..predicates import between, bound, negate, value_mask
from ..roles import Roles, col


def surveys_where(df: DataFrame, condition: Column, invert: bool = False) -> DataFrame:
    """All rows of the surveys with a row that meets the condition; inverted, of the others."""
    nr = Roles.of(df).nr
    ids = df.where(condition).select(nr).distinct()
    return df.join(ids, nr, "left_anti" if invert else "left_semi")


def select_by_values(df: DataFrame, column: str, values: Any, how: str = "or", invert: bool = False, inclusive: str = "both") -> DataFrame:
    """Whole surveys: with any matching row, or (``and``) with every one of the values."""
    if how not in ("or", "and"):
        raise ValueError(f"how can't be {how!r}")
    mask = value_mask(df, column, values, inclusive)
    if how == "or" or isinstance(values, (slice, str, int, float)):
        return surveys_where(df, mask, invert)
    nr, wanted = Roles.of(df).nr, len(set(values))
    ids = df.where(mask).groupBy(nr).agg(F.count_distinct(col(column)).alias("_n")).where(F.col("_n") == wanted).select(nr)
    return df.join(ids, nr, "left_anti" if invert else "left_semi")


def slice_by_values(df: DataFrame, column: str, values: Any, invert: bool = False, inclusive: str = "both") -> DataFrame:
    """Matching rows; inverted, the other rows."""
    return select_by_condition(df, value_mask(df, column, values, inclusive), invert)


def select_by_condition(df: DataFrame, condition: Column, invert: bool = False) -> DataFrame:
    return df.where(negate(condition) if invert else condition)


def end_elevation(df: DataFrame) -> Column:
    """The end column, or the surface less the survey's largest depth."""
    roles = Roles.of(df)
    if roles.end:
        return col(roles.end)
    roles.need("surface", "depth")
    return col(roles.surface) - F.max(col(roles.depth)).over(Window.partitionBy(col(roles.nr)))


def _inside(c: Column, low: float | None, high: float | None) -> Column:
    out = F.lit(True)
    if low is not None:
        out = out & (c >= low)
    if high is not None:
        out = out & (c <= high)
    return out


def select_by_elevation(df: DataFrame, top_min: float | None = None, top_max: float | None = None, end_min: float | None = None, end_max: float | None = None) -> DataFrame:
    """Surveys whose surface and end elevations lie in these ranges, bounds included."""
    roles = Roles.of(df)
    roles.need("surface")
    out = df.where(_inside(col(roles.surface), top_min, top_max))
    if end_min is None and end_max is None:
        return out
    return out.withColumn("_end", end_elevation(out)).where(_inside(F.col("_end"), end_min, end_max)).drop("_end")


def select_by_length(df: DataFrame, min_length: float | None = None, max_length: float | None = None) -> DataFrame:
    roles = Roles.of(df)
    roles.need("surface")
    return df.withColumn("_end", end_elevation(df)).where(_inside(col(roles.surface) - F.col("_end"), min_length, max_length)).drop("_end")


def slice_depth_interval(df: DataFrame, upper: float | None = None, lower: float | None = None, relative_to_vertical_reference: bool = False, update_layer_boundaries: bool = True) -> DataFrame:
    """Rows in a depth interval; bounds are depths, or elevations if relative to the vertical reference.

    Layers that overlap the interval stay and are clipped; of discrete rows those inside stay, bounds included. An
    upper bound of 0 or None, and a lower one, is open.
    """
    roles = Roles.of(df)
    roles.need("depth")
    limits: list[Column | None] = []
    for value in (upper, lower):
        if not bound(value, 0):
            limits.append(None)
        elif relative_to_vertical_reference:
            roles.need("surface")
            limits.append(col(roles.surface) - F.lit(float(value)))
        else:
            limits.append(F.lit(float(value)))
    high, low = limits
    depth = col(roles.depth)
    keep = F.lit(True)
    if not roles.layered:
        keep = keep & (depth >= high) if high is not None else keep
        return df.where(keep & (depth <= low) if low is not None else keep)
    keep = keep & (depth > high) if high is not None else keep
    keep = keep & (col(roles.top) < low) if low is not None else keep
    out = df.where(keep)
    if update_layer_boundaries:
        made = {}
        if high is not None:
            made[roles.top] = F.greatest(col(roles.top), high)
        if low is not None:
            made[roles.depth] = F.least(depth, low)
        out = out.withColumns(made) if made else out
    return out


__all__ = ["between", "end_elevation", "select_by_condition", "select_by_elevation", "select_by_length", "select_by_values", "slice_by_values", "slice_depth_interval", "surveys_where"]
