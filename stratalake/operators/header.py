"""Header tables: one row a survey."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..roles import Roles, col


def first_row_survey(df: DataFrame) -> Column:
    """True on a survey's uppermost row."""
    return F.row_number().over(Roles.of(df).window()) == 1


def last_row_survey(df: DataFrame) -> Column:
    """True on a survey's lowest row."""
    roles = Roles.of(df)
    return F.lead(col(roles.nr)).over(roles.window()).isNull()


def depth_relative_to_surface(df: DataFrame) -> DataFrame:
    """Tops and bottoms as elevations."""
    roles = Roles.of(df)
    roles.need("surface", "depth")
    return df.withColumns({c: col(roles.surface) - col(c) for c in (roles.top, roles.depth) if c})


def to_header(df: DataFrame, include_columns: list[str] | None = None, coordinate_names: tuple[str, str] | None = None) -> DataFrame:
    """Id, surface, coordinates, end and further columns of each survey's uppermost row, in the table's column order."""
    roles = Roles.of(df)
    x, y = coordinate_names or (roles.x, roles.y)
    if x is None or y is None or x not in df.columns or y not in df.columns:
        raise KeyError("the table has no coordinate columns")
    wanted = {roles.nr, roles.surface, roles.end, x, y, *(include_columns or [])}
    columns = [c for c in df.columns if c in wanted]
    order = roles.window() if roles.depth else Window.partitionBy(col(roles.nr)).orderBy(*map(col, columns))
    return df.withColumn("_first", F.row_number().over(order)).where(F.col("_first") == 1).select(*map(col, columns))


def standardize_column_names(df: DataFrame) -> DataFrame:
    roles = Roles.of(df)
    return df.withColumnsRenamed({c: r for r in ("nr", "surface", "x", "y", "top", "depth", "end") if (c := getattr(roles, r))})
