"""Validation of survey tables in one pass of flags."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..roles import Roles, col


@dataclass
class ValidationSettings:
    """How errors are handled; DROP_INVALID drops whole surveys."""

    SKIP: bool = False
    VERBOSE: bool = True
    DROP_INVALID: bool = True
    FLAG_INVALID: bool = False
    AUTO_ALIGN: bool = True

    def reset(self) -> None:
        self.__init__()


settings = ValidationSettings()


def rules(df: DataFrame, order: Column | None = None) -> dict[str, Column]:
    """Rule -> condition that a row breaks it. Depths must rise in the rows' order, which order gives (default: as
    scanned; a table of several files needs a column for it)."""
    roles = Roles.of(df)
    roles.need("nr", "surface", error=ValueError)
    number = lambda c: col(c).cast("string").try_cast("double")
    made = {f"{c} is no number": number(c).isNull() for c in (roles.surface, roles.x, roles.y, roles.top, roles.depth) if c}
    by = Window.partitionBy(col(roles.nr)).orderBy(order if order is not None else F.col("_pos"))
    if roles.layered:
        made["top is not above bottom"] = number(roles.top) >= number(roles.depth)
        made["top is not below the top before"] = number(roles.top) <= F.lag(number(roles.top)).over(by)
        made["bottom is not below the bottom before"] = number(roles.depth) <= F.lag(number(roles.depth)).over(by)
    elif roles.depth:
        made["depth is not below the depth before"] = number(roles.depth) <= F.lag(number(roles.depth)).over(by)
    return made


def flagged(df: DataFrame, order: Column | None = None) -> DataFrame:
    """df with the list _errors of the rules that each row breaks."""
    if order is None:
        if len(df.inputFiles()) > 1:
            warnings.warn("rows of several files have no order of their own: give a column for it", UserWarning, stacklevel=3)
        df = df.withColumn("_pos", F.monotonically_increasing_id())
    broken = [F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules(df, order).items()]
    return df.withColumn("_errors", F.filter(F.array(*broken), lambda e: e.isNotNull())).drop("_pos")


def errors(df: DataFrame, order: Column | None = None) -> DataFrame:
    """(nr, rule, n): how many rows of a survey break a rule."""
    nr = Roles.of(df).nr
    return flagged(df, order).select(nr, F.explode("_errors").alias("rule")).groupBy(nr, "rule").agg(F.count("*").alias("n"))


def validate(df: DataFrame, order: Column | None = None, use: ValidationSettings | None = None) -> DataFrame:
    """df with numeric columns as doubles, and without the surveys that break a rule, or with is_valid on each row."""
    use = use or settings
    if use.SKIP:
        return df
    roles = Roles.of(df)
    rows = flagged(df, order)
    numbers = {c: col(c).cast("string").try_cast("double") for c in (roles.surface, roles.x, roles.y, roles.top, roles.depth) if c and dict(df.dtypes)[c] not in ("double", "float", "int", "bigint")}
    rows = rows.withColumns(numbers) if numbers else rows
    if use.FLAG_INVALID:
        return rows.withColumn("is_valid", F.size("_errors") == 0).drop("_errors")
    if use.DROP_INVALID:
        bad = F.max(F.size("_errors")).over(Window.partitionBy(col(roles.nr)))
        return rows.withColumn("_bad", bad).where("_bad = 0").drop("_bad", "_errors")
    return rows.drop("_errors")
