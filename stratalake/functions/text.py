"""Parsing of survey texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_float(c: Column) -> Column:
    """A number, or null where there is none."""
    return c.try_cast("double")


def clean_string(c: Column) -> Column:
    """Without characters other than letters, digits, ``_`` and ``.,:;!?()-``."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}_.,:;!?()\-]", "")


def parse_coordinates(c: Column) -> Column:
    """struct(a, b) of two numbers with white space, one comma or one semicolon between; anything else raises."""
    parts = F.split(F.trim(c), r"\s*[,;]\s*|\s+")
    ok = c.rlike(r"^\s*[-+0-9.eE]+(\s*[,;]\s*|\s+)[-+0-9.eE]+\s*$")
    pair = F.struct(F.get(parts, F.lit(0)).cast("double").alias("a"), F.get(parts, F.lit(1)).cast("double").alias("b"))
    return F.when(ok | c.isNull(), F.when(c.isNotNull(), pair)).otherwise(F.raise_error(F.concat(F.lit("no coordinates: "), c)))


def parse_vertical_datum(c: Column) -> Column:
    return F.when(c.isNull(), "Unknown_height_system_(meters)").when(c == "LAT", "LAT depth").otherwise(c)


def text_to_rows(c: Column, column_separator: str, row_separator: str, missing: float | None = None) -> Column:
    """array<array<double>> of a delimited block; values without a number, and the missing value, are null."""
    quoted = lambda s: r"\Q" + s + r"\E"
    value = lambda v: F.nullif(F.trim(v).try_cast("double"), F.lit(missing)) if missing is not None else F.trim(v).try_cast("double")
    rows = F.filter(F.split(F.trim(c), quoted(row_separator)), lambda r: F.trim(r) != "")
    return F.transform(rows, lambda r: F.transform(F.split(r, quoted(column_separator)), value))
