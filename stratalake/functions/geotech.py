"""Soil behaviour index, lithology and grain-size functions as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Grain-size classes of laboratory samples: column and the largest grain in micrometres.
CLASSES = (
    ("fractionSmaller63um", 63.0),
    ("fraction63to90um", 90.0),
    ("fraction90to125um", 125.0),
    ("fraction125to180um", 180.0),
    ("fraction180to250um", 250.0),
    ("fraction250to355um", 355.0),
    ("fraction355to500um", 500.0),
    ("fraction500to710um", 710.0),
    ("fraction710to1000um", 1000.0),
    ("fraction1000to1400um", 1400.0),
    ("fraction1400umto2mm", 2000.0),
    ("fraction2to4mm", 4000.0),
    ("fraction4to8mm", 8000.0),
    ("fraction8to16mm", 16000.0),
    ("fraction16to31_5mm", 31500.0),
    ("fraction31_5to63mm", 63000.0),
)
COARSEST = "fractionLarger63mm"


def calc_ic(qc: Column, rf: Column) -> Column:
    """Soil behaviour type index; null where a logarithm has no value."""
    return F.sqrt(F.pow(3.47 - F.log10(qc / 0.1), 2) + F.pow(F.log10(rf) + 1.22, 2))


def calc_lithology(ic: Column, qc: Column, rf: Column) -> Column:
    """Lithology class; where several rules hold, the one listed first here decides."""
    return (
        F.when((ic >= 3.6) & (rf <= 8), "Kh")
        .when(((rf > 5) & (qc < 1.5)) | (rf > 6), "V")
        .when((ic >= 3.6) & (rf > 8), "V")
        .when(ic < 2.6, "Z")
        .when(ic < 2.95, "Kz")
        .when(ic < 3.6, "K")
        .otherwise("NBE")
    )


def interpolate(at: float, xs: Column, ys: Column) -> Column:
    """Linear interpolation of ys at a value of the rising array xs; beyond its ends, the end's value; of equal xs the last."""
    reached = F.size(F.filter(xs, lambda v: v <= at))
    x0, y0, x1, y1 = (F.get(a, i) for i in (reached - 1, reached) for a in (xs, ys))
    return F.when(reached == 0, F.get(ys, F.lit(0))).when(reached == F.size(xs), y0).otherwise(y0 + (y1 - y0) / (x1 - x0) * (at - x0))


def grainsize_percentiles(df: DataFrame, percentiles: Sequence[float], only_sand: bool = False) -> DataFrame:
    """Add d<p> (d<p>_sand): the grain size below which p percent of the sample lies, classes without a value being 0."""
    classes = [c for c in CLASSES if not only_sand or 63 < c[1] <= 2000]
    sizes = [63.0 if only_sand else 0.0, *[s for _, s in classes]]
    parts = F.array(*[F.coalesce(F.col(f"`{n}`").cast("double"), F.lit(0.0)) for n, _ in classes])
    df = df.withColumn("_parts", parts)
    sums = F.transform("_parts", lambda v, i: F.aggregate(F.slice("_parts", 1, i + 1), F.lit(0.0), lambda a, b: a + b))
    df = df.withColumn("_sums", F.concat(F.array(F.lit(0.0)), sums))
    df = df.withColumn("_share", F.transform("_sums", lambda v: F.try_divide(v, F.element_at("_sums", -1)) * 100))
    knots = F.array(*map(F.lit, sizes))
    made = {f"d{p:g}{'_sand' if only_sand else ''}": F.when(F.element_at("_sums", -1) > 0, interpolate(float(p), F.col("_share"), knots)) for p in percentiles}
    return df.withColumns(made).drop("_parts", "_sums", "_share")


def grainsize_fractions(df: DataFrame) -> DataFrame:
    """Add perc_fines, perc_sand and perc_gravel; classes without a value count as 0."""
    total = lambda names: sum((F.coalesce(F.col(f"`{n}`").cast("double"), F.lit(0.0)) for n in names if n in df.columns), F.lit(0.0))
    sand = [n for n, s in CLASSES if 63 < s <= 2000]
    gravel = [n for n, s in CLASSES if s > 2000] + [COARSEST]
    return df.withColumns({"perc_fines": total(["fractionSmaller63um"]), "perc_sand": total(sand), "perc_gravel": total(gravel)})
