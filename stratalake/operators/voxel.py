"""Voxel models as long relations (x, y, z, variables...) with their grid as metadata.

An axis keeps the coordinates as they are stored; cells are met by their integer numbers (i, j, k) on the axes, never by
coordinates that were computed. Axes may be irregular: then a number is found by binary search among the coordinates.
"""

from __future__ import annotations

import json
import math
import struct
from bisect import bisect_right
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace
from functools import cached_property, reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..roles import Roles, col
from .layers import run_label

AXES = ("x", "y", "z")
#: Names of the cells' numbers on the axes.
KEYS = {"x": "_i", "y": "_j", "z": "_k"}
#: Classes that a dense table of counts may have: they become columns' values in the plan.
MAX_VALUES = 10_000


#: Coordinates closer than this part of a step are one, and an axis that is even to this part of a step is regular.
NOISE, EVEN = 1e-9, 1e-6


def turn(a: float, b: float) -> float:
    """The least number whose distance to b, as it is computed, is not above that to a; a < b."""
    nearer = lambda v: b - v <= v - a
    middle = (a + b) / 2
    if nearer(middle) and not nearer(math.nextafter(middle, -math.inf)):
        return middle
    # Halving between a and b, over numbers as integers in their order.
    key = lambda v: struct.unpack("<q", struct.pack("<d", abs(v)))[0] * (-1 if v < 0 else 1)
    number = lambda k: struct.unpack("<d", struct.pack("<q", k))[0] if k >= 0 else -struct.unpack("<d", struct.pack("<q", -k))[0]
    low, high = key(a), key(b)
    while high - low > 1:
        at = (low + high) // 2
        low, high = (low, at) if nearer(number(at)) else (at, high)
    return number(high)


@dataclass(frozen=True)
class Axis:
    """An axis of cell centres, ascending, as stored; ``step`` is the nominal width of a cell."""

    centres: tuple[float, ...]
    step: float

    @classmethod
    def of(cls, values: Iterable[float], first_step: bool = False, step: float = 1.0) -> Axis:
        """The axis of these coordinates. Its step is the mean one; with first_step, on an irregular axis, the first.

        ``step`` is that of a single coordinate. Coordinates that differ by rounding alone are one.
        """
        found = sorted(v for v in values if v is not None and not math.isnan(v))
        if len(found) > 1:
            mean = (found[-1] - found[0]) / (len(found) - 1)
            noise = NOISE * max(mean, abs(found[0]), abs(found[-1]))
            found = [v for u, v in zip([None, *found], found) if u is None or v - u > noise]
        if len(found) > 1:
            step = (found[-1] - found[0]) / (len(found) - 1)
            out = cls(tuple(found), step)
            return out if out.regular or not first_step else cls(out.centres, found[1] - found[0])
        return cls(tuple(found), step)

    @property
    def size(self) -> int:
        return len(self.centres)

    @property
    def low(self) -> float:
        return (self.centres[0] if self.centres else 0.0) - self.step / 2

    @property
    def high(self) -> float:
        return (self.centres[-1] if self.centres else 0.0) + self.step / 2

    @cached_property
    def regular(self) -> bool:
        c, n = self.centres, len(self.centres)
        mean = (c[-1] - c[0]) / (n - 1) if n > 1 else self.step
        return all(abs(v - (c[0] + i * mean)) <= EVEN * mean for i, v in enumerate(c))

    @cached_property
    def edges(self) -> list[float]:
        """The cells' borders: half-way between centres, and half a step beyond the outer ones."""
        c = self.centres
        return [self.low, *[(a + b) / 2 for a, b in zip(c, c[1:])], self.high]

    @cached_property
    def turns(self) -> list[float]:
        """For each centre but the last the least number that is nearer to the next one, or as near."""
        return [turn(a, b) for a, b in zip(self.centres, self.centres[1:])]

    def place(self, v: float) -> int:
        """Number of the nearest centre; half-way between two the larger coordinate's."""
        return bisect_right(self.turns, v)

    @cached_property
    def constants(self) -> tuple[Column, Column]:
        """Centres and turns, each as one constant of the plan and not a term a number."""
        return tuple(F.from_json(F.lit(json.dumps(x)), "array<double>") for x in (self.centres, self.turns))

    def centre(self, i: Column) -> Column:
        return F.get(self.constants[0], i)

    def index(self, v: Column) -> Column:
        """place() as a column, from 0; null for null. One outside belongs to the edge's cell.

        On a regular axis arithmetic comes within one of the number and the turns beside it decide; on others a binary
        search over the turns finds it.
        """
        v, turns = v.cast("double"), self.constants[1]
        if self.size < 2:
            found = F.lit(0)
        elif self.regular:
            mean = (self.centres[-1] - self.centres[0]) / (self.size - 1)
            g = F.least(F.greatest(F.floor((v - (self.centres[0] - mean / 2)) / mean), F.lit(0)), F.lit(self.size - 1)).cast("int")
            found = g + F.when(v >= F.get(turns, g), 1).when(v < F.get(turns, g - 1), -1).otherwise(0)
        else:
            # Halving strides: a stride is taken where the turn it leads over is not above v.
            strides = F.lit([1 << k for k in range((self.size - 1).bit_length() - 1, -1, -1)])
            found = F.aggregate(strides, F.lit(0), lambda i, k: F.when(F.get(turns, i + k - 1) <= v, i + k).otherwise(i))
        return F.when(v.isNotNull() & ~F.isnan(v), found).cast("int")

    def nearest(self, v: Column) -> Column:
        return self.centre(self.index(v))

    def without(self, keep: Sequence[int]) -> Axis:
        """The axis of some of its cells, given by number in ascending order."""
        return Axis.of([self.centres[i] for i in keep], step=self.step)


@dataclass(frozen=True)
class VoxelModel:
    """A regular grid; cells without a value have nulls or, until :meth:`dense`, no row."""

    df: DataFrame
    x: Axis
    y: Axis
    z: Axis
    crs: int | None = None

    @classmethod
    def from_table(cls, df: DataFrame, crs: int | None = None, data_vars: Sequence[str] | None = None, bbox: tuple[float, float, float, float] | None = None) -> VoxelModel:
        """A model of a long table; bbox and data_vars reach the scan. The axes are read with one aggregate."""
        if missing := [a for a in AXES if a not in df.columns]:
            raise ValueError(f"a model has the dimensions x, y and z; there is no {', '.join(missing)}")
        names = list(data_vars) if data_vars else [c for c in df.columns if c not in AXES]
        df = df.select(*AXES, *map(col, names))
        if bbox:
            df = df.where((F.col("x") >= bbox[0]) & (F.col("y") >= bbox[1]) & (F.col("x") <= bbox[2]) & (F.col("y") <= bbox[3]))
        df = df.withColumns({n: F.nanvl(col(n), F.lit(None)) for n, t in df.dtypes if t in ("double", "float") and n in names})
        axes, noisy = axes_of(df, AXES)
        return cls(df.withColumns({a: axes[a].nearest(F.col(a)) for a in noisy}), crs=crs, **axes)

    @classmethod
    def from_netcdf(cls, spark: SparkSession, path: str, data_vars: Sequence[str] | None = None, bbox: tuple[float, float, float, float] | None = None, crs: int | None = None, lower_left: tuple[float, float] | None = None) -> VoxelModel:
        """A model of a classic NetCDF file, of which tasks read the variables and the box alone.

        ``lower_left``: (cell size, height of a cell) where the file names cells by their lower left bottom corner.
        """
        from ..sources.netcdf import read_netcdf

        if lower_left:
            size, dz = lower_left
            wide = (bbox[0] - size, bbox[1] - size, bbox[2] + size, bbox[3] + size) if bbox else None
            return cls.from_lower_left(read_netcdf(spark, path, data_vars, wide), size, dz, crs, bbox, data_vars)
        return cls.from_table(read_netcdf(spark, path, data_vars, bbox), crs, data_vars)

    @classmethod
    def from_lower_left(cls, df: DataFrame, cellsize: float, dz: float, crs: int | None = None, bbox: tuple[float, float, float, float] | None = None, data_vars: Sequence[str] | None = None) -> VoxelModel:
        """A model whose table names cells by their lower left bottom corner."""
        if bbox:
            h = cellsize / 2
            bbox = (bbox[0] - h, bbox[1] - h, bbox[2] + h, bbox[3] + h)
        return cls.from_table(cell_centres(df, cellsize, dz), crs, data_vars, bbox)

    @property
    def variables(self) -> list[str]:
        return [c for c in self.df.columns if c not in AXES]

    @property
    def resolution(self) -> tuple[float, float, float]:
        """(dy, dx, dz)."""
        return self.y.step, self.x.step, self.z.step

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        return self.x.low, self.y.low, self.x.high, self.y.high

    @property
    def z_bounds(self) -> tuple[float, float]:
        return self.z.low, self.z.high

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.y.size, self.x.size, self.z.size

    @cached_property
    def sizes(self) -> dict[str, int]:
        return dict(zip(("y", "x", "z"), self.shape))

    def __getitem__(self, name: str) -> DataFrame:
        return self.df.select(*AXES, col(name))

    def with_variable(self, name: str, value: Column) -> VoxelModel:
        return replace(self, df=self.df.withColumn(name, value))

    def cells(self, axes: str = "xyz") -> DataFrame:
        """The cells with their numbers _i, _j, _k on the axes: what joins meet them by."""
        return self.df.withColumns({KEYS[a]: getattr(self, a).index(F.col(a)) for a in axes})

    def dense(self) -> VoxelModel:
        """The model with a row for every cell of its grid; cells that the table has no row for have nulls."""
        ny, nz, n = self.y.size, self.z.size, F.col("id")
        numbers = {"x": F.floor(n / (ny * nz)), "y": F.pmod(F.floor(n / nz), F.lit(ny)), "z": F.pmod(n, F.lit(nz))} if ny * nz else dict.fromkeys(AXES, n)
        grid = self.df.sparkSession.range(self.x.size * ny * nz).select(*[v.cast("int").alias(f"_n{a}") for a, v in numbers.items()])
        cells = self.cells().drop(*AXES)
        met = grid.join(cells, reduce(and_, [F.col(f"_n{a}") == F.col(k) for a, k in KEYS.items()]), "left")
        return replace(self, df=met.select(*[getattr(self, a).centre(F.col(f"_n{a}")).alias(a) for a in AXES], *map(col, self.variables)))

    def _number(self, name: str, v: Column) -> Column:
        """The number of a cell that a coordinate names, rounding apart; null where it names none."""
        axis: Axis = getattr(self, name)
        return F.when(F.abs(axis.nearest(v) - v) <= EVEN * axis.step, axis.index(v))

    def _kept(self, name: str, keep: Sequence[int]) -> VoxelModel:
        """The cells with these numbers on an axis; the condition, a range where they are in a row, reaches the scan."""
        axis: Axis = getattr(self, name)
        if len(keep) == axis.size:
            return self
        found = [axis.centres[i] for i in keep]
        if keep and keep[-1] - keep[0] + 1 == len(keep):
            condition = (F.col(name) >= found[0]) & (F.col(name) <= found[-1])
        else:
            condition = F.col(name).isin(found) if found else F.lit(False)
        return replace(self, df=self.df.where(condition), **{name: axis.without(keep)})

    def sel(self, method: str | None = None, **labels: Any) -> VoxelModel:
        """By coordinates: values, slices (bounds included) or, with method ``nearest``, the nearest ones."""
        out = self
        for name, wanted in labels.items():
            axis: Axis = getattr(self, name)
            if isinstance(wanted, slice):
                keep = [i for i, c in enumerate(axis.centres) if (wanted.start is None or c >= wanted.start) and (wanted.stop is None or c <= wanted.stop)]
            else:
                wanted = [wanted] if isinstance(wanted, (int, float)) else list(wanted)
                keep = sorted({axis.place(v) for v in wanted}) if axis.size else []
                if method != "nearest":
                    far = lambda v: not axis.size or abs(axis.centres[axis.place(v)] - v) > NOISE * max(axis.step, abs(v))
                    if missing := [v for v in wanted if far(v)]:
                        raise KeyError(f"{name} has no {missing}")
            out = out._kept(name, keep)
        return out

    def isel(self, **positions: Any) -> VoxelModel:
        """By positions on the axes (y from the north down, as exported)."""
        out = self
        for name, at in positions.items():
            numbers = range(getattr(self, name).size)
            numbers = numbers[::-1] if name == "y" else numbers
            out = out._kept(name, sorted(set(numbers[at]) if isinstance(at, slice) else {numbers[i] for i in ([at] if isinstance(at, int) else at)}))
        return out

    def snap(self, points: DataFrame, x: Column, y: Column, inside: bool = True) -> DataFrame:
        """points with the numbers _ci, _cj of the nearest voxel column."""
        if inside:
            low = self.bounds
            points = points.where((x >= low[0]) & (x <= low[2]) & (y >= low[1]) & (y <= low[3]))
        return points.withColumns({"_ci": self.x.index(x), "_cj": self.y.index(y)})

    def _columns_at(self, points: DataFrame, keys: list[str]) -> DataFrame:
        # The points' columns carry names that no cell has.
        own = {k: f"_key_{n}" for n, k in enumerate(keys)}
        points = points.select(*[col(k).alias(v) for k, v in own.items()], "_ci", "_cj")
        met = points.join(self.cells("xy"), (F.col("_ci") == F.col("_i")) & (F.col("_cj") == F.col("_j")))
        return met.select(*[col(v).alias(k) for k, v in own.items()], *AXES, *map(col, self.variables))

    def select_with_points(self, points: DataFrame, key: str) -> DataFrame:
        """(key, x, y, z, variables): the voxel column nearest to each point within the model's bounds."""
        roles = Roles.of(points) if key in points.columns and "x" not in points.columns else None
        x, y = (col(roles.x), col(roles.y)) if roles else (F.col("x"), F.col("y"))
        return self._columns_at(self.snap(points.select(col(key), x.alias("_x"), y.alias("_y")), F.col("_x"), F.col("_y")), [key])

    def sample_along_line(self, line: Sequence[tuple[float, float]], dist: float | None = None, nsamples: int | None = None) -> DataFrame:
        """(distance, x, y, z, variables) at equal distances along a line: every dist (the end excluded) or nsamples."""
        path = [(float(x), float(y)) for x, y in line]
        one = self.df.sparkSession.createDataFrame([(0, path)], "line int, path array<struct<x: double, y: double>>")
        return self.sample_along_lines(one, "line", dist, nsamples).drop("line")

    def sample_along_lines(self, lines: DataFrame, key: str, dist: float | None = None, nsamples: int | None = None, path: str = "path") -> DataFrame:
        """(key, distance, x, y, z, variables) at equal distances along each line of a table, as for one line.

        A line is an array of points (x, y). Its stops are unfolded in the tasks that read it and met with the cells by
        number; a line without length has one stop, an empty one none.
        """
        if (dist is None) == (nsamples is None):
            raise ValueError("give either dist or nsamples")
        return self._columns_at(self.snap(stops(lines, key, path, dist, nsamples), F.col("_x"), F.col("_y"), inside=False), [key, "distance"])

    def slice_depth_interval(self, upper: float | DataFrame, lower: float | DataFrame, how: str = "overlap", drop: bool = True) -> VoxelModel:
        """Cells between two elevations; the others are null and, with drop, coordinates without a cell go.

        A bound is a number or a table (x[, y], bound), met by the cells' numbers. ``overlap``: cells that reach into the interval; ``majority``:
        centres inside; ``inner``: cells inside as a whole.
        """
        if upper is None or lower is None:
            raise TypeError("both bounds are needed")
        if how not in ("overlap", "majority", "inner"):
            raise ValueError(f"how can't be {how!r}")
        df, h = self.df, self.z.step / 2
        bounds = []
        for name, value in (("_upper", upper), ("_lower", lower)):
            if isinstance(value, DataFrame):
                keys = [c for c in value.columns if c in ("x", "y")]
                at = value.select(*[self._number(c, value[c]).alias(f"{name}{c}") for c in keys], F.col("bound").cast("double").alias(name))
                df = df.join(at, reduce(and_, [self._number(c, F.col(c)) == F.col(f"{name}{c}") for c in keys]), "left").drop(*[f"{name}{c}" for c in keys])
                bounds.append(F.col(name))
            else:
                bounds.append(F.lit(float(value)))
        z = F.col("z")
        high, low = {"overlap": (z - h < bounds[0], z + h > bounds[1]), "majority": (z <= bounds[0], z >= bounds[1]), "inner": (z + h <= bounds[0], z - h >= bounds[1])}[how]
        keep = F.coalesce(high & low, F.lit(False))
        out = df.withColumn("_keep", keep).withColumns({v: F.when(F.col("_keep"), col(v)) for v in self.variables})
        if not drop:
            return replace(self, df=out.select(*AXES, *map(col, self.variables)))
        axes = {}
        out = out.withColumns({"_hi": F.coalesce(high, F.lit(False)), "_lo": F.coalesce(low, F.lit(False))})
        if any(isinstance(v, DataFrame) for v in (upper, lower)):
            # A coordinate stays if both conditions leave a cell there, one after the other. The coordinates of an axis
            # are as few as the grid is wide, so they are summed up in the tasks and become a filter.
            for flag in ("_hi", "_lo"):
                sets = out.agg(*[F.collect_set(F.when(F.col(flag), F.col(a))).alias(a) for a in AXES]).first()
                for a in AXES:
                    out = out.where(F.col(a).isin(sets[a]) if sets[a] else F.lit(False))
            axes = {a: getattr(self, a).without(sorted(getattr(self, a).place(v) for v in sets[a])) for a in AXES}
            return replace(self, df=out.select(*AXES, *map(col, self.variables)), **axes)
        # Numbers cut the z axis alone, and the scan with it.
        reaches = {"overlap": lambda c: c - h < upper and c + h > lower, "majority": lambda c: lower <= c <= upper, "inner": lambda c: c + h <= upper and c - h >= lower}[how]
        return self._kept("z", [i for i, c in enumerate(self.z.centres) if reaches(c)])

    def thickness(self, condition: Column, depth_range: tuple[float, float] | None = None) -> DataFrame:
        """(x, y, thickness) of the cells that meet a condition; 0 where none does."""
        if depth_range:
            condition = condition & F.col("z").between(min(depth_range), max(depth_range))
        return self.df.groupBy("x", "y").agg(F.sum(F.when(condition, self.z.step).otherwise(0.0)).alias("thickness"))

    def most_common(self, variable: str) -> DataFrame:
        """(x, y, value, thickness): the most frequent value of each column, of equal ones the smallest."""
        counts = self.df.where(col(variable).isNotNull()).groupBy("x", "y", col(variable).alias("value")).agg(F.count("*").alias("n"))
        best = F.max(F.struct("n", (-F.col("value").cast("double")).alias("v"), "value"))
        found = counts.groupBy("x", "y").agg(best.alias("b")).select("x", "y", F.col("b.value").alias("value"), (F.col("b.n") * self.z.step).alias("thickness"))
        return self.df.select("x", "y").distinct().join(found, ["x", "y"], "left")

    def value_counts(self, variable: str, dim: str | None = None, normalize: bool = False) -> DataFrame:
        """Counts of the values, over all or along one dimension (then dense, with zeros), or their shares."""
        v = col(variable).alias("value")
        if dim is None:
            out = self.df.where(col(variable).isNotNull()).groupBy(v).agg(F.count("*").alias("n"))
            if not normalize:
                return out
            return out.crossJoin(F.broadcast(out.agg(F.sum("n").alias("_all")))).select("value", (F.col("n") / F.col("_all")).alias("share"))
        rest = [a for a in AXES if a != dim]
        values = self.df.where(col(variable).isNotNull()).select(v).distinct()
        known = sorted(r.value for r in values.limit(MAX_VALUES + 1).collect())
        if len(known) > MAX_VALUES:
            raise ValueError(f"{variable} has more than {MAX_VALUES} values: count them with dim=None, or class them first")
        cells = self.df.groupBy(*rest, v).agg(F.count("*").alias("n"))
        pair = F.when(F.col("value").isNotNull(), F.struct("value", "n"))
        counts = cells.groupBy(*rest).agg(F.map_from_entries(F.collect_list(pair)).alias("n"))
        every = F.explode(F.array(*map(F.lit, known)).cast(f"array<{self.df.schema[variable].dataType.simpleString()}>"))
        out = counts.select(*rest, every.alias("value"), "n").withColumn("n", F.coalesce(F.element_at("n", F.col("value")), F.lit(0)))
        if not normalize:
            return out
        return out.select(*rest, "value", F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy(*rest))).alias("share"))


def axes_of(df: DataFrame, names: Sequence[str]) -> tuple[dict[str, Axis], list[str]]:
    """The axes of a table of cells, and those with coordinates that differ by rounding. One pass, with the coordinates
    of an axis as a set in each task, which is no larger than the grid is wide."""
    row = df.agg(*[F.collect_set(F.col(a).cast("double")).alias(a) for a in names]).first()
    axes = {a: Axis.of(row[a], first_step=a == "z") for a in names}
    return axes, [a for a in names if axes[a].size < len({v for v in row[a] if not math.isnan(v)})]


def stops(lines: DataFrame, key: str, path: str, dist: float | None, nsamples: int | None) -> DataFrame:
    """(key, distance, _x, _y): points at equal distances along lines, without Python."""
    if dist is not None and dist <= 0 or nsamples is not None and nsamples < 1:
        raise ValueError("dist must be above 0, nsamples at least 1")
    p = lines.where(F.size(path) > 0).select(col(key), col(path).alias("_p"))
    size = lambda a, b: F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"]))
    steps = F.transform(F.slice("_p", 2, F.greatest(F.size("_p") - 1, F.lit(0))), lambda q, i: size(F.get("_p", i), q))
    p = p.withColumn("_s", steps)
    # Distances at which the points of the line stand, from 0.
    reached = F.aggregate("_s", F.array(F.lit(0.0)), lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + s)))
    p = p.withColumn("_at", reached).withColumn("_total", F.element_at("_at", -1))
    if dist is not None:
        n = F.greatest(F.ceil(F.col("_total") / dist), F.lit(1))
        at = F.col("_n") * F.lit(float(dist))
    else:
        n = F.lit(nsamples)
        at = F.col("_total") * F.col("_n") / F.lit(float(max(nsamples - 1, 1)))
    p = p.withColumn("_n", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))).withColumn("distance", at.cast("double"))
    # The stretch that ends at or beyond the stop, by binary search over the distances.
    strides = F.lit([1 << k for k in range(30, -1, -1)])
    found = F.aggregate(strides, F.lit(0), lambda i, k: F.when(F.coalesce(F.get("_at", i + k) < F.col("distance"), F.lit(False)), i + k).otherwise(i))
    p = p.withColumn("_e", F.least(found, F.greatest(F.size("_s") - 1, F.lit(0))))
    a, b = F.get("_p", F.col("_e")), F.coalesce(F.get("_p", F.col("_e") + 1), F.get("_p", F.col("_e")))
    t = F.coalesce(F.least(F.lit(1.0), F.try_divide(F.col("distance") - F.get("_at", F.col("_e")), F.get("_s", F.col("_e")))), F.lit(0.0))
    return p.select(col(key), "distance", (a["x"] + t * (b["x"] - a["x"])).alias("_x"), (a["y"] + t * (b["y"] - a["y"])).alias("_y"))


def cell_centres(df: DataFrame, cellsize: float, dz: float) -> DataFrame:
    return df.withColumns({"x": F.col("x") + cellsize / 2, "y": F.col("y") + cellsize / 2, "z": F.col("z") + dz / 2})


def label_runs(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Add run, from 0, numbering runs of equal values along order in each key; each null is a run."""
    return df.withColumn("run", run_label(col(value), Window.partitionBy(col(key)).orderBy(col(order))) - 1)


def sample_raster(df: DataFrame, raster: DataFrame, name: str = "value") -> DataFrame:
    """Add the value of the nearest cell of a raster (x, y, value); null outside it."""
    if not {"x", "y", "value"} <= set(raster.columns):
        raise TypeError("a raster has the columns x, y and value")
    axes, _ = axes_of(raster, ("x", "y"))
    roles = Roles.of(df)
    x, y = col(roles.x).cast("double"), col(roles.y).cast("double")
    inside = (x >= axes["x"].low) & (x <= axes["x"].high) & (y >= axes["y"].low) & (y <= axes["y"].high)
    keyed = raster.select(axes["x"].index(F.col("x")).alias("_i"), axes["y"].index(F.col("y")).alias("_j"), F.col("value").alias(name))
    return df.withColumns({"_ri": F.when(inside, axes["x"].index(x)), "_rj": F.when(inside, axes["y"].index(y))}).join(keyed, (F.col("_ri") == F.col("_i")) & (F.col("_rj") == F.col("_j")), "left").drop("_ri", "_rj", "_i", "_j")

