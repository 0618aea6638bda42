"""Points met with a table of geometries of any size: a cover of grid cells, an equi-join on the cell, edges by strip.

Equal geometries (WKB) are brought together and laid out once, with their labels as lists of at most LABELS. Each is
read in a task and laid out as two kinds of rows. *Cells* of a square grid, whose side is a
power of two of the geometry's own size (4 to 17 cells across), cover it: cells that no edge touches lie wholly inside,
others are on the border. *Strips* hold the edges by height, a few in each. A point meets the cells of its place by
equality, on as many levels as there are sizes of geometries; inside cells settle it, and points in border cells alone
go on to the edges of their height, by equality again. The plan holds no geometry, and no row holds more of one than
its cell or strip.

Where rows share places (PER_PLACE rows a place at least), the places are met in their stead and rows get the lists of
their place. Otherwise rows are met as they come. Either way nothing as large as the result is stored: lists are unfolded
last, and rows without any geometry are those whose place, of the distinct ones, met none.

Keys with more than CELL_POINTS rows are dealt out in parts, with the other side's rows repeated; a side of at most
SMALL_COVER rows is broadcast instead.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.crs import transformed
from ..functions.geometry import Geometry, from_wkb
from ..roles import Roles, col
from ..storage import settled

ACROSS, STRIP_EDGES = 8, 4
CELL_POINTS, SMALL_COVER = 1_000_000, 100_000
LABELS, PER_PLACE = 64, 4
#: Labels that a broadcast side may have for each of its SMALL_COVER rows, and rows of one batch that a task hands on.
LABELS_EACH, OUT_ROWS = 32, 4096
EDGES = "array<struct<px:double,py:double,qx:double,qy:double,part:int>>"
CELL = ["level", "i", "j"]
COVER = f"pid long, level int, i long, j long, inside boolean, strips long, low double, height double, strip long, edges {EDGES}"
PREDICATES = ("intersects", "within", "dwithin")


def edges_by_part(shape: Geometry) -> tuple[np.ndarray, bool]:
    """(px, py, qx, qy, part) of all edges, points and paths as well, and whether they bound areas."""
    rows: list[tuple] = []
    for part, polygon in enumerate(shape.polygons):
        rows += [(*p[:2], *q[:2], part) for ring in polygon.rings for p, q in zip(ring, ring[1:])]
    area = bool(rows)
    for path in shape.paths:
        rows += [(*p[:2], *q[:2], 0) for p, q in zip(path, path[1:])] or [(*p[:2], *p[:2], 0) for p in path]
    rows += [(*p[:2], *p[:2], 0) for p in shape.points]
    return np.array(rows, dtype=np.float64).reshape(-1, 5), area


def cells_of(edges: np.ndarray, area: bool, reach: float = 0) -> tuple[int, list[tuple[int, int, bool]]]:
    """(level, [(i, j, inside)]): the cells that hold or come within reach of a geometry."""
    xs, ys = edges[:, [0, 2]], edges[:, [1, 3]]
    low, high = np.array([xs.min(), ys.min()]) - reach, np.array([xs.max(), ys.max()]) + reach
    side = max(float((high - low).max()), 1e-9 * max(1.0, float(np.abs(edges[:, :4]).max())))
    level = math.ceil(math.log2(side / ACROSS) / 2) * 2
    size = math.ldexp(1.0, level)
    margin = reach * (1 + 1e-9) + 1e-9 * size
    first = [math.floor((v - margin) / size) for v in low]
    last = [math.floor((v + margin) / size) for v in high]
    border: set[tuple[int, int]] = set()
    for px, py, qx, qy, _ in edges:
        for j in range(math.floor((min(py, qy) - margin) / size), math.floor((max(py, qy) + margin) / size) + 1):
            # The stretch of the edge that stands in this row of cells, with the margin.
            bottom, top = j * size - margin, (j + 1) * size + margin
            t = sorted(((bottom - py) / (qy - py), (top - py) / (qy - py))) if py != qy else [0.0, 1.0]
            a, b = px + max(0.0, t[0]) * (qx - px), px + min(1.0, t[1]) * (qx - px)
            border.update((i, j) for i in range(math.floor((min(a, b) - margin) / size), math.floor((max(a, b) + margin) / size) + 1))
    out = [(i, j, False) for i, j in border]
    if area:
        px, py, qx, qy, part = edges.T
        for j in range(first[1], last[1] + 1):
            y = (j + 0.5) * size
            at = (py > y) != (qy > y)
            cross = px[at] + (y - py[at]) / (qy[at] - py[at]) * (qx[at] - px[at])
            for i in range(first[0], last[0] + 1):
                if (i, j) not in border:
                    after = part[at][cross > (i + 0.5) * size]
                    if after.size and (np.unique(after, return_counts=True)[1] % 2).any():
                        out.append((i, j, True))
    return level, out


def strips_of(edges: np.ndarray, reach: float = 0) -> tuple[float, float, int, dict[int, list]]:
    """(low, height, number, edges by strip): each edge in the strips that come within reach of it."""
    lows, highs = edges[:, [1, 3]].min(1) - reach, edges[:, [1, 3]].max(1) + reach
    low, high = float(lows.min()), float(highs.max())
    alive = max(1e-9, float((highs - lows).sum()) / ((high - low) or 1.0))
    n = max(1, min(len(edges) // STRIP_EDGES, int(3 * len(edges) / alive)))
    height = (high - low) / n or 1.0
    strips: dict[int, list] = {}
    for e, a, b in zip(edges, lows, highs):
        for k in range(math.floor((a - low) / height), math.floor((b - low) / height) + 1):
            strips.setdefault(k, []).append(dict(zip(("px", "py", "qx", "qy"), map(float, e[:4]))) | {"part": int(e[4])})
    return low, height, n, strips


def cover(geometries: DataFrame, label: str | None, geometry: str = "geometry", reach: float = 0) -> DataFrame:
    """The cells and strips of a table of geometries, computed once, with a number (pid) each.

    Equal geometries of a batch have one number, or one for every LABELS of their labels, which the cells hold (_labels).
    Without a label column there are no lists.
    """
    kind = geometries.schema[label].dataType.simpleString() if label else "boolean"
    fields = pa.schema([("pid", pa.int64()), ("level", pa.int32()), ("i", pa.int64()), ("j", pa.int64()), ("inside", pa.bool_()), ("strips", pa.int64()), ("low", pa.float64()), ("height", pa.float64()), ("strip", pa.int64()), ("edges", pa.list_(pa.struct([(c, pa.float64()) for c in ("px", "py", "qx", "qy")] + [("part", pa.int32())])))])

    def lay(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in it:
            own, alike = batch.column(0), {}
            for at, data in enumerate(batch.column(1)):
                if data.is_valid:
                    alike.setdefault(data.as_py(), []).append(at)
            for wkb, members in alike.items():
                edges, area = edges_by_part(from_wkb(wkb))
                edges = edges[np.isfinite(edges).all(1)]
                if not len(edges):
                    continue
                level, cells = cells_of(edges, area, reach)
                low, height, n, strips = strips_of(edges, reach)
                for first in range(0, len(members) if label else 1, LABELS):
                    number += 1
                    some = own.take(pa.array(members[first : first + LABELS] if label else [], pa.int64()))
                    rows = [(number, level, i, j, inside, n, low, height, None, None) for i, j, inside in cells]
                    for at in range(0, len(rows), OUT_ROWS):
                        part = rows[at : at + OUT_ROWS]
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * len(some)), some.take(pa.array(np.tile(np.arange(len(some)), len(part)))))
                        yield pa.RecordBatch.from_arrays([lists, *[pa.array(c, f.type) for c, f in zip(zip(*part), fields)]], names=["_labels", *fields.names])
                    rows = [(number, None, None, None, area, n, low, height, k, v) for k, v in strips.items()]
                    for at in range(0, len(rows), OUT_ROWS):
                        part = rows[at : at + OUT_ROWS]
                        yield pa.RecordBatch.from_arrays([pa.nulls(len(part), pa.list_(own.type)), *[pa.array(c, f.type) for c, f in zip(zip(*part), fields)]], names=["_labels", *fields.names])

    n = max(geometries.sparkSession.sparkContext.defaultParallelism, int(geometries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shapes = geometries.select((col(label) if label else F.lit(None).cast(kind)).alias("_label"), col(geometry).alias("_shape")).where(F.col("_shape").isNotNull())
    # Equal ones stand side by side in one task.
    shapes = shapes.withColumn("_alike", F.xxhash64("_shape")).repartition(n, "_alike").sortWithinPartitions("_alike").select("_label", "_shape")
    return settled(shapes.mapInArrow(lay, f"_labels array<{kind}>, {COVER}"))


def meets_edges(x: Column, y: Column, edges: Column, area: Column, predicate: str, distance: float) -> Column:
    """Whether a point meets a geometry, from the edges of its height: in it by the even-odd rule, or on or near an edge."""
    cross = lambda e: (x - e["px"]) * (e["qy"] - e["py"]) - (y - e["py"]) * (e["qx"] - e["px"]) == 0
    span = lambda v, a, b: (v >= F.least(a, b)) & (v <= F.greatest(a, b))
    on = F.exists(edges, lambda e: cross(e) & span(x, e["px"], e["qx"]) & span(y, e["py"], e["qy"]))
    over = F.filter(edges, lambda e: (e["py"] != e["qy"]) & ((y < e["py"]) != (y < e["qy"])) & (x < (e["qx"] - e["px"]) * (y - e["py"]) / (e["qy"] - e["py"]) + e["px"]))
    parts = F.transform(over, lambda e: e["part"])
    odd = F.exists(F.array_distinct(parts), lambda k: F.size(F.filter(parts, lambda p: p == k)) % 2 == 1)
    inside = area & odd
    if predicate == "within":
        return inside & ~on
    if predicate == "dwithin":

        def near(e: Column) -> Column:
            dx, dy = e["qx"] - e["px"], e["qy"] - e["py"]
            t = F.coalesce(F.try_divide((x - e["px"]) * dx + (y - e["py"]) * dy, dx * dx + dy * dy), F.lit(0.0))
            t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
            ex, ey = x - (e["px"] + t * dx), y - (e["py"] + t * dy)
            return ex * ex + ey * ey <= distance * distance

        return inside | on | F.exists(edges, near)
    return inside | on


class Laid:
    """A cover and its sizes."""

    def __init__(self, table: DataFrame, predicate: str, distance: float):
        self.predicate, self.distance = predicate, distance
        self.cells = table.where("level is not null").select("_labels", "pid", *CELL, "inside", "low", "height")
        self.strips = table.where("strip is not null").select("pid", "strip", F.col("inside").alias("_area"), "edges")
        cells = F.col("level").isNotNull()
        found = table.agg(F.collect_set("level").alias("levels"), F.count("level").alias("cells"), F.coalesce(F.sum(F.when(cells, F.size("_labels"))), F.lit(0)).alias("labels"), F.count("strip").alias("strips")).first()
        self.levels = sorted(found.levels)  # a few tens at most: powers of four
        self.few_cells = found.cells <= SMALL_COVER and found.labels <= SMALL_COVER * LABELS_EACH
        self.few_strips = found.strips <= SMALL_COVER

    def placed(self, rows: DataFrame) -> DataFrame:
        """rows once for each level, with the cell that they lie in."""
        places = [F.struct(F.lit(k).alias("level"), F.floor(F.col("_x") / F.lit(math.ldexp(1.0, k))).cast("long").alias("i"), F.floor(F.col("_y") / F.lit(math.ldexp(1.0, k))).cast("long").alias("j")) for k in self.levels]
        none = F.array().cast("array<struct<level:int,i:long,j:long>>")
        return rows.withColumn("_c", F.explode(F.array(*places) if places else none)).select("*", *[F.col("_c")[c].alias(c) for c in CELL]).drop("_c")

    def on_border(self, met: DataFrame) -> DataFrame:
        """Those rows beside a border cell that meet its geometry, by the edges of their height."""
        met = met.withColumn("strip", F.floor((F.col("_y") - F.col("low")) / F.col("height")).cast("long"))
        return dealt(met, self.strips, ["pid", "strip"], self.few_strips).where(meets_edges(F.col("_x"), F.col("_y"), F.col("edges"), F.col("_area"), self.predicate, self.distance))

    def meet(self, rows: DataFrame, few: bool = False) -> DataFrame:
        """rows with the labels (_labels) of each geometry that they meet; few: rows are no more than SMALL_COVER."""
        placed, result = self.placed(rows), [*rows.columns, "_labels"]
        met = placed.hint("broadcast").join(self.cells, CELL) if few and not self.few_cells else dealt(placed, self.cells, CELL, self.few_cells)
        return met.where("inside").select(*result).unionByName(self.on_border(met.where("not inside")).select(*result))

    def meet_any(self, places: DataFrame) -> DataFrame:
        """The places (_x, _y) that meet at least one geometry, computed once; edges are asked where no cell settles it."""
        cells = self.cells.drop("_labels")
        full = cells.where("inside").select(*CELL).distinct()
        sure = settled(dealt(self.placed(places), full, CELL, self.few_cells).select("_x", "_y").distinct())
        rest = places.join(sure, ["_x", "_y"], "left_anti")
        border = self.on_border(dealt(self.placed(rest), cells.where("not inside"), CELL, self.few_cells))
        return settled(sure.unionByName(border.select("_x", "_y").distinct()))


def dealt(rows: DataFrame, other: DataFrame, on: list[str], few: bool) -> DataFrame:
    """rows joined with the other side on keys; few: that side is small and broadcast."""
    if few:
        return rows.join(F.broadcast(other), on)
    full = settled(rows.groupBy(*on).count().where(F.col("count") > CELL_POINTS).select(*on, F.ceil(F.col("count") / CELL_POINTS).cast("int").alias("_parts")))
    other = other.join(full, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    mixed = F.xxhash64(*[c for c, t in rows.dtypes if "map<" not in t])
    rows = rows.join(full, on, "left").withColumn("_part", F.pmod(mixed, F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    return rows.join(other, [*on, "_part"]).drop("_part")


def places_of(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """The distinct places (_x, _y) of rows, computed once, their number and that of the rows there."""
    there = F.col("_x").isNotNull() & F.col("_y").isNotNull() & ~F.isnan("_x") & ~F.isnan("_y")
    places = settled(rows.where(there).groupBy("_x", "_y").count())
    n = places.agg(F.count("*").alias("places"), F.coalesce(F.sum("count"), F.lit(0)).alias("rows")).first()
    return places.select("_x", "_y"), n.places, n.rows


def join_table(
    df: DataFrame,
    geometries: DataFrame,
    label_id: str,
    how: str = "inner",
    drop_label_if_exists: bool = False,
    predicate: str = "intersects",
    distance: float = 0,
    crs: int | None = None,
    geometry_crs: int | None = None,
    geometry: str = "geometry",
) -> DataFrame:
    """Rows of df with the label (column ``label_id`` of geometries) of each geometry that a row's point meets.

    As :func:`spatial.spatial_join`, for a table of any number of geometries as WKB. A row that meets several comes
    once for each; with ``left`` one that meets none comes once, without a label. Geometries that are null, empty or
    not finite meet nothing, rows without a place neither; two geometries of one label both count.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how can't be {how!r}")
    if predicate not in PREDICATES:
        raise ValueError(f"a table of geometries is met by {', '.join(PREDICATES)}, not {predicate!r}")
    roles = Roles.of(df)
    roles.need("x", "y")
    x, y, shown = col(roles.x), col(roles.y), [(c, c) for c in df.columns]
    name = label_id
    if label_id in df.columns:
        if drop_label_if_exists:
            shown = [(c, c) for c in df.columns if c != label_id]
        else:
            shown, name = [(c, f"{c}_left" if c == label_id else c) for c in df.columns], f"{label_id}_right"
    if crs and geometry_crs and crs != geometry_crs:
        df, x, y = transformed(df, x, y, crs, geometry_crs)
    kept = [f"_c{k}" for k in range(len(shown))]
    # Computed once, as the places and the result are read from it.
    rows = settled(df.select(*[col(c).alias(k) for k, (c, _) in zip(kept, shown)], x.cast("double").alias("_x"), y.cast("double").alias("_y")))
    places, n, n_rows = places_of(rows)
    laid = Laid(cover(geometries, label_id, geometry, distance if predicate == "dwithin" else 0), predicate, distance)
    shared = n * PER_PLACE <= n_rows
    if shared:
        lists = settled(laid.meet(places, few=n <= SMALL_COVER))
        size = lists.agg(F.count("*").alias("lists"), F.coalesce(F.sum(F.size("_labels")), F.lit(0)).alias("labels")).first()
        met = dealt(rows, lists, ["_x", "_y"], size.lists <= SMALL_COVER and size.labels <= SMALL_COVER * LABELS_EACH)
    else:
        met = laid.meet(rows)
    found = met.select(*kept, F.explode("_labels").alias("_label"))
    if how == "left":
        some = lists.select("_x", "_y").distinct() if shared else laid.meet_any(places)
        rest = rows.join(F.broadcast(some) if n <= SMALL_COVER else some, ["_x", "_y"], "left_anti")
        found = found.unionByName(rest.select(*kept, F.lit(None).cast(found.schema["_label"].dataType).alias("_label")))
    return found.select(*[F.col(k).alias(c) for k, (_, c) in zip(kept, shown)], F.col("_label").alias(name))


def select_within_table(df: DataFrame, geometries: DataFrame, buffer: float = 0, invert: bool = False, geometry: str = "geometry") -> DataFrame:
    """Rows in at least one area of a table (its border outside), or with buffer no further from one; inverted the others.

    Unlike :func:`spatial.within_union`, areas count one by one: an edge that two of them share is outside of both.
    """
    roles = Roles.of(df)
    roles.need("x", "y")
    kept = [f"_c{k}" for k in range(len(df.columns))]
    rows = settled(df.select(*[col(c).alias(k) for k, c in zip(kept, df.columns)], col(roles.x).cast("double").alias("_x"), col(roles.y).cast("double").alias("_y")))
    laid = Laid(cover(geometries, None, geometry, buffer if buffer > 0 else 0), "dwithin" if buffer > 0 else "within", buffer)
    places, n, _ = places_of(rows)
    met = laid.meet_any(places)
    return rows.join(F.broadcast(met) if n <= SMALL_COVER else met, ["_x", "_y"], "left_anti" if invert else "left_semi").select(*[F.col(k).alias(c) for k, c in zip(kept, df.columns)])
