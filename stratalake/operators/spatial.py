"""Spatial selections and joins as column expressions: boxes, points, lines and polygons. Geometries are small query sets."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.crs import transformed
from ..functions.geometry import Geometry, as_geometries
from ..predicates import negate
from ..roles import Roles, col

Point = tuple[float, float]


def within_bbox(x: Column, y: Column, xmin: float, ymin: float, xmax: float, ymax: float) -> Column:
    """Inside or on the box: four plain comparisons, which reach the scan."""
    return (x >= xmin) & (x <= xmax) & (y >= ymin) & (y <= ymax)


def segment_distance2(x: Column, y: Column, p: Point, q: Point) -> Column:
    """Squared distance to the segment p-q."""
    dx, dy = q[0] - p[0], q[1] - p[1]
    size = dx * dx + dy * dy
    if not size:
        return (x - p[0]) * (x - p[0]) + (y - p[1]) * (y - p[1])
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - p[0]) * dx + (y - p[1]) * dy) / size))
    ex, ey = x - (p[0] + t * dx), y - (p[1] + t * dy)
    return ex * ex + ey * ey


def _any(conditions: list[Column]) -> Column:
    return reduce(or_, conditions) if conditions else F.lit(False)


#: From this many edges on, a geometry is a constant of edges by strips of y in place of a term an edge.
MANY_EDGES = 60
Edge = tuple[float, float, float, float]
Test = Callable[[Column, Column, Column, Column], Column]


def _distance2(x: Column, y: Column, px: Column, py: Column, qx: Column, qy: Column) -> Column:
    """segment_distance2 for edges that are columns."""
    dx, dy = qx - px, qy - py
    t = F.coalesce(F.try_divide((x - px) * dx + (y - py) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    ex, ey = x - (px + t * dx), y - (py + t * dy)
    return ex * ex + ey * ey


def _over_strip(y: Column, edges: Sequence[Edge], count: Callable[[Column], Column], reach: float = 0, groups: Sequence[int] = ()) -> Column:
    """count() of the edges that come within reach of a point's height; false where there are none.

    Each edge stands in the strips that it crosses. There are so many strips that the edges stand in four each at most,
    as a mean, so that the constant grows with the geometry and a point looks at few edges.
    """
    lows, highs = [min(e[1], e[3]) - reach for e in edges], [max(e[1], e[3]) + reach for e in edges]
    low, high = min(lows), max(highs)
    alive = max(1e-9, sum(b - a for a, b in zip(lows, highs)) / ((high - low) or 1.0))
    n = max(1, min(len(edges) // 4, int(3 * len(edges) / alive)))
    height = (high - low) / n or 1.0
    strips: list[list[dict]] = [[] for _ in range(n + 1)]
    for at, ((px, py, qx, qy), a, b) in enumerate(zip(edges, lows, highs)):
        for k in range(math.floor((a - low) / height), math.floor((b - low) / height) + 1):
            strips[k].append({"px": px, "py": py, "qx": qx, "qy": qy} | ({"g": groups[at]} if groups else {}))
    table = F.from_json(F.lit(json.dumps(strips)), f"array<array<struct<px:double,py:double,qx:double,qy:double{',g:int' if groups else ''}>>>")
    return F.coalesce(count(F.get(table, F.floor((y - low) / height).cast("int"))), F.lit(False))


def _any_edge(y: Column, edges: Sequence[Edge], test: Test, reach: float = 0) -> Column:
    return _over_strip(y, edges, lambda strip: F.exists(strip, lambda e: test(e["px"], e["py"], e["qx"], e["qy"])), reach)


def edges_of(paths: Iterable[Sequence[Point]]) -> list[Edge]:
    return [(float(p[0]), float(p[1]), float(q[0]), float(q[1])) for path in paths for p, q in zip(path, path[1:])]


def near_edges(x: Column, y: Column, edges: Sequence[Edge], distance: float, closed: bool = False) -> Column:
    """Closer to any of the edges than distance, or with closed no further."""
    near = lambda d: d <= distance * distance if closed else d < distance * distance
    if len(edges) < MANY_EDGES:
        return _any([near(segment_distance2(x, y, e[:2], e[2:])) for e in edges])
    return _any_edge(y, edges, lambda *e: near(_distance2(x, y, *e)), abs(distance) * (1 + 1e-9))


def near_line(x: Column, y: Column, points: Sequence[Point], distance: float) -> Column:
    """Closer to the line than distance, with a box before the exact test."""
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    box = within_bbox(x, y, min(xs) - distance, min(ys) - distance, max(xs) + distance, max(ys) + distance)
    return box & near_edges(x, y, edges_of([points]), distance)


def on_ring(x: Column, y: Column, ring: Sequence[Point]) -> Column:
    """On an edge of the ring."""
    if len(ring) > MANY_EDGES:
        inside = lambda v, a, b: (v >= F.least(a, b)) & (v <= F.greatest(a, b))
        return _any_edge(y, edges_of([ring]), lambda px, py, qx, qy: ((x - px) * (qy - py) - (y - py) * (qx - px) == 0) & inside(x, px, qx) & inside(y, py, qy))
    out = []
    for (px, py), (qx, qy) in zip(ring, ring[1:]):
        cross = (x - px) * (qy - py) - (y - py) * (qx - px)
        out.append((cross == 0) & within_bbox(x, y, min(px, qx), min(py, qy), max(px, qx), max(py, qy)))
    return _any(out)


def inside_rings(x: Column, y: Column, rings: Sequence[Sequence[Point]]) -> Column:
    """Inside by the even-odd rule over all rings; points on edges can be either."""
    edges = [e for e in edges_of(rings) if e[1] != e[3]]
    if len(edges) >= MANY_EDGES:
        crosses = lambda e: ((y < e["py"]) != (y < e["qy"])) & (x < (e["qx"] - e["px"]) * (y - e["py"]) / (e["qy"] - e["py"]) + e["px"])
        return _over_strip(y, edges, lambda strip: F.aggregate(strip, F.lit(0), lambda n, e: n + crosses(e).cast("int")) % 2 == 1)
    crossings = F.lit(0)
    for ring in rings:
        for (px, py), (qx, qy) in zip(ring, ring[1:]):
            if py != qy:
                meets = ((y < py) != (y < qy)) & (x < (qx - px) * (y - py) / (qy - py) + px)
                crossings = crossings + meets.cast("int")
    return crossings % 2 == 1


def intersects_polygon(x: Column, y: Column, rings: Sequence[Sequence[Point]]) -> Column:
    """Inside the polygon or on its boundary."""
    xs, ys = [p[0] for p in rings[0]], [p[1] for p in rings[0]]
    return within_bbox(x, y, min(xs), min(ys), max(xs), max(ys)) & (_any([on_ring(x, y, r) for r in rings]) | inside_rings(x, y, rings))


#: Angles this close are one: rays to several vertices of one line differ by rounding.
SAME_ANGLE = 1e-12


def within_union(x: Column, y: Column, polygons: Sequence[Geometry], buffer: float = 0) -> Column:
    """Within the union of polygons: its boundary is outside, edges between two polygons are inside.

    A point on edges is inside if the polygons there close the circle around it: see :func:`closed_around`.
    """
    rings = [p.rings for p in polygons]
    inside = [inside_rings(x, y, r) & ~_any([on_ring(x, y, s) for s in r]) for r in rings]
    if buffer > 0:
        return _any([intersects_polygon(x, y, r) for r in rings] + [near_edges(x, y, edges_of(s for r in rings for s in r), buffer)])
    if len(rings) == 1:
        return inside[0]
    return _any(inside) | closed_around(x, y, rings) if rings else F.lit(False)


def turned(ring: Sequence[Point], hole: bool) -> Sequence[Point]:
    """The ring with the polygon's inside at the left of each edge."""
    ax, ay = ring[0][:2]
    twice = sum((p[0] - ax) * (q[1] - ay) - (q[0] - ax) * (p[1] - ay) for p, q in zip(ring, ring[1:]))
    return ring[::-1] if (twice < 0) != hole else ring


def closed_around(x: Column, y: Column, polygons: Sequence[Sequence[Sequence[Point]]]) -> Column:
    """Whether the polygons that have a point on their edges cover all directions from it between them.

    Each polygon covers sectors: from an edge that leaves the point, counter-clockwise, to the next of its own that
    comes in. The sectors of all, sorted by angle and merged, have no gap if they reach once around from the first.
    """
    paths = [(g, turned(ring, k > 0)) for g, rings in enumerate(polygons) for k, ring in enumerate(rings)]
    edges = [(g, *p[:2], *q[:2]) for g, path in paths for p, q in zip(path, path[1:]) if p[:2] != q[:2]]

    def covered(strip: Column) -> Column:
        span = lambda v, a, b: (v >= F.least(a, b)) & (v <= F.greatest(a, b))
        on = F.filter(strip, lambda e: ((x - e["px"]) * (e["qy"] - e["py"]) - (y - e["py"]) * (e["qx"] - e["px"]) == 0) & span(x, e["px"], e["qx"]) & span(y, e["py"], e["qy"]))
        ray = lambda e, a: F.struct(e["g"].alias("g"), F.atan2(e[f"{a}y"] - y, e[f"{a}x"] - x).alias("a"))
        end = lambda e, a: (e[f"{a}x"] == x) & (e[f"{a}y"] == y)
        leave = F.transform(F.filter(on, lambda e: ~end(e, "q")), lambda e: ray(e, "q"))
        come = F.transform(F.filter(on, lambda e: ~end(e, "p")), lambda e: ray(e, "p"))
        turn = F.lit(2 * math.pi)
        width = lambda a, b: F.when(b > a, b - a).otherwise(b - a + turn)

        def sectors(rays: Column) -> Column:
            made = F.transform(rays["leave"], lambda o: F.struct(o["a"].alias("a"), F.array_min(F.transform(F.filter(rays["come"], lambda i: i["g"] == o["g"]), lambda i: width(o["a"], i["a"]))).alias("w")))
            return F.array_sort(F.filter(made, lambda s: s["w"].isNotNull()))

        def closes(found: Column) -> Column:
            first = F.get(found, F.lit(0))["a"]
            twice = F.concat(found, F.transform(found, lambda s: F.struct((s["a"] + turn).alias("a"), s["w"].alias("w"))))
            reached = F.aggregate(twice, first, lambda to, s: F.when(s["a"] <= to + SAME_ANGLE, F.greatest(to, s["a"] + s["w"])).otherwise(to))
            return (F.size(found) > 0) & (reached >= first + turn - SAME_ANGLE)

        # Bound by lambdas, so that each list is made once.
        rays = F.array(F.struct(leave.alias("leave"), come.alias("come")))
        return F.get(F.transform(F.transform(rays, sectors), closes), F.lit(0))

    return _over_strip(y, [e[1:] for e in edges], covered, groups=[e[0] for e in edges])


def _xy(df: DataFrame) -> tuple[Column, Column]:
    roles = Roles.of(df)
    roles.need("x", "y")
    return col(roles.x), col(roles.y)


def _chosen(df: DataFrame, condition: Column, invert: bool) -> DataFrame:
    return df.where(negate(condition) if invert else condition)


def select_within_bbox(df: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float, invert: bool = False) -> DataFrame:
    return _chosen(df, within_bbox(*_xy(df), xmin, ymin, xmax, ymax), invert)


def select_with_points(df: DataFrame, points: DataFrame | Sequence[Point], max_distance: float, invert: bool = False) -> DataFrame:
    """Rows closer than max_distance to any of the points.

    A list of points becomes a condition. A table of points (x, y) of any size is met by grid cell: cells are as wide
    as the distance, each point is laid in the nine around it, and an equi-join on the cell finds the near ones.
    """
    x, y = _xy(df)
    if not isinstance(points, DataFrame):
        places = [(float(px), float(py)) for g in as_geometries(points) for px, py in g.points]
        if len(places) >= MANY_EDGES:  # a constant by strips, a point being an edge without length
            return _chosen(df, near_edges(x, y, [(*p, *p) for p in places], max_distance), invert)
        return _chosen(df, _any([(x - px) * (x - px) + (y - py) * (y - py) < max_distance**2 for px, py in places]), invert)
    roles = Roles.of(points)
    shift = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    cells = points.select(col(roles.x).alias("_px"), col(roles.y).alias("_py"), F.explode(shift).alias("s")).select("_px", "_py", (F.floor(F.col("_px") / max_distance) + F.col("s.a")).alias("_i"), (F.floor(F.col("_py") / max_distance) + F.col("s.b")).alias("_j"))
    near = (F.floor(x / max_distance) == F.col("_i")) & (F.floor(y / max_distance) == F.col("_j")) & ((x - F.col("_px")) * (x - F.col("_px")) + (y - F.col("_py")) * (y - F.col("_py")) < max_distance**2)
    return df.join(cells, near, "left_anti" if invert else "left_semi")


def select_with_lines(df: DataFrame, lines, max_distance: float, invert: bool = False) -> DataFrame:
    x, y = _xy(df)
    return _chosen(df, _any([near_line(x, y, path, max_distance) for g in as_geometries(lines) for path in g.paths]), invert)


def select_within_polygons(df: DataFrame, polygons, buffer: float = 0, invert: bool = False) -> DataFrame:
    return _chosen(df, within_union(*_xy(df), [p for g in as_geometries(polygons) for p in g.polygons], buffer), invert)


#: How a point can meet a geometry: in or on it, in it, near it, or apart from it.
PREDICATES = ("intersects", "within", "dwithin", "disjoint")


def meets(x: Column, y: Column, shape: Geometry, predicate: str = "intersects", distance: float = 0) -> Column:
    """Whether a point meets a geometry of any kind; ``dwithin``: no further than distance."""
    if predicate not in PREDICATES:
        raise ValueError(f"no predicate {predicate!r}; there are {', '.join(PREDICATES)}")
    if predicate == "disjoint":
        return ~meets(x, y, shape)
    at = [intersects_polygon(x, y, p.rings) for p in shape.polygons] if predicate != "within" else [inside_rings(x, y, p.rings) & ~_any([on_ring(x, y, r) for r in p.rings]) for p in shape.polygons]
    if not shape.polygons:
        points = [(x == a) & (y == b) for a, b in shape.points] if not shape.paths else []
        at = points + [on_ring(x, y, path) for path in shape.paths]
    if predicate == "dwithin":
        paths = [*shape.paths, *[r for p in shape.polygons for r in p.rings]] or [[p, p] for p in shape.points]
        at = [*at, near_edges(x, y, edges_of(paths), distance, closed=True)]
    return _any(at)


def spatial_join(
    df: DataFrame,
    geometries: Sequence[tuple] | DataFrame,
    label_id: str,
    how: str = "inner",
    drop_label_if_exists: bool = False,
    predicate: str = "intersects",
    distance: float = 0,
    crs: int | None = None,
    geometry_crs: int | None = None,
) -> DataFrame:
    """Add a label for each of the labelled geometries [(label, geometry), ...] that a row's point meets.

    Labels are gathered by one expression and unfolded, so no join or shuffle is needed. Where the geometries are in
    another reference system than the rows, the rows' coordinates are brought into it for the test.

    A table (label_id, geometry as WKB) in place of the list is met by a cover of cells: see :func:`areas.join_table`.
    """
    if isinstance(geometries, DataFrame):
        from .areas import join_table

        return join_table(df, geometries, label_id, how, drop_label_if_exists, predicate, distance, crs, geometry_crs)
    if how not in ("inner", "left"):
        raise ValueError(f"how can't be {how!r}")
    columns = df.columns
    x, y = _xy(df)
    if crs and geometry_crs and crs != geometry_crs:
        df, x, y = transformed(df, x, y, crs, geometry_crs)
    name = label_id
    if label_id in df.columns:
        if drop_label_if_exists:
            df = df.drop(label_id)
        else:
            df, name = df.withColumnRenamed(label_id, f"{label_id}_left"), f"{label_id}_right"
    found = [F.when(_any([meets(x, y, g, predicate, distance) for g in as_geometries(shape)]), F.lit(label)) for label, shape in geometries]
    labels = F.filter(F.array(*found), lambda v: v.isNotNull())
    return df.withColumn("_labels", labels).select("*", (F.explode if how == "inner" else F.explode_outer)("_labels").alias(name)).drop("_labels", *[c for c in df.columns if c not in columns and c != f"{label_id}_left"])
