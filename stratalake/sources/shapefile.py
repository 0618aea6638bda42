"""Shapefiles: read by tasks in ranges of records, and written as parts by tasks, with headers fixed at the end.

The index file (.shx) says where a record lies, so each task reads its own stretch of the shapes (.shp) and of the table
(.dbf). Geometries come as WKB in two dimensions. Files lie where driver and executors see them.

Defined cases: a null shape is null; deleted rows of the table are left out with their shapes; rings that run clockwise
begin a polygon, others are holes of the one that holds them; empty fields are null. Written: names are cut to ten
characters and kept apart, rows without a geometry are null shapes, texts beyond 254 bytes are an error.
"""

from __future__ import annotations

import datetime
import shutil
import struct
import warnings
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import Geometry, from_wkb, point_wkb, to_wkb
from ..roles import Roles, col
from ..storage import open_file, settled

#: Codes of shapes without heights; those with heights are ten more, with measures twenty.
POINT, LINE, POLYGON, MULTIPOINT = 1, 3, 5, 8
RECORDS, BATCH = 100_000, 4096
MOST_BYTES = (1 << 31) - 1


def area2(ring: list[tuple[float, float]]) -> float:
    """Twice the area, positive where the ring runs counter-clockwise."""
    x, y = ring[0]
    return sum((a[0] - x) * (b[1] - y) - (b[0] - x) * (a[1] - y) for a, b in zip(ring, ring[1:]))


def holds(ring: list[tuple[float, float]], p: tuple[float, float]) -> bool:
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:]):
        if (p[1] < ay) != (p[1] < by) and p[0] < (bx - ax) * (p[1] - ay) / (by - ay) + ax:
            odd = not odd
    return odd


def shape_of(content: bytes) -> Geometry | None:
    """The geometry of a record's content."""
    kind = struct.unpack_from("<i", content)[0] % 10
    if kind == 0 or len(content) < 20:
        return None
    if kind == POINT:
        return Geometry("POINT", struct.unpack_from("<2d", content, 4))
    if kind == MULTIPOINT:
        n = struct.unpack_from("<i", content, 36)[0]
        return Geometry("MULTIPOINT", [tuple(p) for p in np.frombuffer(content, "<f8", 2 * n, 40).reshape(-1, 2).tolist()])
    parts, n = struct.unpack_from("<2i", content, 36)
    starts = [*struct.unpack_from(f"<{parts}i", content, 44), n]
    points = [tuple(p) for p in np.frombuffer(content, "<f8", 2 * n, 44 + 4 * parts).reshape(-1, 2).tolist()]
    paths = [points[a:b] for a, b in zip(starts, starts[1:])]
    if kind == LINE:
        return Geometry("LINESTRING", paths[0]) if parts == 1 else Geometry("MULTILINESTRING", paths)
    outer = [[r] for r in paths if area2(r) <= 0] or [[paths[0]]]
    for ring in paths:
        if area2(ring) > 0 and ring is not outer[0][0]:
            next((p for p in outer if holds(p[0], ring[0])), outer[0]).append(ring)
    return Geometry("POLYGON", outer[0]) if len(outer) == 1 else Geometry("MULTIPOLYGON", outer)


def content_of(shape: Geometry | None) -> bytes:
    """A record's content of a geometry."""
    if shape is None:
        return struct.pack("<i", 0)
    if shape.kind == "POINT":
        return struct.pack("<i2d", POINT, *shape.coords[:2])
    if shape.kind == "MULTIPOINT":
        xy = np.array([p[:2] for p in shape.points], "<f8")
        return struct.pack("<i", MULTIPOINT) + box_of(xy) + struct.pack("<i", len(xy)) + xy.tobytes()
    paths = shape.paths or [r if (area2(r) > 0) == (k > 0) else r[::-1] for p in shape.polygons for k, r in enumerate(p.rings)]
    xy = np.array([p[:2] for path in paths for p in path], "<f8")
    starts = np.cumsum([0, *[len(p) for p in paths[:-1]]]).astype("<i4")
    return struct.pack("<i", LINE if shape.paths else POLYGON) + box_of(xy) + struct.pack("<2i", len(paths), len(xy)) + starts.tobytes() + xy.tobytes()


def box_of(xy: np.ndarray) -> bytes:
    return struct.pack("<4d", *xy.min(0), *xy.max(0))


def table_fields(head: bytes) -> tuple[int, int, int, list[tuple[str, str, int, int]]]:
    """(records, begin, width, fields) of a .dbf file's header; a field is (name, type, width, decimals)."""
    n, begin, width = struct.unpack_from("<IHH", head, 4)
    fields, at = [], 32
    while at + 32 <= begin and head[at] != 0x0D:
        fields.append((head[at : at + 11].split(b"\0")[0].decode("latin-1"), chr(head[at + 11]), head[at + 16], head[at + 17]))
        at += 32
    return n, begin, width, fields


def field_type(kind: str, width: int, decimals: int) -> str:
    if kind in "NF":
        return "double" if decimals or kind == "F" or width > 20 else "long"
    return {"L": "boolean", "D": "date"}.get(kind, "string")


def value_of(raw: bytes, kind: str, encoding: str):
    text = raw.decode(encoding, "replace").strip(" \0")
    if not text or set(text) <= {"*"}:
        return None
    if kind == "double":
        return float(text)
    if kind == "long":
        return int(text)
    if kind == "boolean":
        return text in "YyTt" if text in "YyTtNnFf" else None
    if kind == "date":
        return datetime.date(int(text[:4]), int(text[4:6]), int(text[6:8])) if len(text) == 8 and text.isdigit() and text != "00000000" else None
    return text


def read_shapefile(spark: SparkSession, path: str, geometry: str = "geometry", encoding: str | None = None, records: int = RECORDS) -> DataFrame:
    """The rows of a shapefile (any of its files names it) with their geometry as WKB; tasks read ranges of records."""
    stem = path[:-4] if path[-4:].lower() in (".shp", ".shx", ".dbf") else path
    with open_file(stem + ".dbf") as f:
        head = f.read(32)
        f.seek(0)
        n, begin, width, fields = table_fields(f.read(struct.unpack_from("<H", head, 8)[0]))
    if encoding is None:
        try:
            with open_file(stem + ".cpg") as f:
                encoding = f.read(64).decode("ascii", "ignore").strip() or "utf-8"
        except FileNotFoundError:
            encoding = "utf-8"
    kinds = [field_type(*f[1:]) for f in fields]
    names = [f[0] for f in fields]
    arrow = {"double": pa.float64(), "long": pa.int64(), "boolean": pa.bool_(), "date": pa.date32(), "string": pa.string()}

    def read(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open_file(stem + ".shx") as index, open_file(stem + ".shp") as shapes, open_file(stem + ".dbf") as table:
            for start in (x for b in it for x in b.column(0).to_pylist()):
                for low in range(start, min(start + records, n), BATCH):
                    high = min(low + BATCH, start + records, n)
                    index.seek(100 + 8 * low)
                    places = np.frombuffer(index.read(8 * (high - low)), ">i4").reshape(-1, 2).astype(np.int64) * 2
                    table.seek(begin + width * low)
                    rows = table.read(width * (high - low))
                    out: list[list] = [[] for _ in range(len(fields) + 1)]
                    for i, (at, size) in enumerate(places.tolist()):
                        row = rows[i * width : (i + 1) * width]
                        if row[:1] == b"*":
                            continue
                        shapes.seek(at + 8)
                        shape, to = shape_of(shapes.read(size)), 1
                        for k, (_, _, wide, _) in enumerate(fields):
                            out[k].append(value_of(row[to : to + wide], kinds[k], encoding))
                            to += wide
                        out[-1].append(to_wkb(shape) if shape else None)
                    yield pa.RecordBatch.from_arrays([*[pa.array(c, arrow[k]) for c, k in zip(out, kinds)], pa.array(out[-1], pa.binary())], names=[*names, geometry])

    schema = ", ".join([*[f"`{a}` {k}" for a, k in zip(names, kinds)], f"`{geometry}` binary"])
    if not n:
        return spark.createDataFrame([], schema)
    return spark.range(0, n, records, max(1, min(1000, -(-n // records)))).mapInArrow(read, schema)


def short_names(names: list[str]) -> list[str]:
    """Names of ten characters at most, kept apart."""
    out: list[str] = []
    for name in names:
        short, i = name[:10], 1
        while short.lower() in (o.lower() for o in out):
            short, i = f"{name[: 9 - len(str(i))]}_{i}", i + 1
        out.append(short)
    return out


def write_shapefile(df: DataFrame, path: str, geometry: str | None = None, wkt: str | None = None) -> None:
    """Rows as a shapefile: with their geometry (WKB) or, without one, points of their x and y.

    Tasks write the records of their rows as parts beside the file; the driver puts the parts one behind the other and
    writes the headers. A format's file ends at 2 GB; more is an error.
    """
    stem = Path(path[:-4] if path.lower().endswith(".shp") else path)
    if geometry is None:
        roles = Roles.of(df)
        roles.need("x", "y")
        geometry, df = "_shape", df.withColumn("_shape", point_wkb(col(roles.x).cast("double"), col(roles.y).cast("double")))
    kinds = {c: t for c, t in df.dtypes if c != geometry}
    plain = {"string", "boolean", "date", "double", "float", "int", "bigint", "smallint", "tinyint"}
    rows = settled(df.select(*[col(c) if kinds[c] in plain else col(c).cast("string").alias(c) for c in kinds], col(geometry).alias(geometry)))
    kinds = {c: t for c, t in rows.dtypes if c != geometry}
    texts = [c for c, t in kinds.items() if t == "string"]
    part = F.spark_partition_id()
    longest = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"), *[F.max(F.octet_length(col(c))).alias(f"l{i}") for i, c in enumerate(texts)]).collect()
    wide = {c: max([1, *[r[f"l{i}"] or 1 for r in longest]]) for i, c in enumerate(texts)}
    if long := [c for c, n in wide.items() if n > 254]:
        raise ValueError(f"texts of more than 254 bytes in {', '.join(long)}: a shapefile has no room for them")
    names = short_names(list(kinds))
    if changed := [c for c, s in zip(kinds, names) if c != s]:
        warnings.warn(f"names are cut to ten characters: {', '.join(changed)}", UserWarning, stacklevel=2)
    form = {"string": lambda c: ("C", wide[c], 0), "boolean": lambda c: ("L", 1, 0), "date": lambda c: ("D", 8, 0), "double": lambda c: ("F", 24, 15), "float": lambda c: ("F", 24, 15)}
    fields = [(s, *form.get(kinds[c], lambda c: ("N", 18 if kinds[c] != "bigint" else 20, 0))(c)) for c, s in zip(kinds, names)]
    starts, total = {}, 0
    for r in sorted(longest):
        starts[r.part], total = total, total + r.n
    folder = stem.parent / f".{stem.name}.parts"
    folder.mkdir(parents=True, exist_ok=True)

    def cell(v, kind: str, width: int) -> bytes:
        if v is None:
            return b" " * width
        if kind == "C":
            return v.encode().ljust(width)
        if kind == "L":
            return b"T" if v else b"F"
        if kind == "D":
            return f"{v:%Y%m%d}".encode()
        return (repr(float(v)) if kind == "F" else str(v)).rjust(width).encode()

    def write(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TaskContext.get().partitionId()
        number, attempt = starts.get(own, 0), TaskContext.get().taskAttemptId()
        low, high, kinds_, n, size = np.full(2, np.inf), np.full(2, -np.inf), set(), 0, 0
        name = str(folder / f"{own}-{attempt}")
        with open(f"{name}.shp", "wb") as shapes, open(f"{name}.shx", "wb") as index, open(f"{name}.dbf", "wb") as table:
            for batch in it:
                for *values, data in zip(*(c.to_pylist() for c in batch.columns)):
                    shape = from_wkb(data) if data is not None else None
                    content = content_of(shape)
                    if shape is not None:
                        kind = struct.unpack_from("<i", content)[0]
                        kinds_.add(kind)
                        xy = np.array([shape.coords[:2], shape.coords[:2]] if kind == POINT else np.frombuffer(content, "<f8", 4, 4).reshape(2, 2))
                        low, high = np.minimum(low, xy.min(0)), np.maximum(high, xy.max(0))
                    number, n = number + 1, n + 1
                    shapes.write(struct.pack(">2i", number, len(content) // 2) + content)
                    index.write(struct.pack(">2i", size // 2, len(content) // 2))
                    size += 8 + len(content)
                    table.write(b" " + b"".join(cell(v, k, w) for v, (_, k, w, _) in zip(values, fields)))
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((own, pa.int32()), (name, pa.string()), (n, pa.int64()), (size, pa.int64()), (sorted(kinds_), pa.list_(pa.int32())), ([*low.tolist(), *high.tolist()], pa.list_(pa.float64())))], names=["part", "name", "n", "size", "kinds", "box"])

    done = sorted(rows.mapInArrow(write, "part int, name string, n long, size long, kinds array<int>, box array<double>").collect())
    found = {k for r in done for k in r.kinds}
    if len(found) > 1:
        raise ValueError("a shapefile has geometries of one kind: points, lines, areas or groups of points")
    size = sum(r["size"] for r in done)
    if size + 100 > MOST_BYTES:
        raise ValueError(f"{size} bytes of shapes: a shapefile ends at 2 GB")
    boxes = np.array([r.box for r in done if r.kinds])
    box = [*boxes[:, :2].min(0), *boxes[:, 2:].max(0)] if len(boxes) else [0.0] * 4

    def header(length: int) -> bytes:
        return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, length // 2) + struct.pack("<2i", 1000, next(iter(found), POINT)) + struct.pack("<8d", *box, 0, 0, 0, 0)

    width = 1 + sum(f[2] for f in fields)
    today = datetime.date.today()
    with open(f"{stem}.shp", "wb") as shapes, open(f"{stem}.shx", "wb") as index, open(f"{stem}.dbf", "wb") as table:
        shapes.write(header(100 + size))
        index.write(header(100 + 8 * total))
        table.write(struct.pack("<4BIHH20x", 3, today.year - 1900, today.month, today.day, total, 33 + 32 * len(fields), width))
        for name, kind, wide_, decimals in fields:
            table.write(name.encode("latin-1", "replace")[:10].ljust(11, b"\0") + kind.encode() + b"\0" * 4 + bytes([wide_, decimals]) + b"\0" * 14)
        table.write(b"\r")
        at = 100
        for r in done:
            with open(f"{r.name}.shp", "rb") as f:
                shutil.copyfileobj(f, shapes)
            with open(f"{r.name}.dbf", "rb") as f:
                shutil.copyfileobj(f, table)
            places = np.fromfile(f"{r.name}.shx", ">i4").reshape(-1, 2)
            index.write((places + np.array([at // 2, 0], ">i4")).astype(">i4").tobytes())
            at += r["size"]
        table.write(b"\x1a")
    Path(f"{stem}.cpg").write_text("UTF-8")
    if wkt:
        Path(f"{stem}.prj").write_text(wkt)
    shutil.rmtree(folder)
