"""Geometries as plain coordinates, with WKT and WKB codecs."""

from __future__ import annotations

import re
import struct
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[float, float]
#: The codes of WKB.
KINDS = {1: "POINT", 2: "LINESTRING", 3: "POLYGON", 4: "MULTIPOINT", 5: "MULTILINESTRING", 6: "MULTIPOLYGON"}
CODES = {v: k for k, v in KINDS.items()}


@dataclass(frozen=True)
class Geometry:
    """A kind and nested coordinates: a point, a path, rings, or lists of these."""

    kind: str
    coords: Any = field(hash=False)

    @property
    def points(self) -> list[Point]:
        return {"POINT": lambda: [self.coords], "MULTIPOINT": lambda: list(self.coords)}.get(self.kind, list)()

    @property
    def paths(self) -> list[list[Point]]:
        return {"LINESTRING": lambda: [self.coords], "MULTILINESTRING": lambda: list(self.coords)}.get(self.kind, list)()

    @property
    def polygons(self) -> list[Geometry]:
        return {"POLYGON": lambda: [self], "MULTIPOLYGON": lambda: [Geometry("POLYGON", c) for c in self.coords]}.get(self.kind, list)()

    @property
    def rings(self) -> list[list[Point]]:
        """Closed rings of a polygon."""
        return [r if r[0] == r[-1] else [*r, r[0]] for r in ([tuple(p) for p in ring] for ring in self.coords)]


def from_wkt(text: str) -> Geometry:
    m = re.fullmatch(r"\s*([A-Za-z]+)\s*(?:Z|M|ZM)?\s*(\(.*\))\s*", text, re.S)
    if not m or m[1].upper() not in CODES:
        raise ValueError(f"no geometry in {text[:60]!r}")
    body = re.sub(r"([-+\d.eE]+(?:\s+[-+\d.eE]+)+)", lambda p: "(" + ",".join(p[0].split()[:2]) + ")", m[2])
    # The brackets now nest as lists of tuples.
    nested: list = []
    stack = [nested]
    for token in re.findall(r"[()]|[^(),\s]+", body):
        if token == "(":
            stack.append([])
            stack[-2].append(stack[-1])
        elif token == ")":
            stack.pop()
        else:
            stack[-1].append(float(token))

    def close(x):
        return tuple(x) if x and isinstance(x[0], float) else [close(i) for i in x]

    coords, kind = close(nested[0]), m[1].upper()
    if kind == "POINT":
        coords = coords[0]
    if kind == "MULTIPOINT":
        coords = [c[0] if isinstance(c, list) else c for c in coords]
    return Geometry(kind, coords)


def from_wkb(data: bytes) -> Geometry:
    at = 0

    def read(fmt: str) -> tuple:
        nonlocal at
        out = struct.unpack_from(fmt, data, at)
        at += struct.calcsize(fmt)
        return out

    def one() -> Geometry:
        order = "<" if read("B")[0] else ">"
        code = read(order + "I")[0]
        if code & 0x20000000:
            read(order + "I")
        flags, code = code, code & 0xFFFF
        dims = 2 + (code // 1000 in (1, 2) or bool(flags & 0x80000000)) + (bool(flags & 0x40000000)) + (code // 1000 == 3) * 2
        kind = KINDS[code % 1000]
        point = lambda: read(f"{order}{dims}d")[:2]
        count = lambda: read(order + "I")[0]
        if kind == "POINT":
            return Geometry(kind, point())
        if kind == "LINESTRING":
            return Geometry(kind, [point() for _ in range(count())])
        if kind == "POLYGON":
            return Geometry(kind, [[point() for _ in range(count())] for _ in range(count())])
        return Geometry(kind, [one().coords for _ in range(count())])

    return one()


def to_wkb(g: Geometry) -> bytes:
    head = struct.pack("<BI", 1, CODES[g.kind])
    path = lambda p: struct.pack("<I", len(p)) + b"".join(struct.pack("<2d", *c[:2]) for c in p)
    if g.kind == "POINT":
        return head + struct.pack("<2d", *g.coords[:2])
    if g.kind == "LINESTRING":
        return head + path(g.coords)
    if g.kind == "POLYGON":
        return head + struct.pack("<I", len(g.coords)) + b"".join(map(path, g.coords))
    return head + struct.pack("<I", len(g.coords)) + b"".join(to_wkb(Geometry(g.kind[5:], c)) for c in g.coords)


def to_wkt(g: Geometry) -> str:
    def text(c) -> str:
        return " ".join(f"{v:.15g}" for v in c) if c and isinstance(c[0], (int, float)) else "(" + ", ".join(map(text, c)) + ")"

    return f"{g.kind} ({text(g.coords)})" if g.kind == "POINT" else f"{g.kind} {text(g.coords)}"


def as_geometries(value: Any) -> list[Geometry]:
    """Geometries of WKT, WKB, a Geometry, coordinates of points, or a list of these."""
    if isinstance(value, Geometry):
        return [value]
    if isinstance(value, str):
        return [from_wkt(value)]
    if isinstance(value, (bytes, bytearray)):
        return [from_wkb(bytes(value))]
    if isinstance(value, Sequence) and len(value) == 2 and all(isinstance(v, (int, float)) for v in value):
        return [Geometry("POINT", tuple(value))]
    if isinstance(value, Sequence):
        return [g for v in value for g in as_geometries(v)]
    raise TypeError(f"no geometry: {type(value).__name__}")


def hex_double(x: Column) -> Column:
    """The 16 hex digits of a double, most significant first, by arithmetic on its parts."""
    a = F.abs(x)
    e = F.when(a == 0, F.lit(0)).otherwise(F.floor(F.log2(a)).cast("int"))
    e = F.when(a >= F.pow(F.lit(2.0), e + 1), e + 1).when(a < F.pow(F.lit(2.0), e), e - 1).otherwise(e)
    fraction = ((a / F.pow(F.lit(2.0), e) - 1) * F.lit(float(1 << 52))).cast("long")
    bits = F.when(a == 0, F.lit(0).cast("long")).otherwise(F.shiftleft((e + 1023).cast("long"), 52).bitwiseOR(fraction))
    return F.lpad(F.hex(F.when(x < 0, bits.bitwiseOR(F.lit(-(1 << 63)))).otherwise(bits)), 16, "0")


def point_wkb(x: Column, y: Column) -> Column:
    """WKB of a point in big-endian order, made without Python."""
    return F.when(x.isNotNull() & y.isNotNull(), F.unhex(F.concat(F.lit("0000000001"), hex_double(x.cast("double")), hex_double(y.cast("double")))))


def polygon_wkb(ring: Column) -> Column:
    """WKB of a polygon in big-endian order, made without Python from its outer ring: an array of points (x, y), closed."""
    count = F.lpad(F.hex(F.size(ring).cast("long")), 8, "0")
    points = F.array_join(F.transform(ring, lambda p: F.concat(hex_double(p["x"].cast("double")), hex_double(p["y"].cast("double")))), "")
    return F.when(F.size(ring) > 0, F.unhex(F.concat(F.lit("000000000300000001"), count, points)))


def double_of(digits: Column) -> Column:
    """The double of 16 hex digits, most significant first; null for infinite ones and those that are no number."""
    high = F.conv(F.substring(digits, 1, 3), 16, 10).cast("long")
    exponent, fraction = high % 2048, F.conv(F.substring(digits, 4, 13), 16, 10).cast("double")
    size = F.when(exponent == 0, fraction * F.pow(F.lit(2.0), F.lit(-1074))).when(exponent < 2047, (1 + fraction / F.lit(float(1 << 52))) * F.pow(F.lit(2.0), exponent - 1023))
    return F.when(high >= 2048, -size).otherwise(size)


def wkb_point(wkb: Column) -> tuple[Column, Column]:
    """x and y of a point's WKB in either byte order, with or without a reference system; nulls for other kinds."""

    def pair(h: Column) -> Column:
        def digits(begin: Column | int, n: int) -> Column:
            raw = F.substr(h, F.lit(begin) if isinstance(begin, int) else begin, F.lit(2 * n))
            turned = F.regexp_replace(F.reverse(raw), "(.)(.)", "$2$1")  # the bytes from the last to the first
            return F.when(F.substring(h, 1, 2) == "01", turned).otherwise(raw)

        code = F.conv(digits(3, 4), 16, 10).cast("long")
        begin = F.when(F.floor(code / F.lit(0x20000000)) % 2 == 1, F.lit(19)).otherwise(F.lit(11))
        point = ((code % 65536) % 1000) == 1
        return F.when(point, F.transform(F.array(digits(begin, 8), digits(begin + 16, 8)), double_of))

    # Bound by lambdas, so that each text is made once.
    xy = F.get(F.transform(F.array(F.hex(wkb)), pair), F.lit(0))
    return F.get(xy, F.lit(0)), F.get(xy, F.lit(1))
