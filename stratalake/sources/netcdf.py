"""Classic NetCDF files (CDF-1, CDF-2 and CDF-5) as a data source of long tables, read in slabs by tasks.

``spark.read.format("netcdf_grid").option("variables", "a,b").option("box", "0,0,50,50").load(path)`` gives a row a cell:
the coordinates of the dimensions, then the variables. Only the header and the coordinates are read to plan; each
partition is a slab of the slowest dimension and reads its own bytes, of the wanted variables and within the box alone.
The file lies where driver and executors see it.

Defined cases: ``_FillValue`` and ``missing_value`` are null, as is NaN; ``scale_factor`` and ``add_offset`` are applied;
a variable without one of the grid's dimensions has its value at all coordinates of it; a dimension without coordinates
counts from 0; a grid without cells, or a box beside it, gives no rows; texts are no variables of a grid.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any, BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..storage import open_file

#: The format's codes of types, with numpy's names of them in big-endian order; 2 is text.
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12
AXES = ("x", "y", "z")
#: Cells of a partition's slab and of a batch, bytes read at a time.
SLAB_CELLS, BATCH_CELLS, READ_BYTES = 4_000_000, 1 << 16, 32 << 20


@dataclass
class Variable:
    """Where a variable's numbers lie: the first at ``begin``, a record's ``stride`` bytes apart if it has records."""

    name: str
    dims: list[str]
    shape: list[int]
    kind: str
    begin: int
    stride: int | None
    attributes: dict[str, Any] = field(default_factory=dict)

    @property
    def scaled(self) -> bool:
        return "scale_factor" in self.attributes or "add_offset" in self.attributes

    @property
    def spark_type(self) -> str:
        if self.scaled:
            return "double"
        return {">i1": "int", ">i2": "int", ">i4": "int", ">u1": "int", ">u2": "int", ">u4": "long", ">i8": "long", ">u8": "decimal(20,0)", ">f4": "float", ">f8": "double"}[self.kind]


def header(f: BinaryIO) -> dict[str, Variable]:
    """The variables of a file, from its header."""
    magic = f.read(4)
    if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
        raise ValueError("no classic NetCDF file (CDF-1, CDF-2 or CDF-5)")
    count, offset = (">q", ">q") if magic[3] == 5 else (">i", ">i" if magic[3] == 1 else ">q")

    def number(fmt: str = count) -> int:
        return struct.unpack(fmt, f.read(struct.calcsize(fmt)))[0]

    def padded(n: int) -> bytes:
        data = f.read(n)
        f.read(-n % 4)
        return data

    def name() -> str:
        return padded(number()).decode()

    def items(tag: int) -> range:
        found, n = number(">i"), number()
        if found not in (0, tag) or found == 0 and n:
            raise ValueError("the NetCDF header is broken")
        return range(n)

    def attributes() -> dict[str, Any]:
        out = {}
        for _ in items(ATTRIBUTES):
            key, kind = name(), TYPES[number(">i")]
            n = number()
            data = padded(n * np.dtype(kind).itemsize)
            out[key] = data.decode(errors="replace") if kind == "S1" else np.frombuffer(data, kind).tolist()
        return out

    records = number()
    dims = [(name(), number()) for _ in items(DIMENSIONS)]
    attributes()
    found, sizes = [], []
    for _ in items(VARIABLES):
        own = name()
        ids = [number() for _ in range(number())]
        attrs, kind = attributes(), TYPES[number(">i")]
        number()  # the stored size overflows for large variables; it follows from the shape
        begin = number(offset)
        of_records = bool(ids) and dims[ids[0]][1] == 0
        shape = [dims[i][1] for i in ids]
        if of_records:
            shape[0] = records
            sizes.append((own, int(np.prod(shape[1:], dtype=np.int64)) * np.dtype(kind).itemsize))
        found.append(Variable(own, [dims[i][0] for i in ids], shape, kind, begin, 0 if of_records else None, attrs))
    # A single variable with records has them without padding, several have them rounded up to four bytes.
    stride = sizes[0][1] if len(sizes) == 1 else sum(n + -n % 4 for _, n in sizes)
    if records < 0 and sizes:
        raise ValueError("the file doesn't say how many records it has")
    for v in found:
        v.stride = stride if v.stride == 0 else None
    return {v.name: v for v in found}


def numbers(f: BinaryIO, v: Variable, box: Sequence[tuple[int, int]]) -> np.ndarray:
    """The numbers of a variable within ranges of its indexes, in rows as long as one read allows."""
    size, shape = np.dtype(v.kind).itemsize, v.shape
    if not shape:
        f.seek(v.begin)
        return np.frombuffer(f.read(size), v.kind)[0]
    inner = [int(np.prod(shape[k + 1 :], dtype=np.int64)) for k in range(len(shape))]
    out = np.empty([b - a for a, b in box], np.dtype(v.kind))
    if not out.size:
        return out

    def fill(view: np.ndarray, at: int, k: int) -> None:
        # The ranges from dimension k on, of an array that begins at this byte.
        (a, b), width = box[k], inner[k] * size
        records = k == 0 and v.stride is not None
        whole = all(box[j] == (0, shape[j]) for j in range(k + 1, len(shape)))
        if not records and (whole or (b - a) * width <= READ_BYTES):
            step = max(1, READ_BYTES // max(width, 1))
            for i in range(a, b, step):
                n = min(step, b - i)
                f.seek(at + i * width)
                data = np.frombuffer(f.read(n * width), v.kind).reshape([n, *shape[k + 1 :]])
                view[i - a : i - a + n] = data[(slice(None), *[slice(*r) for r in box[k + 1 :]])]
            return
        for i in range(a, b):
            start = at + i * (v.stride if records else width)
            if k + 1 < len(shape):
                fill(view[i - a], start, k + 1)
            else:
                f.seek(start)
                view[i - a] = np.frombuffer(f.read(size), v.kind)[0]

    fill(out, v.begin, 0)
    return out


def decoded(values: np.ndarray, v: Variable) -> pa.Array:
    """Numbers as an Arrow array, with nulls for what stands for none."""
    flat = np.ascontiguousarray(values).ravel()
    mask = np.isnan(flat) if flat.dtype.kind == "f" else np.zeros(len(flat), bool)
    for key in ("_FillValue", "missing_value"):
        for none in v.attributes.get(key, []) if not isinstance(v.attributes.get(key), str) else []:
            mask |= flat == flat.dtype.type(none)
    if v.scaled:
        one = lambda key, default: float(v.attributes.get(key, [default])[0])
        flat = flat.astype(np.float64) * one("scale_factor", 1) + one("add_offset", 0)
    kinds = {"int": pa.int32(), "long": pa.int64(), "float": pa.float32(), "double": pa.float64(), "decimal(20,0)": pa.decimal128(20, 0)}
    kind = kinds[v.spark_type]
    native = flat.astype(flat.dtype.newbyteorder("="))
    out = pa.array(native, mask=mask)
    return out if out.type == kind else out.cast(kind)


@dataclass
class Slab(InputPartition):
    """A partition: for each dimension of the grid the range of its indexes."""

    ranges: dict[str, tuple[int, int]]


class GridReader(DataSourceReader):
    """Plans slabs from the header and the coordinates, and reads one."""

    def __init__(self, path: str, names: Sequence[str] | None, box: dict[str, tuple[float, float]], cells: int = SLAB_CELLS):
        self.path, self.box, self.cells = path, box, cells
        with open_file(path) as f:
            found = header(f)
            dims = next((v.dims for v in found.values() if set(v.dims) >= set(AXES)), None)
            if dims is None:
                raise ValueError(f"{path} has no variable over x, y and z")
            self.dims = [d for d in dims if d in AXES]
            # Only the dimensions of a grid: one more has to have a single index.
            fits = lambda v: v.kind != "S1" and v.name not in AXES and all(d in AXES or n == 1 for d, n in zip(v.dims, v.shape)) and any(d in AXES for d in v.dims)
            wanted = list(names) if names else [n for n, v in found.items() if fits(v)]
            if missing := [n for n in wanted if n not in found or not fits(found[n])]:
                raise ValueError(f"{path} has no variable of the grid named {', '.join(missing)}")
            self.variables = [found[n] for n in wanted]
            sizes = dict(zip(*(next((v.dims, v.shape) for v in found.values() if v.dims == dims))))
            self.coordinates = {d: self._axis(f, found, d, sizes[d]) for d in self.dims}
        self.ranges = {d: self._range(d) for d in self.dims}

    @staticmethod
    def _axis(f: BinaryIO, found: dict[str, Variable], d: str, n: int) -> np.ndarray:
        v = found.get(d)
        if v is None or v.dims != [d]:
            return np.arange(n, dtype=np.float64)
        values = numbers(f, v, [(0, n)]).astype(np.float64)
        if v.scaled:
            values = values * float(v.attributes.get("scale_factor", [1])[0]) + float(v.attributes.get("add_offset", [0])[0])
        return values

    def _range(self, d: str) -> tuple[int, int]:
        low, high = self.box.get(d, (-np.inf, np.inf))
        inside = np.flatnonzero((self.coordinates[d] >= low) & (self.coordinates[d] <= high))
        return (int(inside[0]), int(inside[-1]) + 1) if len(inside) else (0, 0)

    def schema(self) -> str:
        return ", ".join([*[f"`{a}` double" for a in AXES], *[f"`{v.name}` {v.spark_type}" for v in self.variables]])

    def partitions(self) -> list[Slab]:
        first, *rest = self.dims
        a, b = self.ranges[first]
        plane = int(np.prod([self.ranges[d][1] - self.ranges[d][0] for d in rest], dtype=np.int64))
        if not plane or a == b:
            return []
        step = max(1, self.cells // plane)
        return [Slab(self.ranges | {first: (i, min(b, i + step))}) for i in range(a, b, step)]

    def read(self, partition: Slab | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are no slabs
            return
        ranges = [partition.ranges[d] for d in self.dims]
        shape = [b - a for a, b in ranges]
        kept = np.ones(shape, bool)
        spans = {}
        for k, d in enumerate(self.dims):
            spans[d] = self.coordinates[d][slice(*partition.ranges[d])]
            low, high = self.box.get(d, (-np.inf, np.inf))
            kept &= ((spans[d] >= low) & (spans[d] <= high)).reshape([-1 if j == k else 1 for j in range(len(shape))])
        width = int(np.prod(shape[1:], dtype=np.int64))
        step = max(1, BATCH_CELLS // max(width, 1))
        with open_file(self.path) as f:
            for i in range(0, shape[0], step):
                n = min(step, shape[0] - i)
                part = [(ranges[0][0] + i, ranges[0][0] + i + n), *ranges[1:]]
                at = dict(zip(self.dims, part))
                full = [n, *shape[1:]]
                mask = kept[i : i + n].ravel()
                columns = []
                for axis in AXES:
                    k = self.dims.index(axis)
                    values = spans[axis][i : i + n] if k == 0 else spans[axis]
                    columns.append(pa.array(np.broadcast_to(values.reshape([-1 if j == k else 1 for j in range(len(full))]), full).ravel()))
                for v in self.variables:
                    own = numbers(f, v, [at.get(d, (0, 1)) for d in v.dims])
                    # Into the order of the grid's dimensions, with those that it lacks at each of their coordinates.
                    own = own.reshape([m for d, m in zip(v.dims, own.shape) if d in AXES])
                    dims = [d for d in v.dims if d in AXES]
                    own = own.transpose([dims.index(d) for d in self.dims if d in dims])
                    own = own.reshape([m if d in dims else 1 for d, m in zip(self.dims, full)])
                    columns.append(decoded(np.broadcast_to(own, full), v))
                batch = pa.RecordBatch.from_arrays(columns, names=[*AXES, *[v.name for v in self.variables]])
                batch = batch if mask.all() else batch.filter(pa.array(mask))
                for j in range(0, batch.num_rows, BATCH_CELLS):
                    yield batch.slice(j, BATCH_CELLS)


class NetcdfSource(DataSource):
    """The data source ``netcdf_grid``; options path, variables (with commas) and box (xmin,ymin,xmax,ymax)."""

    @classmethod
    def name(cls) -> str:
        return "netcdf_grid"

    def grid(self) -> GridReader:
        wanted = [n.strip() for n in self.options.get("variables", "").split(",") if n.strip()]
        box = [float(v) for v in self.options["box"].split(",")] if "box" in self.options else None
        return GridReader(self.options["path"], wanted or None, {"x": (box[0], box[2]), "y": (box[1], box[3])} if box else {}, int(self.options.get("cells", SLAB_CELLS)))

    def schema(self) -> str:
        return self.grid().schema()

    def reader(self, schema) -> GridReader:
        return self.grid()


def read_netcdf(spark: SparkSession, path: str, data_vars: Sequence[str] | None = None, bbox: tuple[float, float, float, float] | None = None, cells: int = SLAB_CELLS) -> DataFrame:
    """The cells of a file as a long table; variables and box are read, nothing else."""
    spark.dataSource.register(NetcdfSource)
    options = {"cells": str(cells)} | ({"variables": ",".join(data_vars)} if data_vars else {}) | ({"box": ",".join(map(repr, map(float, bbox)))} if bbox else {})
    return spark.read.format("netcdf_grid").options(**options).load(path)


def write_netcdf(df: DataFrame, path: str, axes: dict[str, Sequence[float]], version: int = 2) -> None:
    """A dense long table (x, y, z, variables of numbers) as a file with the dimensions z, y (descending) and x.

    Tasks lay the cells of a layer of z out as its bytes; the driver writes one layer of one variable at a time where it
    belongs. Cells without a row or a value hold the fill value.
    """
    names = [c for c in df.columns if c not in AXES]
    code = {"int": (4, ">i4", -2147483647), "bigint": (6, ">f8", 9.969209968386869e36), "float": (5, ">f4", 9.969209968386869e36), "double": (6, ">f8", 9.969209968386869e36)}
    types = dict(df.dtypes)
    if bad := [n for n in names if types[n] not in code]:
        raise ValueError(f"no numbers that the format has: {', '.join(bad)}")
    order = {"z": sorted(axes["z"]), "y": sorted(axes["y"], reverse=True), "x": sorted(axes["x"])}
    wide = ">q" if version == 5 else ">i"
    at = ">i" if version == 1 else ">q"

    def text(s: str) -> bytes:
        data = s.encode()
        return struct.pack(wide, len(data)) + data + b"\0" * (-len(data) % 4)

    def variable(name: str, dims: list[int], kind: int, fill: float | None, size: int, begin: int) -> bytes:
        own = struct.pack(">i", ATTRIBUTES) + struct.pack(wide, 1) + text("_FillValue") + struct.pack(">i", kind) + struct.pack(wide, 1) + np.array([fill], TYPES[kind]).tobytes() if fill is not None else struct.pack(">i", 0) + struct.pack(wide, 0)
        return text(name) + struct.pack(wide, len(dims)) + b"".join(struct.pack(wide, d) for d in dims) + own + struct.pack(">i", kind) + struct.pack(wide, min(size, 2**31 - 4)) + struct.pack(at, begin)

    cells = int(np.prod([len(v) for v in order.values()], dtype=np.int64))
    sizes = [8 * len(v) for v in order.values()] + [cells * np.dtype(code[types[n]][1]).itemsize for n in names]

    def made(begin: int) -> bytes:
        starts = [begin + sum(sizes[:i]) for i in range(len(sizes))]
        dims = struct.pack(">i", DIMENSIONS) + struct.pack(wide, 3) + b"".join(text(d) + struct.pack(wide, len(v)) for d, v in order.items())
        own = [variable(d, [i], 6, None, sizes[i], starts[i]) for i, d in enumerate(order)]
        own += [variable(n, [0, 1, 2], code[types[n]][0], code[types[n]][2], sizes[3 + i], starts[3 + i]) for i, n in enumerate(names)]
        return b"CDF" + bytes([version]) + struct.pack(wide, 0) + dims + struct.pack(">i", 0) + struct.pack(wide, 0) + struct.pack(">i", VARIABLES) + struct.pack(wide, len(own)) + b"".join(own)

    begin = len(made(0))
    index = {d: {v: i for i, v in enumerate(c)} for d, c in order.items()}
    plane = len(order["y"]) * len(order["x"])
    kinds = [code[types[n]] for n in names]

    def layer(key: tuple, table: pa.Table) -> pa.Table:
        rows, out = table.to_pydict(), []
        where = np.array([index["y"][y] * len(index["x"]) + index["x"][x] for x, y in zip(rows["x"], rows["y"])], np.int64)
        for name, (_, kind, fill) in zip(names, kinds):
            data = np.full(plane, fill, kind)
            data[where] = [fill if v is None else v for v in rows[name]]
            out.append(data.tobytes())
        return pa.table({"k": [index["z"][key[0].as_py()]], "data": [out]}, schema=pa.schema([("k", pa.int64()), ("data", pa.list_(pa.binary()))]))

    laid = df.groupBy("z").applyInArrow(layer, "k long, data array<binary>")
    with open(path, "wb") as f:
        f.write(made(begin))
        for v in order.values():
            f.write(np.array(v, ">f8").tobytes())
        starts = [begin + sum(sizes[: 3 + i]) for i in range(len(names))]
        for (_, kind, fill), s in zip(kinds, starts):
            for i in range(len(order["z"])):
                f.seek(s + i * plane * np.dtype(kind).itemsize)
                f.write(np.full(plane, fill, kind).tobytes())
        for r in laid.toLocalIterator():
            for (_, kind, _), s, data in zip(kinds, starts, r.data):
                f.seek(s + r.k * plane * np.dtype(kind).itemsize)
                f.write(data)
