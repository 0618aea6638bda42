"""Classic NetCDF files: made here byte by byte, and by the library's own writer, and read in slabs."""

import itertools
import math
import struct

import numpy as np
import pytest

from stratalake.operators.voxel import VoxelModel
from stratalake.sources import netcdf

CODES = {"i1": 1, "i2": 3, "i4": 4, "f4": 5, "f8": 6, "u1": 7, "u2": 8, "u4": 9, "i8": 10, "u8": 11}


def build(path, version, dims, variables, records=None):
    """A file after the format's grammar. dims: {name: length, None for records}; variables: (name, dims, type, data, attributes)."""
    wide, at = (">q" if version == 5 else ">i"), (">i" if version == 1 else ">q")
    text = lambda s: struct.pack(wide, len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    order = list(dims)

    def attributes(found):
        out = struct.pack(">i", 12 if found else 0) + struct.pack(wide, len(found))
        for k, (kind, values) in found.items():
            data = values.encode() if kind == "char" else np.array(values, ">" + kind).tobytes()
            n = len(values)
            out += text(k) + struct.pack(">i", 2 if kind == "char" else CODES[kind]) + struct.pack(wide, n) + data + b"\0" * (-len(data) % 4)
        return out

    per_record = [v for v in variables if v[1] and dims[v[1][0]] is None]
    rounded = len(per_record) > 1
    size = lambda v: int(np.prod([dims[d] for d in v[1] if dims[d] is not None], dtype=int)) * np.dtype(v[2]).itemsize

    def head(begins):
        out = b"CDF" + bytes([version]) + struct.pack(wide, records or 0)
        out += struct.pack(">i", 10) + struct.pack(wide, len(dims)) + b"".join(text(d) + struct.pack(wide, n or 0) for d, n in dims.items())
        out += attributes({"title": ("char", "a grid")}) + struct.pack(">i", 11) + struct.pack(wide, len(variables))
        for v, b in zip(variables, begins):
            out += text(v[0]) + struct.pack(wide, len(v[1])) + b"".join(struct.pack(wide, order.index(d)) for d in v[1])
            out += attributes(v[4]) + struct.pack(">i", CODES[v[2]]) + struct.pack(wide, size(v) + -size(v) % 4) + struct.pack(at, b)
        return out

    begins, place = [0] * len(variables), len(head([0] * len(variables)))
    for i, v in enumerate(variables):
        if v not in per_record:
            begins[i] = place
            place += size(v) + -size(v) % 4
    for i, v in enumerate(variables):
        if v in per_record:
            begins[i] = place
            place += size(v) + (-size(v) % 4 if rounded else 0)
    body = head(begins)
    for v in variables:
        if v not in per_record:
            data = np.array(v[3], ">" + v[2]).tobytes()
            body += data + b"\0" * (-len(data) % 4)
    for r in range(records or 0):
        for v in per_record:
            data = np.array(v[3][r], ">" + v[2]).tobytes()
            body += data + (b"\0" * (-len(data) % 4) if rounded else b"")
    path.write_bytes(body)
    return str(path)


X, Y, Z = [0.05 + 0.1 * i for i in range(7)], [3.0 - i for i in range(5)], [-2.0, -1.5, 0.25, 4.0]


def grid(path, version, order, kind="i2", fill=-9, extra=()):
    sizes = {"x": 7, "y": 5, "z": 4}
    values = np.arange(140).reshape([sizes[d] for d in order]).astype(kind)
    values.ravel()[[3, 77]] = fill
    axes = [(d, [d], "f8", v, {}) for d, v in (("x", X), ("y", Y), ("z", Z))]
    flat = ("surface", ["y", "x"], "f4", np.arange(35).reshape(5, 7) / 4, {})
    build(path, version, {d: sizes[d] for d in order}, [*axes, ("lith", list(order), kind, values, {"_FillValue": (kind, [fill])}), flat, *extra])
    cells = {}
    for at in itertools.product(*[range(sizes[d]) for d in order]):
        i = dict(zip(order, at))
        v = values[at]
        cells[X[i["x"]], Y[i["y"]], Z[i["z"]]] = (None if v == fill else int(v) if kind[0] != "f" else float(v), (i["y"] * 7 + i["x"]) / 4)
    return cells


@pytest.mark.parametrize("version", [1, 2, 5])
@pytest.mark.parametrize("order", ["zyx", "xyz", "yxz"])
def test_cells_of_every_version_and_order(spark, tmp_path, version, order):
    cells = grid(tmp_path / "g.nc", version, order)
    df = netcdf.read_netcdf(spark, str(tmp_path / "g.nc"), cells=30)
    assert df.dtypes == [("x", "double"), ("y", "double"), ("z", "double"), ("lith", "int"), ("surface", "float")]
    got = df.collect()
    assert len(got) == 140 and {(r.x, r.y, r.z): (r.lith, r.surface) for r in got} == cells


@pytest.mark.parametrize("kind", ["i1", "i4", "f4", "f8", "u1", "u2", "u4", "i8"])
def test_types_of_numbers(spark, tmp_path, kind):
    cells = grid(tmp_path / "g.nc", 5, "zyx", kind, fill=111)
    got = {(r.x, r.y, r.z): r.lith for r in netcdf.read_netcdf(spark, str(tmp_path / "g.nc"), ["lith"]).collect()}
    assert got == {k: v[0] for k, v in cells.items()}


def test_box_and_variables_are_all_that_is_read(spark, tmp_path, monkeypatch):
    cells = grid(tmp_path / "g.nc", 2, "zyx")
    reader = netcdf.GridReader(str(tmp_path / "g.nc"), ["lith"], {"x": (0.2, 0.4), "y": (0.0, 2.0)}, cells=10)
    parts = reader.partitions()
    assert [p.ranges for p in parts] == [{"z": (k, k + 1), "y": (1, 4), "x": (2, 4)} for k in range(4)]
    assert [v.name for v in reader.variables] == ["lith"]
    read, plain = [], netcdf.open_file
    monkeypatch.setattr(netcdf, "READ_BYTES", 8)

    class Counted:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def seek(self, n):
            self.f.seek(n)

        def read(self, n):
            read.append(n)
            return self.f.read(n)

    monkeypatch.setattr(netcdf, "open_file", lambda path: Counted(plain(path)))
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    inside = {k: v[0] for k, v in cells.items() if 0.2 <= k[0] <= 0.4 and 0 <= k[1] <= 2}
    assert {(r["x"], r["y"], r["z"]): r["lith"] for r in rows} == inside
    assert sum(read) == 4 * 3 * 2 * 2  # two bytes of two cells of three rows of four layers
    monkeypatch.setattr(netcdf, "open_file", plain)
    model = VoxelModel.from_netcdf(spark, str(tmp_path / "g.nc"), ["lith"], (0.2, 0.0, 0.4, 2.0), crs=28992)
    assert model.variables == ["lith"] and model.shape == (3, 2, 4) and model.df.count() == len(inside)
    assert model.z.centres == tuple(Z) and model.x.centres == tuple(X[2:4])
    assert netcdf.read_netcdf(spark, str(tmp_path / "g.nc"), bbox=(50, 50, 60, 60)).count() == 0


@pytest.mark.parametrize("several", [False, True])
def test_records_scales_and_missing_values(spark, tmp_path, several):
    a = np.arange(3 * 2 * 3).reshape(3, 2, 3)
    variables = [("a", ["z", "y", "x"], "i1", a, {"scale_factor": ("f8", [0.5]), "add_offset": ("f8", [10.0]), "missing_value": ("i1", [4])})]
    if several:
        variables += [("b", ["z", "y", "x"], "i2", a * 3, {}), ("z", ["z"], "f4", [1.0, 2.0, 4.0], {}), ("when", [], "i4", 5, {})]
    build(tmp_path / "r.nc", 1, {"z": None, "y": 2, "x": 3}, variables, records=3)
    got = {(r.x, r.y, r.z): r for r in netcdf.read_netcdf(spark, str(tmp_path / "r.nc")).collect()}
    heights = [1.0, 2.0, 4.0] if several else [0.0, 1.0, 2.0]
    assert len(got) == 18
    for (k, j, i), v in np.ndenumerate(a):
        r = got[float(i), float(j), heights[k]]
        assert r.a == (None if v == 4 else 10 + v * 0.5) and (not several or r.b == v * 3)


def test_what_is_no_grid_is_an_error(spark, tmp_path):
    (tmp_path / "bad.nc").write_bytes(b"\x89HDF\r\n\x1a\n" + b"\0" * 100)
    with pytest.raises(ValueError, match="CDF-1"):
        netcdf.GridReader(str(tmp_path / "bad.nc"), None, {})
    build(tmp_path / "flat.nc", 1, {"x": 2}, [("x", ["x"], "f8", [1, 2], {})])
    with pytest.raises(ValueError, match="x, y and z"):
        netcdf.GridReader(str(tmp_path / "flat.nc"), None, {})
    grid(tmp_path / "g.nc", 1, "zyx")
    with pytest.raises(ValueError, match="nope"):
        netcdf.GridReader(str(tmp_path / "g.nc"), ["nope"], {})


@pytest.mark.parametrize("version", [1, 2, 5])
def test_written_and_read_back(spark, tmp_path, version):
    rows = [(x, y, z, None if (i + j) % 5 == 0 else i * j, i / 8 if k else math.nan) for i, x in enumerate(X) for j, y in enumerate(Y) for k, z in enumerate(Z) if (i, j, k) != (1, 1, 1)]
    df = spark.createDataFrame(rows, "x double, y double, z double, lith int, p double")
    netcdf.write_netcdf(df, str(tmp_path / "w.nc"), {"x": X, "y": Y, "z": Z}, version)
    got = {(r.x, r.y, r.z): (r.lith, r.p) for r in netcdf.read_netcdf(spark, str(tmp_path / "w.nc")).collect()}
    want = {r[:3]: (r[3], None if math.isnan(r[4]) else r[4]) for r in rows} | {(X[1], Y[1], Z[1]): (None, None)}
    assert got == want


def test_lower_left_corners(spark, tmp_path):
    cells = [(float(x * 100), float(y * 100), z * 0.5, x + y) for x in range(4) for y in range(4) for z in range(3)]
    df = spark.createDataFrame(cells, "x double, y double, z double, strat int")
    netcdf.write_netcdf(df, str(tmp_path / "l.nc"), {a: sorted({c[i] for c in cells}) for i, a in enumerate("xyz")})
    m = VoxelModel.from_netcdf(spark, str(tmp_path / "l.nc"), bbox=(100, 100, 250, 250), lower_left=(100, 0.5))
    want = VoxelModel.from_lower_left(df, 100, 0.5, bbox=(100, 100, 250, 250))
    assert m.bounds == want.bounds and sorted(map(tuple, m.df.collect())) == sorted(map(tuple, want.df.collect()))
