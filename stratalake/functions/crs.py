"""Coordinate transforms as column expressions, without Python: RD, geographic systems, and those of SYSTEMS by their parameters.

Longitudes and latitudes come as degrees in this order. Systems on another datum are shifted by seven parameters; ETRS89
and WGS 84 count as one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..roles import Roles, col

#: Ellipsoids (semi-major axis, inverse flattening).
BESSEL, WGS84 = (6377397.155, 299.1528128), (6378137.0, 298.257223563)
#: The oblique stereographic projection of RD: origin, scale, false easting and northing.
RD_LAT, RD_LON, RD_SCALE, RD_X, RD_Y = 52.15616055555555, 5.38763888888889, 0.9999079, 155000.0, 463000.0
#: Position-vector shift from Bessel to WGS 84: metres, arc seconds, parts per million.
SHIFT, ROTATION, SCALE = (565.4171, 50.3319, 465.5524), (-0.398957, 0.343988, -1.87740), 4.0725


class Steps:
    """Named intermediate columns: an expression used several times is computed once, and trees stay small."""

    def __init__(self, df: DataFrame):
        self.df, self.n = df, 0

    def put(self, *values: Column) -> Column | tuple[Column, ...]:
        names = [f"_step{self.n + i}" for i in range(len(values))]
        self.n += len(values)
        self.df = self.df.withColumns(dict(zip(names, values)))
        return F.col(names[0]) if len(names) == 1 else tuple(map(F.col, names))

    def done(self) -> DataFrame:
        return self.df.drop(*[f"_step{i}" for i in range(self.n)])


def _geocentric(s: Steps, lat: Column, lon: Column, ellipsoid: tuple[float, float]) -> tuple[Column, Column, Column]:
    a, f = ellipsoid[0], 1 / ellipsoid[1]
    e2 = f * (2 - f)
    n = s.put(a / F.sqrt(1 - e2 * F.sin(lat) * F.sin(lat)))
    return s.put(n * F.cos(lat) * F.cos(lon), n * F.cos(lat) * F.sin(lon), n * (1 - e2) * F.sin(lat))


def _geodetic(s: Steps, x: Column, y: Column, z: Column, ellipsoid: tuple[float, float]) -> tuple[Column, Column]:
    a, f = ellipsoid[0], 1 / ellipsoid[1]
    b, e2 = a * (1 - f), f * (2 - f)
    p = s.put(F.sqrt(x * x + y * y))
    t = s.put(F.atan2(z * a, p * b))
    lat = F.atan2(z + e2 / (1 - e2) * b * F.pow(F.sin(t), 3), p - e2 * a * F.pow(F.cos(t), 3))
    return s.put(lat, F.atan2(y, x))


def _shifted(st: Steps, x: Column, y: Column, z: Column, sign: int, shift: tuple[float, ...] = (*SHIFT, *ROTATION, SCALE)) -> tuple[Column, Column, Column]:
    tx, ty, tz = shift[:3]
    rx, ry, rz = (math.radians(v / 3600) for v in shift[3:6])
    s = 1 + shift[6] * 1e-6
    if sign > 0:
        return st.put(tx + s * (x - rz * y + ry * z), ty + s * (rz * x + y - rx * z), tz + s * (-ry * x + rx * y + z))
    x, y, z = st.put((x - tx) / s, (y - ty) / s, (z - tz) / s)
    # The inverse of the rotation and scale matrix, exactly for the skew matrix of the three angles.
    q, d = 1 + rx * rx + ry * ry + rz * rz, st.put(rx * x + ry * y + rz * z)
    return st.put((x + rz * y - ry * z + rx * d) / q, (y - rz * x + rx * z + ry * d) / q, (z + ry * x - rx * y + rz * d) / q)


def _sphere() -> dict[str, float]:
    a, f = BESSEL[0], 1 / BESSEL[1]
    e2 = f * (2 - f)
    e, lat = math.sqrt(e2), math.radians(RD_LAT)
    rho = a * (1 - e2) / (1 - e2 * math.sin(lat) ** 2) ** 1.5
    nu = a / math.sqrt(1 - e2 * math.sin(lat) ** 2)
    n = math.sqrt(1 + e2 * math.cos(lat) ** 4 / (1 - e2))
    s1, s2 = (1 + math.sin(lat)) / (1 - math.sin(lat)), (1 - e * math.sin(lat)) / (1 + e * math.sin(lat))
    w1 = (s1 * s2**e) ** n
    sin0 = (w1 - 1) / (w1 + 1)
    c = (n + math.sin(lat)) * (1 - sin0) / ((n - math.sin(lat)) * (1 + sin0))
    w2 = c * w1
    return {"e": e, "e2": e2, "n": n, "c": c, "R": math.sqrt(rho * nu), "lat": math.asin((w2 - 1) / (w2 + 1)), "lon": math.radians(RD_LON)}


def rd_to_wgs84(s: Steps, x: Column, y: Column) -> tuple[Column, Column]:
    """(lon, lat) in degrees of RD coordinates."""
    k = _sphere()
    g = 2 * k["R"] * RD_SCALE * math.tan(math.pi / 4 - k["lat"] / 2)
    h = 4 * k["R"] * RD_SCALE * math.tan(k["lat"]) + g
    dx, dy = x - RD_X, y - RD_Y
    i = s.put(F.atan2(dx, h + dy))
    j = s.put(F.atan2(dx, g - dy) - i)
    chi = k["lat"] + 2 * F.atan((dy - dx * F.tan(j / 2)) / (2 * k["R"] * RD_SCALE))
    chi = s.put(chi)
    lon = s.put((j + 2 * i) / k["n"] + k["lon"])
    psi = 0.5 * F.log((1 + F.sin(chi)) / (k["c"] * (1 - F.sin(chi)))) / k["n"]
    psi = s.put(psi)
    lat = s.put(2 * F.atan(F.exp(psi)) - math.pi / 2)
    for _ in range(6):
        at = F.log(F.tan(lat / 2 + math.pi / 4) * F.pow((1 - k["e"] * F.sin(lat)) / (1 + k["e"] * F.sin(lat)), k["e"] / 2))
        lat = s.put(lat - (at - psi) * F.cos(lat) * (1 - k["e2"] * F.sin(lat) * F.sin(lat)) / (1 - k["e2"]))
    lat, lon = _geodetic(s, *_shifted(s, *_geocentric(s, lat, lon, BESSEL), 1), WGS84)
    return F.degrees(lon), F.degrees(lat)


def wgs84_to_rd(s: Steps, lon: Column, lat: Column) -> tuple[Column, Column]:
    k = _sphere()
    lat, lon = _geodetic(s, *_shifted(s, *_geocentric(s, F.radians(lat), F.radians(lon), WGS84), -1), BESSEL)
    sa, sb = (1 + F.sin(lat)) / (1 - F.sin(lat)), (1 - k["e"] * F.sin(lat)) / (1 + k["e"] * F.sin(lat))
    w = s.put(k["c"] * F.pow(sa * F.pow(sb, k["e"]), k["n"]))
    chi = s.put(F.asin((w - 1) / (w + 1)))
    d = s.put(k["n"] * (lon - k["lon"]))
    b = 1 + F.sin(chi) * math.sin(k["lat"]) + F.cos(chi) * math.cos(k["lat"]) * F.cos(d)
    b, m = s.put(b), 2 * k["R"] * RD_SCALE
    return RD_X + m * F.cos(chi) * F.sin(d) / b, RD_Y + m * (F.sin(chi) * math.cos(k["lat"]) - F.cos(chi) * math.sin(k["lat"]) * F.cos(d)) / b


@dataclass(frozen=True)
class System:
    """A projected system: its projection, ellipsoid, parameters (degrees and metres) and shift to WGS 84."""

    projection: str
    ellipsoid: tuple[float, float]
    lon: float = 0.0
    lat: float = 0.0
    scale: float = 1.0
    east: float = 0.0
    north: float = 0.0
    parallels: tuple[float, float] = (0.0, 0.0)
    shift: tuple[float, ...] | None = None
    south: bool = False


#: Ellipsoids (semi-major axis, inverse flattening).
GRS80, INTERNATIONAL, AIRY = (6378137.0, 298.257222101), (6378388.0, 297.0), (6377563.396, 299.3249646)
#: Shifts to WGS 84 as position vectors: metres, arc seconds, parts per million.
BELGE_72 = (-106.8686, 52.2978, -103.7239, 0.3366, -0.457, 1.8422, -1.2747)
OSGB_36 = (446.448, -125.157, 542.06, 0.15, 0.247, 0.842, -20.489)
DHDN = (598.1, 73.7, 418.2, 0.202, 0.045, -2.455, 6.7)
#: Projected systems by EPSG code.
SYSTEMS = {
    2154: System("conic", GRS80, 3, 46.5, east=700000, north=6600000, parallels=(49, 44)),
    3034: System("conic", GRS80, 10, 52, east=4000000, north=2800000, parallels=(35, 65)),
    3035: System("equal area", GRS80, 10, 52, east=4321000, north=3210000),
    3812: System("conic", GRS80, 4.359215833333333, 50.797815, east=649328, north=665262, parallels=(49.833333333333336, 51.166666666666664)),
    3857: System("web mercator", WGS84),
    27700: System("transverse", AIRY, -2, 49, 0.9996012717, 400000, -100000, shift=OSGB_36),
    31370: System("conic", INTERNATIONAL, 4.367486666666666, 90, east=150000.013, north=5400088.438, parallels=(51.16666723333333, 49.8333339), shift=BELGE_72),
}
#: Gauss-Krueger zones by code and central meridian; belts of the south-orientated system.
SYSTEMS |= {31464 + z: System("transverse", BESSEL, 3 * z, east=z * 1_000_000 + 500_000, shift=DHDN) for z in range(2, 6)}
SYSTEMS |= {2046 + i: System("transverse", WGS84, 15 + 2 * i, south=True) for i in range(10)}


def system_of(epsg: int) -> System | None:
    """A projected system's parameters; UTM zones north (326zz, 258zz) and south (327zz) by rule."""
    zone, family = epsg % 100, epsg // 100
    if family in (326, 327, 258) and 1 <= zone <= 60:
        return System("transverse", GRS80 if family == 258 else WGS84, 6 * zone - 183, 0, 0.9996, 500000, 10_000_000 if family == 327 else 0)
    return SYSTEMS.get(epsg)


def _eccentricity(ellipsoid: tuple[float, float]) -> float:
    f = 1 / ellipsoid[1]
    return math.sqrt(f * (2 - f))


def _krueger(ellipsoid: tuple[float, float]) -> tuple[float, list[float], list[float]]:
    """Radius of the meridian and the series of the transverse projection, to the fourth power of the flattening."""
    n = 1 / (2 * ellipsoid[1] - 1)
    radius = ellipsoid[0] / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    return radius, alpha, beta


def _from_conformal(s: Steps, psi: Column, e: float) -> Column:
    """The latitude of an isometric one."""
    lat = s.put(F.asin(F.tanh(psi)))
    for _ in range(6):
        lat = s.put(F.asin(F.tanh(psi + e * F.atanh(e * F.sin(lat)))))
    return lat


def _transverse(p: System) -> float:
    """Distance of the origin from the equator along the meridian, over the radius."""
    _, alpha, _ = _krueger(p.ellipsoid)
    e, phi = _eccentricity(p.ellipsoid), math.radians(p.lat)
    chi = math.atan(math.sinh(math.atanh(math.sin(phi)) - e * math.atanh(e * math.sin(phi)))) if p.lat else 0.0
    return chi + sum(a * math.sin(2 * (j + 1) * chi) for j, a in enumerate(alpha))


def to_transverse(s: Steps, lon: Column, lat: Column, p: System) -> tuple[Column, Column]:
    radius, alpha, _ = _krueger(p.ellipsoid)
    e = _eccentricity(p.ellipsoid)
    phi, lam = F.radians(lat), F.radians(lon - p.lon)
    t = s.put(F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi))))
    xi, eta = s.put(F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t)))
    east = eta + sum(a * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, a in enumerate(alpha))
    north = xi + sum(a * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, a in enumerate(alpha))
    x, y = p.scale * radius * east, p.scale * radius * (north - _transverse(p))
    return (p.east - x, p.north - y) if p.south else (p.east + x, p.north + y)


def from_transverse(s: Steps, x: Column, y: Column, p: System) -> tuple[Column, Column]:
    radius, _, beta = _krueger(p.ellipsoid)
    sign = -1 if p.south else 1
    xi, eta = s.put(sign * (y - p.north) / (p.scale * radius) + _transverse(p), sign * (x - p.east) / (p.scale * radius))
    xi_ = xi - sum(b * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, b in enumerate(beta))
    eta_ = eta - sum(b * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, b in enumerate(beta))
    xi_, eta_ = s.put(xi_, eta_)
    psi = s.put(F.atanh(F.sin(xi_) / F.cosh(eta_)))
    return F.degrees(F.atan2(F.sinh(eta_), F.cos(xi_))) + p.lon, F.degrees(_from_conformal(s, psi, _eccentricity(p.ellipsoid)))


def _conic(p: System) -> tuple[float, float, float]:
    """Exponent, radius at the equator, and radius at the origin of a conformal cone through two parallels."""
    e = _eccentricity(p.ellipsoid)
    iso = lambda d: math.exp(-(math.atanh(math.sin(math.radians(d))) - e * math.atanh(e * math.sin(math.radians(d))))) if d < 90 else 0.0
    wide = lambda d: math.cos(math.radians(d)) / math.sqrt(1 - e * e * math.sin(math.radians(d)) ** 2)
    a, b = p.parallels
    n = math.log(wide(a) / wide(b)) / math.log(iso(a) / iso(b))
    size = p.ellipsoid[0] * wide(a) / (n * iso(a) ** n)
    return n, size, size * iso(p.lat) ** n


def to_conic(s: Steps, lon: Column, lat: Column, p: System) -> tuple[Column, Column]:
    n, size, origin = _conic(p)
    e, sin = _eccentricity(p.ellipsoid), F.sin(F.radians(lat))
    r, angle = s.put(size * F.exp(-n * (F.atanh(sin) - e * F.atanh(e * sin))), n * F.radians(lon - p.lon))
    return p.east + r * F.sin(angle), p.north + origin - r * F.cos(angle)


def from_conic(s: Steps, x: Column, y: Column, p: System) -> tuple[Column, Column]:
    n, size, origin = _conic(p)
    dx, dy = s.put(x - p.east, origin - (y - p.north))
    psi = s.put(-F.log(F.sqrt(dx * dx + dy * dy) / size) / n)
    return F.degrees(F.atan2(dx, dy) / n) + p.lon, F.degrees(_from_conformal(s, psi, _eccentricity(p.ellipsoid)))


def _equal_area(p: System) -> tuple[float, float, float, float]:
    """q at the pole, radius of the sphere of equal area, authalic latitude of the origin, and the stretch there."""
    e, phi = _eccentricity(p.ellipsoid), math.radians(p.lat)
    q = lambda v: (1 - e * e) * (v / (1 - e * e * v * v) + math.atanh(e * v) / e)
    pole = q(1.0)
    radius, beta = p.ellipsoid[0] * math.sqrt(pole / 2), math.asin(q(math.sin(phi)) / pole)
    return pole, radius, beta, p.ellipsoid[0] * math.cos(phi) / math.sqrt(1 - (e * math.sin(phi)) ** 2) / (radius * math.cos(beta))


def to_equal_area(s: Steps, lon: Column, lat: Column, p: System) -> tuple[Column, Column]:
    pole, radius, b0, d = _equal_area(p)
    e, sin, lam = _eccentricity(p.ellipsoid), F.sin(F.radians(lat)), F.radians(lon - p.lon)
    b = s.put(F.asin((1 - e * e) * (sin / (1 - e * e * sin * sin) + F.atanh(e * sin) / e) / pole))
    size = s.put(radius * F.sqrt(2 / (1 + math.sin(b0) * F.sin(b) + math.cos(b0) * F.cos(b) * F.cos(lam))))
    return p.east + size * d * F.cos(b) * F.sin(lam), p.north + size / d * (math.cos(b0) * F.sin(b) - math.sin(b0) * F.cos(b) * F.cos(lam))


def from_equal_area(s: Steps, x: Column, y: Column, p: System) -> tuple[Column, Column]:
    _, radius, b0, d = _equal_area(p)
    dx, dy = s.put((x - p.east) / d, d * (y - p.north))
    rho = s.put(F.sqrt(dx * dx + dy * dy))
    c = s.put(2 * F.asin(rho / (2 * radius)))
    b = s.put(F.when(rho == 0, F.lit(b0)).otherwise(F.asin(F.cos(c) * math.sin(b0) + F.try_divide(dy * F.sin(c) * math.cos(b0), rho))))
    e, pole = _eccentricity(p.ellipsoid), _equal_area(p)[0]
    lat = b
    for _ in range(5):
        # Newton's step for q(lat) = sin(b) q(90).
        sin = F.sin(lat)
        w = 1 - e * e * sin * sin
        lat = s.put(lat + w * w / (2 * F.cos(lat)) * (F.sin(b) * pole / (1 - e * e) - sin / w - F.atanh(e * sin) / e))
    return F.degrees(F.atan2(dx * F.sin(c), rho * math.cos(b0) * F.cos(c) - dy * math.sin(b0) * F.sin(c))) + p.lon, F.degrees(lat)


def to_web_mercator(s: Steps, lon: Column, lat: Column, p: System) -> tuple[Column, Column]:
    return p.ellipsoid[0] * F.radians(lon), p.ellipsoid[0] * F.atanh(F.sin(F.radians(lat)))


def from_web_mercator(s: Steps, x: Column, y: Column, p: System) -> tuple[Column, Column]:
    return F.degrees(x / p.ellipsoid[0]), F.degrees(F.asin(F.tanh(y / p.ellipsoid[0])))


PROJECTIONS = {"transverse": (to_transverse, from_transverse), "conic": (to_conic, from_conic), "equal area": (to_equal_area, from_equal_area), "web mercator": (to_web_mercator, from_web_mercator)}


def transform(s: Steps, x: Column, y: Column, source: int, target: int) -> tuple[Column, Column]:
    """x, y (lon, lat for geographic systems) of EPSG source in EPSG target."""
    for epsg in (source, target):
        if epsg not in (28992, 4326, 4258) and system_of(epsg) is None:
            raise ValueError(f"EPSG:{epsg} is not supported; besides 28992, 4326, 4258 and UTM zones there are {', '.join(map(str, sorted(SYSTEMS)))}")
    if source == target:
        return x, y
    lon, lat = x, y
    if source == 28992:
        lon, lat = rd_to_wgs84(s, x, y)
    elif p := system_of(source):
        lon, lat = s.put(*PROJECTIONS[p.projection][1](s, x, y, p))
        if p.shift:
            lat, lon = _geodetic(s, *_shifted(s, *_geocentric(s, F.radians(lat), F.radians(lon), p.ellipsoid), 1, p.shift), WGS84)
            lon, lat = s.put(F.degrees(lon), F.degrees(lat))
    if target == 28992:
        return wgs84_to_rd(s, lon, lat)
    if p := system_of(target):
        if p.shift:
            lat, lon = _geodetic(s, *_shifted(s, *_geocentric(s, F.radians(lat), F.radians(lon), WGS84), -1, p.shift), p.ellipsoid)
            lon, lat = s.put(F.degrees(lon), F.degrees(lat))
        return PROJECTIONS[p.projection][0](s, lon, lat, p)
    return lon, lat


def transformed(df: DataFrame, x: Column, y: Column, source: int, target: int) -> tuple[DataFrame, Column, Column]:
    """df with named steps (``_step<i>``), and the columns x and y in another system made from them."""
    steps = Steps(df)
    x, y = steps.put(*transform(steps, x.cast("double"), y.cast("double"), source, target))
    return steps.df, x, y


def transform_coordinates(df: DataFrame, source: int, target: int, xbot: str | None = None, ybot: str | None = None) -> DataFrame:
    roles = Roles.of(df)
    roles.need("x", "y")
    made, steps = {}, Steps(df)
    for a, b in [(roles.x, roles.y)] + ([(xbot, ybot)] if xbot and ybot else []):
        made[a], made[b] = transform(steps, col(a).cast("double"), col(b).cast("double"), source, target)
    steps.df = steps.df.withColumns(made)
    return steps.done()
