"""Reference systems against points that their publishers give, which share no number with the library's own code."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from stratalake.functions import crs

POINTS = "nr string, x double, y double"


def dms(d, m=0, s=0.0):
    return (abs(d) + m / 60 + s / 3600) * (-1 if d < 0 else 1)


def moved(spark, x, y, source, target):
    r = crs.transform_coordinates(spark.createDataFrame([("a", float(x), float(y))], POINTS), source, target).first()
    return r.x, r.y


def projected(spark, system, lon, lat):
    """A projection alone, without a shift of the datum, and back."""
    steps = crs.Steps(spark.createDataFrame([(float(lon), float(lat))], "x double, y double"))
    to, back = crs.PROJECTIONS[system.projection]
    there = steps.put(*to(steps, F.col("x"), F.col("y"), system))
    again = steps.put(*back(steps, *there, system))
    r = steps.df.select(*[c.alias(n) for c, n in zip((*there, *again), "abcd")]).first()
    assert (r.c, r.d) == pytest.approx((lon, lat), abs=1e-9)
    return r.a, r.b


#: Worked examples of the public guidance on coordinate conversions (IOGP 7-2).
EXAMPLES = [
    (crs.SYSTEMS[27700], dms(0, 30), dms(50, 30), 577274.99, 69740.50),
    (crs.SYSTEMS[3035], 5, 50, 3962799.45, 2999718.85),
    (crs.SYSTEMS[3857], -dms(100, 20), dms(24, 22, 54.433), -11169055.58, 2800000.00),
    (crs.SYSTEMS[2053], dms(28, 16, 57.479), -dms(25, 43, 55.302), 71984.49, 2847342.74),
    # The same grid as 31370, with parallels and a turn of 29.2985 seconds as its first edition gives them.
    (crs.System("conic", crs.INTERNATIONAL, dms(4, 21, 24.983) + dms(0, 0, 29.2985) / 0.7716421867, 90, east=150000.01, north=5400088.44, parallels=(dms(49, 50), dms(51, 10))), dms(5, 48, 26.533), dms(50, 40, 46.461), 251763.20, 153034.13),
]


@pytest.mark.parametrize(("system", "lon", "lat", "east", "north"), EXAMPLES)
def test_published_examples(spark, system, lon, lat, east, north):
    assert projected(spark, system, lon, lat) == pytest.approx((east, north), abs=0.011)


def test_the_belgian_grid_of_today(spark):
    assert projected(spark, crs.SYSTEMS[31370], dms(5, 48, 26.533), dms(50, 40, 46.461)) == pytest.approx((251763.20, 153034.13), abs=0.06)


def test_conic_in_feet(spark):
    foot = 0.3048006096012192
    system = crs.System("conic", (6378206.4, 294.9786982), -99, dms(27, 50), east=2_000_000 * foot, parallels=(dms(28, 23), dms(30, 17)))
    x, y = projected(spark, system, -96, dms(28, 30))
    assert (x / foot, y / foot) == pytest.approx((2963503.91, 254759.80), abs=0.011)


def test_origins_and_zones(spark):
    assert moved(spark, 3, 46.5, 4326, 2154) == pytest.approx((700000, 6600000), abs=1e-6)
    assert moved(spark, 10, 52, 4258, 3035) == pytest.approx((4321000, 3210000), abs=1e-6)
    assert moved(spark, 4321000, 3210000, 3035, 4258) == pytest.approx((10, 52), abs=1e-11)
    assert moved(spark, 3, 0, 4326, 32631) == pytest.approx((500000, 0), abs=1e-6)
    assert moved(spark, 3, 0, 4326, 32731) == pytest.approx((500000, 10_000_000), abs=1e-6)
    north, south = moved(spark, 5, 40, 4326, 32631), moved(spark, 5, -40, 4326, 32731)
    assert north[0] == pytest.approx(south[0], abs=1e-6) and north[1] == pytest.approx(10_000_000 - south[1], abs=1e-6)
    assert crs.SYSTEMS[31466].lon == 6 and crs.SYSTEMS[31469].east == 5_500_000


def meridian(lat, ellipsoid):
    """Length of the meridian from the equator by plain summation of its radius of curvature."""
    import math

    f = 1 / ellipsoid[1]
    e2, n = f * (2 - f), 20_000
    step = math.radians(lat) / n
    radius = lambda p: ellipsoid[0] * (1 - e2) / (1 - e2 * math.sin(p) ** 2) ** 1.5
    return sum(radius((i + 0.5) * step) for i in range(n)) * step


@pytest.mark.parametrize("lat", [1, 20, 52, 83])
def test_northings_of_utm_to_a_millimetre(spark, lat):
    assert moved(spark, 3, lat, 4326, 32631) == pytest.approx((500000, 0.9996 * meridian(lat, crs.WGS84)), abs=1e-3)


@pytest.mark.parametrize("epsg", [2154, 3034, 3035, 3812, 3857, 27700, 31370, 31466, 31467, 32631, 32733, 25832, 2053, 28992])
def test_there_and_back(spark, epsg):
    lon, lat = {27700: (-1.5, 53.0), 31467: (9.2, 50.0), 2053: (29.5, -26.0), 32733: (15.5, -20.0), 25832: (9.5, 51.0)}.get(epsg, (5.3, 51.2))
    x, y = moved(spark, lon, lat, 4326, epsg)
    assert moved(spark, x, y, epsg, 4326) == pytest.approx((lon, lat), abs=2e-8)


def test_shift_of_the_datum(spark):
    """The published shift moves Belge 1972 by about a hundred metres; the grid alone would be off by as much."""
    system = crs.SYSTEMS[31370]
    bare = projected(spark, dataclasses.replace(system, shift=None), 4.35, 50.85)
    full = moved(spark, 4.35, 50.85, 4326, 31370)
    assert 50 < abs(bare[0] - full[0]) + abs(bare[1] - full[1]) < 300


def test_unknown_systems_and_nulls(spark):
    with pytest.raises(ValueError, match="31370"):
        crs.transform_coordinates(spark.createDataFrame([("a", 1.0, 2.0)], POINTS), 28992, 9999)
    df = spark.createDataFrame([("a", None, 2.0)], POINTS)
    r = crs.transform_coordinates(df, 28992, 3035).first()
    assert r.x is None and r.y is None
