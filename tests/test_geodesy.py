"""Earth-centred coordinates, viewing angles and line-of-sight shifts."""

import math

import pytest
from pyspark.sql import functions as F

from gridloom.functions import geodesy as E


def places(spark):
    rows = [(lon, lat, h) for lon in (-180.0, -90.0, -1.5, 0.0, 45.0, 179.9) for lat in (-90.0, -89.999, -45.0, -0.001, 0.0, 30.0, 75.5, 90.0) for h in (0.0, 0.5, 18.0, 400.0)]
    return spark.createDataFrame(rows, "lon double, lat double, h double")


@pytest.mark.parametrize("flat", [0.0, E.FLAT])
def test_round_trip(spark, flat):
    back = E.geodetic(E.earth_centred(F.col("lon"), F.col("lat"), F.col("h"), flat=flat), flat=flat)
    for r in places(spark).select("*", back.alias("b")).collect():
        assert abs(r.b.lat - r.lat) < 1e-6 and abs(r.b.height - r.h) < 1e-6
        if abs(r.lat) < 90:
            assert abs(math.sin(math.radians(r.b.lon - r.lon) / 2)) < 1e-9


def test_known_places_and_angles(spark):
    sat = E.satellite_at(9.5)
    rows = spark.createDataFrame([(9.5, 0.0), (9.5, 81.0), (9.5, 82.0), (-170.5, 0.0), (45.0, 45.0)], "lon double, lat double")
    zenith = [r[0] for r in rows.select(E.viewing_zenith(F.col("lon"), F.col("lat"), sat)).collect()]
    assert zenith[0] == pytest.approx(0, abs=1e-5) and zenith[1] < 90 < zenith[2] and zenith[3] == pytest.approx(180, abs=1e-4)
    one = spark.range(1).select(E.earth_centred(F.lit(0.0), F.lit(45.0), F.lit(0.0)).alias("p")).first().p
    assert (round(one.x, 3), round(one.y, 3), round(one.z, 3)) == (4517.591, 0.0, 4487.348)  # known values of the ellipsoid


def test_shift_goes_towards_the_satellite_and_keeps_the_line(spark):
    """The shifted place at its height, the ground place and the satellite lie on one line (up to the curve of the earth)."""
    sat, at = E.satellite_at(0.0), (25.0, 46.0)
    rows = spark.createDataFrame([(*at, 10.0), (*at, 0.0), (*at, None), (0.0, 0.0, 12.0), (180.0, 10.0, 5.0)], "lon double, lat double, h double")
    got = [r.s for r in rows.select(E.line_of_sight(F.col("lon"), F.col("lat"), F.col("h"), sat).alias("s")).collect()]
    assert got[0].lat < 46 and got[0].lon < 25 and got[4] is None
    for same, want in ((got[1], at), (got[2], at), (got[3], (0.0, 0.0))):
        assert (same.lon, same.lat) == pytest.approx(want, abs=1e-9)
    vectors = spark.range(1).select(E.earth_centred(F.lit(at[0]), F.lit(at[1]), F.lit(0.0)).alias("g"), E.earth_centred(F.lit(got[0].lon), F.lit(got[0].lat), F.lit(10.0)).alias("t"), sat.alias("s")).first()
    g, t, s = ([v[c] for c in "xyz"] for v in vectors)
    a, b = [x - y for x, y in zip(t, g)], [x - y for x, y in zip(s, g)]
    norm = lambda v: math.sqrt(sum(x * x for x in v))
    assert sum(x * y for x, y in zip(a, b)) / norm(a) / norm(b) > 1 - 1e-6


def test_heights_in_metres(spark):
    rows = spark.createDataFrame([(9000.0, "m"), (9.0, "km"), (None, "m"), (3.0, None)], "h double, unit string")
    assert [r[0] for r in rows.select(E.kilometres(F.col("h"), F.col("unit"))).collect()] == [9.0, 9.0, 0.0, 3.0]
