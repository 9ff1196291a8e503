"""Places on the earth as column expressions: earth-centred coordinates and back, viewing angles, line-of-sight parallax.

Angles are degrees, lengths kilometres. ``flat`` = 0 is a sphere of radius ``axis``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The ellipsoid of WGS 84, and the height of a geostationary orbit.
AXIS, FLAT, ORBIT = 6378.137, 1 / 298.257223563, 35786.4


def _let(value: Column, made: Callable[[Column], Column]) -> Column:
    """``made`` of a value that is computed once: nested formulas would otherwise repeat it at every use."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def _vector(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def _angles(lon: Column, lat: Column) -> Column:
    """Sines and cosines of a place."""
    return F.struct(F.sin(F.radians(lon)).alias("so"), F.cos(F.radians(lon)).alias("co"), F.sin(F.radians(lat)).alias("sa"), F.cos(F.radians(lat)).alias("ca"))


def _centred(a: Column, height: Column, axis: float, flat: float) -> Column:
    e2 = flat * (2 - flat)
    n = F.lit(axis) / F.sqrt(1 - e2 * a["sa"] * a["sa"])
    return _vector((n + height) * a["ca"] * a["co"], (n + height) * a["ca"] * a["so"], (n * (1 - e2) + height) * a["sa"])


def earth_centred(lon: Column, lat: Column, height: Column, axis: float = AXIS, flat: float = FLAT) -> Column:
    """Struct (x, y, z) of a place: x to longitude 0, z to the north pole."""
    return _let(_angles(lon, lat), lambda a: _centred(a, height, axis, flat))


def geodetic(place: Column, axis: float = AXIS, flat: float = FLAT) -> Column:
    """Struct (lon, lat, height) of earth-centred coordinates, in closed form by the parametric latitude (one step, which is
    exact to far below a micrometre within hundreds of kilometres of the surface)."""
    e2, minor = flat * (2 - flat), axis * (1 - flat)

    def from_latitude(v: Column) -> Column:
        sine, cosine = F.sin(v["lat"]), F.cos(v["lat"])
        # The height along the normal, from both parts so that it holds at the equator and the poles.
        height = v["p"] * cosine + v["z"] * sine - axis * F.sqrt(1 - e2 * sine * sine)
        return F.struct(F.degrees(v["lon"]).alias("lon"), F.degrees(v["lat"]).alias("lat"), height.alias("height"))

    def from_parametric(v: Column) -> Column:
        lat = F.atan2(v["z"] + e2 / (1 - e2) * minor * F.pow(F.sin(v["t"]), 3), v["p"] - e2 * axis * F.pow(F.cos(v["t"]), 3))
        return _let(F.struct(v["lon"].alias("lon"), lat.alias("lat"), v["p"].alias("p"), v["z"].alias("z")), from_latitude)

    def from_place(v: Column) -> Column:
        p = F.sqrt(v["x"] * v["x"] + v["y"] * v["y"])
        return _let(F.struct(F.atan2(v["y"], v["x"]).alias("lon"), p.alias("p"), v["z"].alias("z"), F.atan2(v["z"] * axis, p * minor).alias("t")), from_parametric)

    return _let(place, from_place)


def _sight(lon: Column, lat: Column, satellite: Column, axis: float, flat: float, made: Callable[[Column], Column]) -> Column:
    """``made`` of a struct: the place on the ground (x, y, z), the vector to the satellite (dx, dy, dz), its length, and the sine of the elevation."""

    def with_sine(v: Column) -> Column:
        length = F.sqrt(v["dx"] * v["dx"] + v["dy"] * v["dy"] + v["dz"] * v["dz"])
        up = v["dx"] * v["a"]["ca"] * v["a"]["co"] + v["dy"] * v["a"]["ca"] * v["a"]["so"] + v["dz"] * v["a"]["sa"]
        names = ["x", "y", "z", "dx", "dy", "dz"]
        return _let(F.struct(*[v[c].alias(c) for c in names], length.alias("length"), (up / length).alias("sine")), made)

    def with_vector(v: Column) -> Column:
        parts = [v["g"][c].alias(c) for c in "xyz"] + [(v["s"][c] - v["g"][c]).alias(f"d{c}") for c in "xyz"]
        return _let(F.struct(v["a"].alias("a"), *parts), with_sine)

    return _let(_angles(lon, lat), lambda a: _let(F.struct(a.alias("a"), _centred(a, F.lit(0.0), axis, flat).alias("g"), satellite.alias("s")), with_vector))


def viewing_zenith(lon: Column, lat: Column, satellite: Column, axis: float = AXIS, flat: float = FLAT) -> Column:
    """Angle between the zenith of a place and the satellite, struct (x, y, z): 0 below it, over 90 where it has set."""
    return _sight(lon, lat, satellite, axis, flat, lambda v: F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v["sine"])))))


def line_of_sight(lon: Column, lat: Column, height: Column, satellite: Column, axis: float = AXIS, flat: float = FLAT) -> Column:
    """Struct (lon, lat): where a cloud top stands that is seen at a place on the ground. The place moves towards the satellite by
    height / sin(elevation). Null where the satellite is at or below the horizon; a null height counts as 0."""

    def top(v: Column) -> Column:
        step = F.coalesce(height, F.lit(0.0)) / v["sine"] / v["length"]
        moved = _vector(v["x"] + v["dx"] * step, v["y"] + v["dy"] * step, v["z"] + v["dz"] * step)
        place = _let(geodetic(moved, axis, flat), lambda g: F.struct(g["lon"].alias("lon"), g["lat"].alias("lat")))
        return F.when(v["sine"] > 0, place)

    return _sight(lon, lat, satellite, axis, flat, top)


def sighted(rows: DataFrame, lon: Column, lat: Column, height: Column, satellite: Column, axis: float = AXIS, flat: float = FLAT) -> DataFrame:
    """``rows`` with ``top_lon`` and ``top_lat``, those of ``line_of_sight``, null where that is null.

    For whole tables: each step is columns of its own (their names begin with ``_s``), which Spark compiles, while it interprets nested values.
    A filter on them would be pushed to the scan with all steps written out in it, many times over; so rows stay.
    """
    e2, minor = flat * (2 - flat), axis * (1 - flat)
    c = lambda name: F.col(f"_s{name}")
    step = lambda rows, **made: rows.withColumns({f"_s{k}": v for k, v in made.items()})
    a = {k: c(k) for k in ("so", "co", "sa", "ca")}
    place, angles = _centred(a, F.lit(0.0), axis, flat), _angles(lon, lat)
    out = step(rows, h=F.coalesce(height, F.lit(0.0)), **{k: angles[k] for k in a})
    out = step(out, **{k: place[k] for k in "xyz"})
    out = step(out, **{f"d{k}": satellite[k] - c(k) for k in "xyz"})
    out = step(out, length=F.sqrt(c("dx") * c("dx") + c("dy") * c("dy") + c("dz") * c("dz")))
    out = step(out, sine=(c("dx") * a["ca"] * a["co"] + c("dy") * a["ca"] * a["so"] + c("dz") * a["sa"]) / c("length"))
    out = step(out, step=c("h") / c("sine") / c("length"))
    out = step(out, **{k: c(k) + c(f"d{k}") * c("step") for k in "xyz"})
    out = step(out, p=F.sqrt(c("x") * c("x") + c("y") * c("y")))
    out = step(out, t=F.atan2(c("z") * axis, c("p") * minor))
    top = F.atan2(c("z") + e2 / (1 - e2) * minor * F.pow(F.sin(c("t")), 3), c("p") - e2 * axis * F.pow(F.cos(c("t")), 3))
    out = out.withColumns({"top_lon": F.when(c("sine") > 0, F.degrees(F.atan2(c("y"), c("x")))), "top_lat": F.when(c("sine") > 0, F.degrees(top))})
    return out.select(*[k for k in rows.columns if k not in ("top_lon", "top_lat")], "top_lon", "top_lat")


def satellite_at(lon: float, lat: float = 0.0, height: float = ORBIT, axis: float = AXIS, flat: float = FLAT) -> Column:
    """Struct (x, y, z) of a satellite above a place; a constant, so it is not computed again for each row."""
    return _centred(_angles(F.lit(float(lon)), F.lit(float(lat))), F.lit(float(height)), axis, flat)


def kilometres(height: Column, unit: Column) -> Column:
    """Heights in metres or kilometres as kilometres; null counts as 0, as clouds without a height stay where they are."""
    return F.coalesce(F.when(unit == "m", height * 1e-3).otherwise(height), F.lit(0.0))
