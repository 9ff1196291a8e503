"""Queries over viewing angles and line-of-sight parallax."""

from pyspark.sql import functions as F

from gridloom.functions import geodesy as E
from gridloom.operators import geometry as G
from gridloom.plans import fixtures as X

r6 = lambda c: F.round(c, 6)
_LON, _X0, _Y0, _SIZE = 0.0, 20.0, 48.5, 0.1
_AXIS, _E2 = E.AXIS, E.FLAT * (2 - E.FLAT)
_MINOR = E.AXIS * (1 - E.FLAT)


def _sql_top(source, lon, lat, height):
    """CTEs from ``source`` to ``top``: each row with the sine of the elevation and the place of the cloud top."""
    return f"""q0 AS (SELECT *, radians({lon}) AS lo, radians({lat}) AS la, {height} AS hh FROM {source}),
q1 AS (SELECT *, {_AXIS}::DOUBLE / sqrt(1 - {_E2}::DOUBLE * sin(la) * sin(la)) AS n FROM q0),
q2 AS (SELECT *, n * cos(la) * cos(lo) AS gx, n * cos(la) * sin(lo) AS gy, n * (1 - {_E2}::DOUBLE) * sin(la) AS gz FROM q1),
q3 AS (SELECT *, {_AXIS + E.ORBIT}::DOUBLE * cos(radians({_LON})) - gx AS dx, {_AXIS + E.ORBIT}::DOUBLE * sin(radians({_LON})) - gy AS dy, 0 - gz AS dz FROM q2),
q4 AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS len FROM q3),
q5 AS (SELECT *, (dx * cos(la) * cos(lo) + dy * cos(la) * sin(lo) + dz * sin(la)) / len AS sine FROM q4),
q6 AS (SELECT *, gx + dx * hh / sine / len AS tx, gy + dy * hh / sine / len AS ty, gz + dz * hh / sine / len AS tz FROM q5),
q7 AS (SELECT *, sqrt(tx * tx + ty * ty) AS p, atan2(tz * {_AXIS}, sqrt(tx * tx + ty * ty) * {_MINOR}) AS u FROM q6),
top AS (SELECT *, degrees(atan2(ty, tx)) AS top_lon, degrees(atan2(tz + {_E2 / (1 - _E2) * _MINOR}::DOUBLE * pow(sin(u), 3), p - {_E2 * _AXIS}::DOUBLE * pow(cos(u), 3))) AS top_lat FROM q7)"""


def _tops(s, d):
    rows = X.strokes(s, d).select("id", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"), (F.abs("current") / 10).alias("height"))
    sat = E.satellite_at(_LON)
    top = E.line_of_sight(F.col("lon"), F.col("lat"), F.col("height"), sat)
    return rows.select("id", r6(E.viewing_zenith(F.col("lon"), F.col("lat"), sat)).alias("zenith"), r6(top["lon"]).alias("lon"), r6(top["lat"]).alias("lat"))


def _round_trip(s, d):
    """How far places come back from earth-centred coordinates, over the whole globe."""
    rows = X.table(s, d, "lineitem").select((F.col("l_partkey") % 360 - 180).cast("double").alias("lon"), (F.col("l_suppkey") * 7 % 181 - 90).cast("double").alias("lat"), (F.col("l_quantity").cast("double") / 2).alias("h"))
    back = E.geodetic(E.earth_centred(F.col("lon"), F.col("lat"), F.col("h")))
    turn = F.when(F.abs("lat") == 90, 0.0).otherwise(F.abs(F.sin(F.radians(back["lon"] - F.col("lon")) / 2)))
    return rows.select(turn.alias("a"), F.abs(back["lat"] - F.col("lat")).alias("b"), F.abs(back["height"] - F.col("h")).alias("c")).agg(F.count(F.lit(1)).alias("n"), *[(F.max(c) < 1e-7).alias(f"{c}_close") for c in "abc"])


def _visible(s, d):
    """Patches of 4 x 4 degrees of a disc, by number; half of the globe is out of sight."""
    rows = X.table(s, d, "orders").select((F.col("o_orderkey") % 45).alias("row"), (F.col("o_custkey") % 90).alias("col")).distinct()
    edge = lambda c, k, low: (F.col(c) + k) * 4.0 + low
    corners = [(edge("col", a, -180.0), edge("row", b, -90.0)) for a in (0, 1) for b in (0, 1)]
    return G.visible_patches(rows, corners, E.satellite_at(_LON))


def _sql_zenith(lon, lat):
    n = f"({_AXIS}::DOUBLE / sqrt(1 - {_E2}::DOUBLE * pow(sin(radians({lat})), 2)))"
    g = [f"{n} * cos(radians({lat})) * cos(radians({lon}))", f"{n} * cos(radians({lat})) * sin(radians({lon}))", f"{n} * (1 - {_E2}::DOUBLE) * sin(radians({lat}))"]
    d = [f"({_AXIS + E.ORBIT}::DOUBLE - {g[0]})", f"(0 - {g[1]})", f"(0 - {g[2]})"]
    up = [f"cos(radians({lat})) * cos(radians({lon}))", f"cos(radians({lat})) * sin(radians({lon}))", f"sin(radians({lat}))"]
    return f"degrees(acos(({' + '.join(f'{x} * {y}' for x, y in zip(d, up))}) / sqrt({' + '.join(f'{x} * {x}' for x in d)})))"


def _heights(s, d):
    return X.pixels(s, d).select("frame", "i", "j", (F.col("v") / 5).alias("v"))


def _points(s, d):
    points = X.strokes(s, d).select("id", F.floor(F.col("id") / 4000).alias("frame"), (F.col("lon") + 0.03).cast("double").alias("lon"), (F.col("lat") + 0.04).cast("double").alias("lat"))
    return G.corrected_points(points, _heights(s, d), E.satellite_at(_LON), _X0, _Y0, _SIZE).select("id", r6("lon").alias("lon"), r6("lat").alias("lat"))


def _grid(s, d):
    moved = G.corrected_pixels(_heights(s, d), E.satellite_at(_LON), _X0, _Y0, _SIZE)
    return G.relocate(moved, 1, 0.8).select("frame", "i", "j", F.round("si", 5).alias("si"), F.round("sj", 5).alias("sj"))


_BI = f"""pts AS (SELECT id, id // 4000 AS frame, (lon + 0.03)::DOUBLE AS lon, (lat + 0.04)::DOUBLE AS lat FROM strokes),
loc AS (SELECT *, ({_Y0} - lat) / {_SIZE}::DOUBLE AS y, (lon - {_X0}) / {_SIZE}::DOUBLE AS x FROM pts),
c AS (SELECT loc.*, p.v / 5 AS v, (CASE a WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE b WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS w FROM loc, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b), pixels p WHERE p.frame = loc.frame AND p.i = CAST(floor(y) AS BIGINT) + a AND p.j = CAST(floor(x) AS BIGINT) + b),
b AS (SELECT id, any_value(lon) AS lon, any_value(lat) AS lat, round(sum(w * v), 6) AS h FROM c GROUP BY id HAVING count(*) = 4)"""
_NEAR = "t AS (SELECT frame, pi, pj, y, x, CAST(floor(y + 0.5) AS BIGINT) + a AS i, CAST(floor(x + 0.5) AS BIGINT) + b AS j FROM m, (SELECT unnest([-1, 0, 1]) AS a), (SELECT unnest([-1, 0, 1]) AS b)), w AS (SELECT *, exp(-(pow(i - y, 2) + pow(j - x, 2)) / (2 * 0.8 * 0.8)::DOUBLE) AS w FROM t)"
QUERIES = {
    "line_of_sight": (_tops, f"WITH {X.SQL_STROKES}, {_sql_top('strokes', 'lon::DOUBLE', 'lat::DOUBLE', 'abs(current) / 10')} SELECT id, round(degrees(acos(sine)), 6) AS zenith, round(top_lon, 6) AS lon, round(top_lat, 6) AS lat FROM top"),
    "geodetic_round_trip": (_round_trip, "SELECT count(*) AS n, true AS a_close, true AS b_close, true AS c_close FROM lineitem"),
    "visible_patches": (_visible, "WITH r AS (SELECT DISTINCT o_orderkey % 45 AS row, o_custkey % 90 AS col FROM orders) SELECT row, col FROM r WHERE " + " AND ".join(f"{_sql_zenith(f'((col + {a}) * 4.0 - 180)::DOUBLE', f'((row + {b}) * 4.0 - 90)::DOUBLE')} < 75" for a in (0, 1) for b in (0, 1))),
    "corrected_points": (_points, f"WITH {X.SQL_STROKES}, {X.SQL_PIXELS}, {_BI}, {_sql_top('b', 'lon', 'lat', 'h')} SELECT pts.id, round(top_lon, 6) AS lon, round(top_lat, 6) AS lat FROM pts LEFT JOIN top USING (id)"),
    "sight_grid": (
        _grid,
        f"WITH {X.SQL_PIXELS}, {_sql_top('pixels', f'({_X0} + j * {_SIZE}::DOUBLE)', f'({_Y0} - i * {_SIZE}::DOUBLE)', 'v / 5')}, m AS (SELECT frame, i AS pi, j AS pj, ({_Y0} - top_lat) / {_SIZE}::DOUBLE AS y, (top_lon - {_X0}) / {_SIZE}::DOUBLE AS x FROM top), {_NEAR} SELECT frame, i, j, round(sum(w * pi) / sum(w), 5) AS si, round(sum(w * pj) / sum(w), 5) AS sj FROM w GROUP BY ALL",
    ),
}
