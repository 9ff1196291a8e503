"""Queries over strokes, runs and times."""

from pyspark.sql import functions as F

from gridloom.operators import points as P
from gridloom.plans import fixtures as X

_S = X.SQL_STROKES
_CELLS = "cells AS (SELECT s // {k} AS slot, i, j, count(*) AS n, count(*) FILTER (intra = 'IC') AS ic, count(*) FILTER (intra = 'CG') AS cg, round(sum(abs(current)), 4) AS abs_current, round(coalesce(sum(current) FILTER (current < 0), 0), 4) AS neg_current, round(coalesce(sum(current) FILTER (current > 0), 0), 4) AS pos_current FROM strokes {w} GROUP BY ALL)"


def _slots(s, d, seconds):
    return X.strokes(s, d).select((F.floor(F.col("s") / seconds) * seconds).alias("slot_s")).distinct()


def _requests(s, d):
    return X.table(s, d, "orders").select(F.col("o_orderkey").alias("rid"), (X_START + F.col("o_orderkey") * 97 % 2_592_000).alias("t"))


X_START = 1_704_067_200  # first second of the events


def _frames(s, d):
    return X.strokes(s, d).select(F.col("id").alias("fid"), F.col("s").alias("ft"))


_REQ = f"req AS (SELECT o_orderkey AS rid, {X_START} + o_orderkey * 97 % 2592000 AS t FROM orders), fr AS (SELECT id AS fid, s AS ft FROM strokes)"


def _known(s, d):
    """Hourly largest value of each user group as frames known every 4 hours."""
    return X.strokes(s, d).groupBy((F.col("j") % 10).alias("g"), (F.floor(F.col("s") / 14400) * 4).alias("t")).agg(F.max("current").alias("v"))


QUERIES = {
    "grid_strokes": (lambda s, d: P.grid_strokes(X.strokes(s, d), 3600), f"WITH {_S}, {_CELLS.format(k=3600, w='')} SELECT * FROM cells"),
    "grid_strokes_inner": (lambda s, d: P.grid_strokes(X.strokes(s, d), 300, False), f"WITH {_S}, {_CELLS.format(k=300, w='WHERE i > 0 AND j > 0')} SELECT * FROM cells"),
    "current_per_stroke": (lambda s, d: P.current_per_stroke(P.grid_strokes(X.strokes(s, d), 86400)), f"WITH {_S}, {_CELLS.format(k=86400, w='')} SELECT slot, i, j, round(abs_current / n, 4) AS current_per_stroke FROM cells"),
    "splat": (
        lambda s, d: P.splat(X.strokes(s, d), F.col("i") * F.lit(0.7), F.col("j") * F.lit(0.3), F.abs("current")),
        f"WITH {_S}, p AS (SELECT i * 0.7::DOUBLE AS y, j * 0.3::DOUBLE AS x, abs(current) AS e FROM strokes), c AS (SELECT CAST(floor(y) AS BIGINT) + a AS i, CAST(floor(x) AS BIGINT) + b AS j, (CASE a WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE b WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS w, e FROM p, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b)) SELECT i, j, round(sum(w), 6) AS density, round(sum(w * e), 4) AS energy FROM c WHERE w > 0 GROUP BY ALL",
    ),
    "slot_join": (lambda s, d: P.slot_join(X.strokes(s, d), _slots(s, d, 900), 900), f"WITH {_S}, sl AS (SELECT DISTINCT s // 900 * 900 AS slot_s FROM strokes) SELECT id, slot_s FROM strokes JOIN sl ON s < slot_s AND slot_s - s < 900"),
    "nearest_in_time": (lambda s, d: P.nearest_in_time(_requests(s, d), _frames(s, d), 480), f"WITH {_S}, {_REQ}, n AS (SELECT rid, fid, abs(t - ft) AS dt FROM req JOIN fr ON ft BETWEEN t - 480 AND t + 480 QUALIFY row_number() OVER (PARTITION BY rid ORDER BY abs(t - ft), ft, fid) = 1) SELECT rid, fid, dt FROM req LEFT JOIN n USING (rid)"),
    "latest_before": (lambda s, d: P.latest_before(_requests(s, d), _frames(s, d), 1800), f"WITH {_S}, {_REQ}, n AS (SELECT rid, fid FROM req JOIN fr ON ft >= t - 1800 AND ft < t QUALIFY row_number() OVER (PARTITION BY rid ORDER BY ft DESC, fid DESC) = 1) SELECT rid, fid FROM req LEFT JOIN n USING (rid)"),
    "shortest_lead": (lambda s, d: P.shortest_lead(X.runs(s, d), X.valid_days(s, d)).withColumn("day", F.col("day").cast("long")).withColumn("lead", F.col("lead").cast("long")), f"WITH {X.SQL_RUNS} SELECT day, run_id, day - start_day AS lead FROM days JOIN runs ON day BETWEEN start_day AND end_day QUALIFY row_number() OVER (PARTITION BY day ORDER BY day - start_day, run_id) = 1"),
    "interpolate": (
        lambda s, d: P.interpolate(_known(s, d), 4, ["g"]),
        f"WITH {_S}, k AS (SELECT j % 10 AS g, s // 14400 * 4 AS t, max(current) AS v FROM strokes GROUP BY ALL), n AS (SELECT k.g, k.t, k.v, b.v AS v1, dt FROM k LEFT JOIN k b ON b.g = k.g AND b.t = k.t + 4, (SELECT unnest([0, 1, 2, 3]) AS dt)) SELECT g, t + dt AS t, round(CASE dt WHEN 0 THEN v ELSE (1 - dt / 4::DOUBLE) * v + dt / 4::DOUBLE * v1 END, 6) AS linear, CASE WHEN dt < 2 THEN v ELSE v1 END AS nearest FROM n",
    ),
    "persistence": (lambda s, d: P.persistence(X.strokes(s, d).select(F.col("j").alias("key"), F.col("s").alias("t"), "id", F.col("current").alias("v")), 3), f"WITH {_S}, l AS (SELECT j AS key, current AS v FROM strokes QUALIFY row_number() OVER (PARTITION BY j ORDER BY s DESC, id DESC) = 1) SELECT key, CAST(lead AS INT) AS lead, v FROM l, (SELECT unnest([1, 2, 3]) AS lead)"),
    "latitude_bands": (lambda s, d: P.latitude_bands(X.strokes(s, d).withColumn("lat", F.col("lat").cast("double")), "lat", "current", 10), f"WITH {_S}, m AS (SELECT min(lat::DOUBLE) AS lo, max(lat::DOUBLE) AS hi FROM strokes) SELECT CAST(greatest(0, least(9, ceil((lat::DOUBLE - lo) / ((hi - lo) / 10) - 1e-9) - 1)) AS INT) AS bin, count(*) AS n, round(avg(current), 6) AS mean, round(stddev_samp(current), 6) AS std, min(current) AS min, max(current) AS max FROM strokes, m GROUP BY 1"),
    "coordinate_spacing": (lambda s, d: P.consecutive(X.pixels(s, d).select("frame", "i"), "frame", ["i"]), f"WITH {X.SQL_PIXELS}, u AS (SELECT DISTINCT frame, i FROM pixels), t AS (SELECT frame, i - lag(i) OVER (PARTITION BY frame ORDER BY i) AS step FROM u), f AS (SELECT * FROM t WHERE step IS NOT NULL), n AS (SELECT frame, step, count(*) AS n FROM f GROUP BY ALL), m AS (SELECT frame, step AS dominant FROM n QUALIFY row_number() OVER (PARTITION BY frame ORDER BY n DESC, step) = 1) SELECT frame, median(step) AS median, any_value(dominant) AS dominant FROM f JOIN m USING (frame) GROUP BY frame"),
}
