"""Queries over fields, geometry, ensembles and summaries."""

from pyspark.sql import functions as F

from gridloom.functions.draws import drawn_sql
from gridloom.operators import fields as D
from gridloom.operators import grid as G
from gridloom.operators import verify as V
from gridloom.plans import fixtures as X
from gridloom.plans import verification as W

_S, _P, _PX = X.SQL_STROKES, X.SQL_PREDICTIONS, X.SQL_PIXELS
_NAN = "CASE WHEN id % 7 = 0 THEN 'NaN'::DOUBLE WHEN id % 11 = 0 THEN -9999000 ELSE current END"


def _dirty(s, d):
    v = F.when(F.col("id") % 7 == 0, float("nan")).when(F.col("id") % 11 == 0, -9999000.0).otherwise(F.col("current"))
    return X.strokes(s, d).select("id", "j", v.alias("v"))


def _columns(s, d):
    rows = X.table(s, d, "lineitem")
    return rows.select(F.col("l_orderkey").alias("c"), F.col("l_linenumber").alias("level"), F.col("l_quantity").cast("double").alias("z"))


def _models(s, d):
    p = X.predictions(s, d)
    return p.select("id", F.lit("a").alias("model"), F.col("y_pred").alias("p")).union(p.select("id", F.lit("b"), F.sqrt("y_pred"))).union(p.select("id", F.lit("c"), F.pow("y_pred", F.lit(2))))


def _pairs(s, d):
    return X.predictions(s, d).select("lead", F.col("y_true").alias("y"), F.col("y_pred").alias("student"), F.sqrt("y_pred").alias("teacher"))


def _sweep(s, d, odd):
    return V.confusion_sweep(X.predictions(s, d).where(F.col("id") % 2 == odd), 100, ["lead"])


def _points(s, d, k, a, b):
    name, key = ("customer", "c_custkey") if k == "s" else ("part", "p_partkey")
    return X.table(s, d, name).select(F.col(key).alias("tid"), ((F.col(key) * a % 1000) / 10).alias("x"), ((F.col(key) * b % 777) / 10).alias("y"), (F.col(key) % 50).cast("double").alias("v"))


def _half_sql(odd, name):
    base = W._sweep_sql(100).replace("both_ AS (SELECT lead, y_true, y_pred FROM predictions UNION ALL SELECT 0, y_true, y_pred FROM predictions)", f"both_ AS (SELECT lead, y_true, y_pred FROM predictions WHERE id % 2 = {odd})")
    return f"{name} AS ({base} SELECT lead, k, tp::DOUBLE AS tp, fp::DOUBLE AS fp, fn::DOUBLE AS fn, tn::DOUBLE AS tn FROM sweep)"


_CL = "greatest(1e-7, least(1 - 1e-7, {0}))"
_LG = "ln({0} / (1 - {0}))"
_ST, _TE = _CL.format("y_pred"), _CL.format("sqrt(y_pred)")
def _seen(s, d):
    """All steps of the time that the events cover, whether active or not."""
    return X.patch_active(s, d, 5).agg(F.explode(F.sequence(F.min("slot"), F.max("slot"))).alias("slot"))


QUERIES = {
    "clean_sentinel": (lambda s, d: _dirty(s, d).select("id", D.clean_sentinel(F.col("v"), -9999000.0, 0.12619).alias("v")), f"WITH {_S}, q AS (SELECT id, {_NAN} AS v FROM strokes) SELECT id, CASE WHEN isnan(v) OR v = -9999000 THEN NULL WHEN v < 0.12619 THEN 0 ELSE v END AS v FROM q"),
    "fill_with_minimum": (lambda s, d: D.fill_with_minimum(_dirty(s, d), ["j"], "v"), f"WITH {_S}, q AS (SELECT id, j, {_NAN} AS v FROM strokes), m AS (SELECT j, min(v) FILTER (NOT isnan(v)) AS m FROM q GROUP BY j) SELECT id, j, CASE WHEN isnan(v) THEN m ELSE v END AS v FROM q JOIN m USING (j)"),
    "finite_degrees": (lambda s, d: _dirty(s, d).select("id", D.finite_degrees(F.col("v"), 90.0).alias("lat"), D.finite_values(F.col("v")).alias("v")), f"WITH {_S}, q AS (SELECT id, {_NAN} AS v FROM strokes) SELECT id, CASE WHEN isnan(v) THEN 0 ELSE greatest(-90, least(90, v)) END::DOUBLE AS lat, CASE WHEN isnan(v) THEN 0 ELSE v END AS v FROM q"),
    "sun_corrected": (lambda s, d: X.strokes(s, d).select("id", F.round(D.sun_corrected(F.col("current"), F.col("j") / 100, 0.1736), 6).alias("v")), f"WITH {_S} SELECT id, round(CASE WHEN j / 100::DOUBLE > 0.1736 THEN current / (j / 100::DOUBLE) ELSE 0 END, 6) AS v FROM strokes"),
    "height_fixed": (lambda s, d: X.strokes(s, d).select("id", F.round(D.height_fixed(F.col("s"), 1_705_000_000, F.col("current"), F.when(F.col("i") > 5, F.col("i") / 8)), 6).alias("h")), f"WITH {_S} SELECT id, round(CASE WHEN s < 1705000000 THEN current - CASE WHEN i > 5 THEN i / 8::DOUBLE ELSE 0 END ELSE current END, 6) AS h FROM strokes"),
    "select_predictors": (lambda s, d: D.select_predictors(X.strokes(s, d).select(F.col("id").alias("pos"), F.concat("intra", F.lit("-"), F.col("i").cast("string")).alias("pred")), s.createDataFrame([("IC",), ("CG-7",), ("C",)], "var string")), f"WITH {_S} SELECT id AS pos, intra || '-' || i AS pred FROM strokes WHERE intra = 'IC' OR i = 7"),
    "all_valid": (lambda s, d: D.all_valid(X.pixels(s, d).withColumn("patch_id", G.patch_id(F.col("i"), F.col("j"), 2, 96)), ["frame", "patch_id"], 4), f"WITH {_PX} SELECT frame, (i // 2) * 96 + j // 2 + 1 AS patch_id FROM pixels GROUP BY ALL HAVING count(*) = 4"),
    "box_quality": (lambda s, d: D.box_quality(X.strokes(s, d).select("i", "j", "intra", F.when(F.col("id") % 9 > 0, F.col("id") % 13).alias("k")), ["i", "j", "intra", "k"]), f"WITH {_S}, b AS (SELECT i, j, intra, CASE WHEN id % 9 > 0 THEN id % 13 END AS k FROM strokes) SELECT count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM b)) AS different, count(*) FILTER (k IS NULL) AS incomplete FROM b"),
    "gaussian_resample": (lambda s, d: D.gaussian_resample(_points(s, d, "t", 53, 29), _points(s, d, "s", 37, 91), 2.5, 5.0), "WITH t AS (SELECT p_partkey AS tid, (p_partkey * 53 % 1000) / 10::DOUBLE AS x, (p_partkey * 29 % 777) / 10::DOUBLE AS y FROM part), s AS (SELECT (c_custkey * 37 % 1000) / 10::DOUBLE AS x, (c_custkey * 91 % 777) / 10::DOUBLE AS y, (c_custkey % 50)::DOUBLE AS v FROM customer), p AS (SELECT tid, v, pow(t.x - s.x, 2) + pow(t.y - s.y, 2) AS d2 FROM t JOIN s ON abs(t.x - s.x) <= 5.1 AND abs(t.y - s.y) <= 5.1) SELECT tid, round(sum(exp(-d2 / 6.25) * v) / sum(exp(-d2 / 6.25)), 6) AS v, count(*) AS n FROM p WHERE d2 <= 25 GROUP BY tid"),
    "active_pixels": (lambda s, d: D.active_pixels(X.pixels(s, d), G.patch_id(F.col("i"), F.col("j"), 16, 12), G.active_patches(X.pixels(s, d).where("v = 50"), 16, 12)), f"WITH {_PX}, q AS (SELECT *, (i // 16) * 12 + j // 16 + 1 AS patch_id FROM pixels), a AS (SELECT DISTINCT frame, patch_id FROM q WHERE v = 50) SELECT q.* FROM q SEMI JOIN a USING (frame, patch_id)"),
    "satellite_angles": (
        lambda s, d: (lambda e: X.strokes(s, d).select("id", F.round(e, 6).alias("elevation"), F.round(D.parallax_shift(F.lit(10.0), e), 5).alias("shift")))(D.elevation_angle(9.5, 35786.0, F.col("lon").cast("double"), F.col("lat").cast("double"))),
        f"WITH {_S}, c AS (SELECT id, cos(radians(lat::DOUBLE)) * cos(radians(lon::DOUBLE - 9.5)) AS c FROM strokes), e AS (SELECT id, degrees(atan2(c - 6371::DOUBLE / (6371 + 35786), sqrt(1 - c * c))) AS e FROM c) SELECT id, round(e, 6) AS elevation, round(10 / tan(radians(e)), 5) AS shift FROM e",
    ),
    "sun_elevation": (
        lambda s, d: X.strokes(s, d).select("id", F.round(D.sun_elevation(F.col("s"), F.col("lon").cast("double"), F.col("lat").cast("double")), 5).alias("sine")),
        f"WITH {_S}, a AS (SELECT id, lon::DOUBLE AS lon, lat::DOUBLE AS lat, s / 86400.0::DOUBLE - 10957.5 AS d FROM strokes), b AS (SELECT *, radians(fmod(357.529 + 0.98560028::DOUBLE * d, 360)) AS g, fmod(280.459 + 0.98564736::DOUBLE * d, 360) AS q, radians(23.439 - 0.00000036::DOUBLE * d) AS e FROM a), c AS (SELECT *, radians(q + 1.915 * sin(g) + 0.020 * sin(2 * g)) AS l FROM b), f AS (SELECT *, asin(sin(e) * sin(l)) AS de, atan2(cos(e) * sin(l), cos(l)) AS ra, radians(fmod(280.46061837 + 360.98564736629::DOUBLE * d + lon, 360)) AS st FROM c) SELECT id, round(sin(radians(lat)) * sin(de) + cos(radians(lat)) * cos(de) * cos(st - ra), 5) AS sine FROM f",
    ),
    "volumetric": (lambda s, d: D.volumetric(_columns(s, d), ["c"], 30.0, 500.0), "SELECT l_orderkey AS c, max(l_linenumber) FILTER (l_quantity >= 30) AS echo_top, round(sum(3.44e-6 * pow(pow(10::DOUBLE, l_quantity::DOUBLE / 10), 4 / 7::DOUBLE)) * 500, 8) AS vil, CASE WHEN max(l_quantity::DOUBLE) >= 20 THEN max(l_quantity::DOUBLE) END AS max_z FROM lineitem GROUP BY 1"),
    "weighted_ensemble": (lambda s, d: D.weighted_ensemble(_models(s, d), {"a": 0.5, "b": 0.3, "c": 0.2}), f"WITH {_P} SELECT id, round(0.5 * y_pred + 0.3 * sqrt(y_pred) + 0.2 * pow(y_pred, 2), 6) AS weighted, round((y_pred + sqrt(y_pred) + pow(y_pred, 2)) / 3, 6) AS mean FROM predictions"),
    "distillation": (
        lambda s, d: D.distillation(_pairs(s, d), 2.0, 0.4),
        f"WITH {_P}, a AS (SELECT lead, y_true AS y, {_ST} AS s, {_TE} AS t FROM predictions), b AS (SELECT lead, -(y * ln(s) + (1 - y) * ln(1 - s)) AS h, " + ", ".join(f"{_CL.format(f'1 / (1 + exp(-{_LG.format(c)} / 2))')} AS {n}" for c, n in (("s", "qs"), ("t", "qt"))) + " FROM a), c AS (SELECT lead, h, qt * ln(qt / qs) + (1 - qt) * ln((1 - qt) / (1 - qs)) AS kl FROM b) SELECT lead, round(avg(h), 6) AS hard, round(avg(kl), 6) AS soft, round(avg(0.4 * h + 0.6 * 4 * kl), 6) AS total FROM c GROUP BY lead",
    ),
    "ecdf_map": (
        lambda s, d: D.ecdf_map(X.predictions(s, d).withColumn("target", F.sqrt("y_pred")), "y_pred", "target", "id", ["lead"]),
        f"WITH {_P}, s AS (SELECT lead, id, (rank() OVER (PARTITION BY lead ORDER BY y_pred) - 1 + count(*) OVER (PARTITION BY lead ORDER BY y_pred RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / (2 * count(*) OVER (PARTITION BY lead))::DOUBLE * count(*) OVER (PARTITION BY lead) AS k FROM predictions), t AS (SELECT lead, sqrt(y_pred) AS mapped, row_number() OVER (PARTITION BY lead ORDER BY y_pred, id) AS k FROM predictions) SELECT s.lead, id, round(mapped, 6) AS mapped FROM s JOIN t ON t.lead = s.lead AND t.k = greatest(1, ceil(s.k)::BIGINT)",
    ),
    "value_distribution": (lambda s, d: D.value_distribution(X.strokes(s, d).withColumn("a", F.abs("current")), "a", "intra"), f"WITH {_S} SELECT intra, CAST(least(floor(abs(current) / ((SELECT max(abs(current)) FROM strokes) / 5)), 4) AS BIGINT) AS bin, count(*) AS n FROM strokes GROUP BY ALL"),
    "spearman": (lambda s, d: D.spearman(X.predictions(s, d), "y_true", "y_pred", ["lead"]), f"WITH {_P}, r AS (SELECT lead, rank() OVER (PARTITION BY lead ORDER BY y_true) + (count(*) OVER (PARTITION BY lead, y_true) - 1) / 2::DOUBLE AS a, rank() OVER (PARTITION BY lead ORDER BY y_pred) + (count(*) OVER (PARTITION BY lead, y_pred) - 1) / 2::DOUBLE AS b FROM predictions) SELECT lead, round(corr(a, b), 6) AS rho FROM r GROUP BY lead"),
    "attribution": (lambda s, d: D.attribution(X.strokes(s, d), ["intra", "i"], "current"), f"WITH {_S} SELECT intra, i, round(avg(abs(current)), 6) AS importance FROM strokes GROUP BY ALL"),
    "running_mean": (lambda s, d: D.running_mean(X.strokes(s, d), "j", ["s", "id"], "current"), f"WITH {_S} SELECT j, s, id, round(avg(current) OVER (PARTITION BY j ORDER BY s, id ROWS UNBOUNDED PRECEDING), 10) AS running FROM strokes"),
    "expand_regions": (lambda s, d: D.expand_regions(X.pixels(s, d).select(F.col("frame").alias("t"), F.floor(F.col("i") / 8).alias("i"), F.floor(F.col("j") / 8).alias("j")), 1, 2), f"WITH {_PX}, c AS (SELECT DISTINCT frame AS t, i // 8 AS i, j // 8 AS j FROM pixels) SELECT DISTINCT t + a AS t, i + b AS i, j + c2 AS j FROM c, (SELECT unnest(range(-1, 2)) AS a), (SELECT unnest(range(-2, 3)) AS b), (SELECT unnest(range(-2, 3)) AS c2)"),
    "frame_origins": (lambda s, d: D.frame_origins(X.strokes(s, d).select(F.floor(F.col("s") / 3600).alias("t"), "i", "j"), 8), f"WITH {_S} SELECT s // 3600 AS t, min(i) AS i_min, max(i) AS i_max, min(j) AS j_min, max(j) AS j_max, min(i) AS i0, min(j) AS j0 FROM strokes GROUP BY 1"),
    "frame_origins_drawn": (lambda s, d: D.frame_origins(X.strokes(s, d).select(F.floor(F.col("s") / 3600).alias("t"), "i", "j"), 8, 5), f"WITH {_S}, b AS (SELECT s // 3600 AS t, min(i) AS i_min, max(i) AS i_max, min(j) AS j_min, max(j) AS j_max FROM strokes GROUP BY 1) SELECT *, i_min + {drawn_sql("'5-' || t", 'greatest(1, i_max - i_min - 6)')} AS i0, j_min + {drawn_sql("'6-' || t", 'greatest(1, j_max - j_min - 6)')} AS j0 FROM b"),
    "run_summary": (lambda s, d: D.run_summary(X.patch_active(s, d, 5), _seen(s, d)), f"WITH {X.sql_active(5)}, n AS (SELECT max(slot) - min(slot) + 1 AS n FROM active) SELECT any_value(n) AS steps, count(DISTINCT slot) AS active_steps, round(count(DISTINCT slot) * 100 / any_value(n)::DOUBLE, 6) AS percent, count(DISTINCT patch_id) AS patches FROM active, n"),
    "metric_table": (
        lambda s, d: D.metric_table(_sweep(s, d, 0), _sweep(s, d, 1), {k: v for k, v in V.skill_scores().items() if k in ("csi", "pod", "far")}),
        f"WITH {_half_sql(0, 'va')}, {_half_sql(1, 'te')}, b AS (SELECT lead, k FROM va QUALIFY row_number() OVER (PARTITION BY lead ORDER BY round(tp / (tp + fp + fn + 1e-10), 6) DESC, k) = 1) SELECT lead, k, round(tp / (tp + fp + fn + 1e-10), 6) AS csi, round(tp / (tp + fn + 1e-10), 6) AS pod, round(fp / (tp + fp + 1e-10), 6) AS far FROM te JOIN b USING (lead, k)",
    ),
}
