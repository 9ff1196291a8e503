"""Queries over samples, stitching, sinks and streams."""

from pyspark.sql import functions as F

from gridloom.functions.draws import drawn_sql
from gridloom.operators import samples as M
from gridloom.operators import sequences as S
from gridloom.plans import activity, fixtures as X
from gridloom.sources import sinks as K
from gridloom.streaming import jobs as Z

_A = X.sql_active()
_V = "vals AS (SELECT s // 3600 AS t, j % 18 + 1 AS patch_id, intra AS variable, round(sum(abs(current)), 2) AS v FROM strokes GROUP BY ALL)"
_LOC = "pt AS (SELECT s // 86400 AS t, i // 2 AS i, j // 2 AS j, min(id) AS idx FROM strokes WHERE intra = 'IC' GROUP BY ALL), z AS (SELECT DISTINCT s // 86400 AS t, i // 2 AS i, j // 2 AS j FROM strokes WHERE intra = 'CG'), loc AS (SELECT t, i, j, 'patch' AS status, idx FROM pt UNION ALL SELECT z.t, z.i, z.j, 'zero', NULL FROM z ANTI JOIN pt USING (t, i, j))"
_CELLS = "org AS (SELECT id AS oid, s // 86400 AS t, i // 2 AS i, j // 2 AS j FROM strokes), cell AS (SELECT oid, dt, org.t + dt AS t, org.i + di AS i, org.j + dj AS j FROM org, (SELECT unnest(range(0, 3)) AS dt), (SELECT unnest(range(0, 4)) AS di), (SELECT unnest(range(0, 4)) AS dj)), st AS (SELECT oid, dt, i, j, coalesce(status, 'missing') AS status, idx FROM cell LEFT JOIN loc USING (t, i, j))"
_EV = "ev AS (SELECT event_id, event_type, value, ts, max(ts) OVER () - INTERVAL 10 MINUTES AS wm FROM events)"


def _vals(s, d):
    return X.strokes(s, d).groupBy(F.floor(F.col("s") / 3600).alias("t"), (F.col("j") % 18 + 1).alias("patch_id"), F.col("intra").alias("variable")).agg(F.round(F.sum(F.abs("current")), 2).alias("v"))


def _assembled(s, d):
    refs = S.continuity(X.patch_active(s, d)).withColumnRenamed("slot", "t")
    return M.assemble(refs, [-2, -1, 0, 1, 2, 3], ["CG", "IC"], _vals(s, d)).select("t", "patch_id", F.col("step").cast("long").alias("step"), F.round(F.get("channels", F.lit(0)), 2).alias("cg"), F.round(F.get("channels", F.lit(1)), 2).alias("ic"), "missing")


def _loc(s, d):
    rows = X.strokes(s, d).select(F.floor(F.col("s") / 86400).alias("t"), F.floor(F.col("i") / 2).alias("i"), F.floor(F.col("j") / 2).alias("j"), F.col("id").alias("idx"), "intra")
    return M.patch_locations(rows.where("intra = 'IC'"), rows.where("intra = 'CG'"))


def _stitched(s, d):
    origins = X.strokes(s, d).select(F.col("id").alias("oid"), F.floor(F.col("s") / 86400).alias("t"), F.floor(F.col("i") / 2).alias("i"), F.floor(F.col("j") / 2).alias("j"))
    return M.stitch(origins, _loc(s, d), 3, 4)


def _long(s, d):
    return X.strokes(s, d).groupBy(F.floor(F.col("s") / 21600).alias("t"), (F.col("i") % 10).alias("i"), F.col("intra").alias("variable")).agg(F.count(F.lit(1)).cast("double").alias("v"))


_LONG = "lg AS (SELECT s // 21600 AS t, i % 10 AS i, intra AS variable, count(*)::DOUBLE AS v FROM strokes GROUP BY ALL)"


def _text(s, d):
    return X.patch_active(s, d).select(F.date_format(F.timestamp_seconds(F.col("slot") * 3600), "yyyy-MM-dd'T'HH:mm").alias("ts_text"), "patch_id")


_WIN = "SELECT CAST(epoch(start) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value::DOUBLE), 4) AS total FROM w WHERE start + INTERVAL 15 MINUTES <= wm GROUP BY ALL"
QUERIES = {
    "assembled_samples": (
        _assembled,
        f"WITH {_A}, {activity._REFS}, {X.SQL_STROKES}, {_V}, g AS (SELECT slot AS t, patch_id, CAST(step AS BIGINT) AS step FROM refs, (SELECT unnest(range(-2, 4)) AS step)) SELECT g.t, g.patch_id, g.step, coalesce(max(v) FILTER (variable = 'CG'), 0) AS cg, coalesce(max(v) FILTER (variable = 'IC'), 0) AS ic, 2 - count(v) AS missing FROM g LEFT JOIN vals ON vals.t = g.t + g.step AND vals.patch_id = g.patch_id GROUP BY ALL",
    ),
    "patch_locations": (_loc, f"WITH {X.SQL_STROKES}, {_LOC} SELECT * FROM loc"),
    "stitched_cells": (_stitched, f"WITH {X.SQL_STROKES}, {_LOC}, {_CELLS} SELECT * FROM st"),
    "stitch_coverage": (lambda s, d: M.coverage(_stitched(s, d)), f"WITH {X.SQL_STROKES}, {_LOC}, {_CELLS} SELECT oid, dt, count(*) FILTER (status = 'patch') AS found, count(*) FILTER (status = 'zero') AS zeros, count(*) FILTER (status = 'missing') AS missing, round(count(*) FILTER (status <> 'missing') / count(*)::DOUBLE, 6) AS coverage FROM st GROUP BY ALL"),
    "full_boxes": (
        lambda s, d: M.full_boxes(X.pixels(s, d).select(F.col("frame").alias("t"), F.floor(F.col("i") / 4).alias("i"), F.floor(F.col("j") / 4).alias("j")), 2, 3),
        f"WITH {X.SQL_PIXELS}, c AS (SELECT DISTINCT frame AS t, i // 4 AS i, j // 4 AS j FROM pixels), f AS (SELECT t, i - a AS i, j - b AS j FROM c, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b) GROUP BY ALL HAVING count(*) = 4), k AS (SELECT *, count(*) OVER (PARTITION BY i, j ORDER BY t RANGE BETWEEN CURRENT ROW AND 2 FOLLOWING) AS k FROM f) SELECT t, i, j FROM k WHERE k = 3",
    ),
    "merge_first": (lambda s, d: M.merge_first(_long(s, d).where("variable = 'IC'").drop("variable"), _long(s, d).where("variable = 'CG'").drop("variable"), ["t", "i"], "v"), f"WITH {X.SQL_STROKES}, {_LONG}, a AS (SELECT * FROM lg WHERE variable = 'IC'), b AS (SELECT * FROM lg WHERE variable = 'CG') SELECT t, i, coalesce(a.v, b.v) AS v FROM a FULL JOIN b USING (t, i)"),
    "composite_difference": (lambda s, d: M.composite(_long(s, d), ["t", "i"], "IC - CG"), f"WITH {X.SQL_STROKES}, {_LONG} SELECT t, i, max(v) FILTER (variable = 'IC') - max(v) FILTER (variable = 'CG') AS v FROM lg GROUP BY ALL"),
    "composite_dot": (lambda s, d: M.composite(_long(s, d), ["t", "i"], "dot IC CG CG IC"), f"WITH {X.SQL_STROKES}, {_LONG} SELECT t, i, 2 * max(v) FILTER (variable = 'IC') * max(v) FILTER (variable = 'CG') AS v FROM lg GROUP BY ALL"),
    "scene": (lambda s, d: M.scene(_long(s, d), ["t", "i"], ["IC", "CG", "absent"]).withColumn("absent", F.col("absent").cast("double")), f"WITH {X.SQL_STROKES}, {_LONG} SELECT t, i, max(v) FILTER (variable = 'IC') AS \"IC\", max(v) FILTER (variable = 'CG') AS \"CG\", NULL::DOUBLE AS absent FROM lg GROUP BY ALL"),
    "source_presence": (lambda s, d: M.presence(X.table(s, d, "events").select("user_id", "event_type"), "user_id", "event_type", ["click", "purchase", "view"]), "WITH h AS (SELECT user_id, list(DISTINCT event_type) AS h FROM events GROUP BY 1) SELECT user_id, array_to_string(list_filter(['click', 'purchase', 'view'], lambda x: NOT list_contains(h, x)), ',') AS lacking, list_has_all(h, ['click', 'purchase', 'view']) AS complete FROM h"),
    "zip_batches": (lambda s, d: M.zip_batches(X.strokes(s, d).where("intra = 'IC'"), X.strokes(s, d).where("intra = 'CG'"), "id", "j").select("j", F.col("k").cast("long").alias("k"), "a", "b"), f"WITH {X.SQL_STROKES}, a AS (SELECT j, id, row_number() OVER (PARTITION BY j ORDER BY id) AS k FROM strokes WHERE intra = 'IC'), b AS (SELECT j, id, row_number() OVER (PARTITION BY j ORDER BY id) AS k FROM strokes WHERE intra = 'CG') SELECT j, k, a.id AS a, b.id AS b FROM a JOIN b USING (j, k)"),
    "hash_split": (lambda s, d: M.hash_split(X.patch_active(s, d).select(F.floor(F.col("slot") / 24).alias("day")).distinct(), F.col("day"), {"test": 100, "validation": 100}), f"WITH {X.sql_active()}, b AS (SELECT DISTINCT slot // 24 AS day FROM active), h AS (SELECT day, {drawn_sql("'13-' || day", '1000')} AS h FROM b) SELECT day, CASE WHEN h < 100 THEN 'test' WHEN h < 200 THEN 'validation' ELSE 'train' END AS split FROM h"),
    "wide_index": (lambda s, d: K.wide_index(_text(s, d)), f"WITH {_A} SELECT strftime(make_timestamp(slot * 3600000000), '%Y-%m-%dT%H:%M') AS ts_text, " + ", ".join(f"CAST(max(CASE WHEN patch_id = {k} THEN 1 ELSE 0 END) AS INT) AS patch_{k}" for k in range(1, 19)) + " FROM active GROUP BY slot"),
    "index_json": (lambda s, d: K.index_json(_text(s, d)), f"WITH {_A} SELECT '{{\"ts\":\"' || strftime(make_timestamp(slot * 3600000000), '%Y-%m-%dT%H:%M') || '\",\"patches\":[' || string_agg(patch_id::VARCHAR, ',' ORDER BY patch_id) || ']}}' AS value FROM active GROUP BY slot"),
    "sequence_rows": (lambda s, d: K.sequence_rows(S.step_positions(X.patch_active(s, d)), 2, 3, 15).select("slot", "patch_numbers", "`idx_t-30`", "`idx_t0`", "`idx_t+45`"), f"WITH {_A}, {activity._REFS}, p AS (SELECT slot, patch_id, row_number() OVER (PARTITION BY slot ORDER BY patch_id) - 1 AS pos FROM active), x AS (SELECT r.slot, r.patch_id, t.step, p.pos FROM refs r, (SELECT unnest(range(-2, 4)) AS step) t, p WHERE p.slot = r.slot + t.step AND p.patch_id = r.patch_id) SELECT slot, '[' || string_agg(patch_id::VARCHAR, ',' ORDER BY patch_id) FILTER (step = 0) || ']' AS patch_numbers, '[' || string_agg(pos::VARCHAR, ',' ORDER BY patch_id) FILTER (step = -2) || ']' AS \"idx_t-30\", '[' || string_agg(pos::VARCHAR, ',' ORDER BY patch_id) FILTER (step = 0) || ']' AS \"idx_t0\", '[' || string_agg(pos::VARCHAR, ',' ORDER BY patch_id) FILTER (step = 3) || ']' AS \"idx_t+45\" FROM x GROUP BY slot"),
    "stream_tumbling": (lambda s, d: Z.drained(Z.stroke_windows(Z.events_stream(s, d))), f"WITH {_EV}, w AS (SELECT time_bucket(INTERVAL 15 MINUTES, ts) AS start, event_type, value, wm FROM ev) {_WIN}"),
    "stream_sliding": (lambda s, d: Z.drained(Z.stroke_windows(Z.events_stream(s, d), "15 minutes", "5 minutes")), f"WITH {_EV}, w AS (SELECT time_bucket(INTERVAL 5 MINUTES, ts) - k * INTERVAL 5 MINUTES AS start, event_type, value, wm FROM ev, (SELECT unnest([0, 1, 2]) AS k)) {_WIN}"),
    "stream_first_arrivals": (lambda s, d: Z.drained(Z.first_arrivals(Z.events_stream(s, d), ["user_id", "event_type"])), "SELECT DISTINCT user_id, event_type FROM events"),
    "stream_verification": (
        lambda s, d: Z.drained(Z.verified_online(e.select("ts", F.col("event_id").alias("id"), (F.col("event_id") % 3 + 1).cast("int").alias("lead"), F.least(F.col("value").cast("double") / 100, F.lit(1.0)).alias("y_pred")), Z.events_stream(s, d).select((F.col("ts") + F.expr("INTERVAL 5 MINUTES")).alias("truth_ts"), F.col("event_id").alias("truth_id"), F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("y_true")))) if (e := Z.events_stream(s, d)) else None,
        f"WITH {X.SQL_PREDICTIONS} SELECT id, lead, y_pred, y_true FROM predictions",
    ),
}
