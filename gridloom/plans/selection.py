"""Queries that select, order and batch rows, and join what has no time."""

from pyspark.sql import functions as F

from gridloom.operators import patches as Q
from gridloom.operators import selection as C
from gridloom.operators import sequences as S
from gridloom.operators.shared import new_path
from gridloom.operators.verify import xi_correlation
from gridloom.plans import activity, assembly
from gridloom.plans import fixtures as X
from gridloom.plans import quality
from gridloom.sources import sinks, tables
from gridloom.streaming import jobs

_A, _P8, _S = X.sql_active(), X.SQL_PATCH8, X.SQL_STROKES
_DAY, _TIMES = "2024-01-03", ["00:00", "06:15", "12:30", "18:45"]


def _files(s, d):
    return X.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_orderstatus").alias("group"))


def _sequences(s, d):
    at = F.timestamp_seconds(F.floor(F.expr(X.SECONDS) / 900) * 900)
    return X.table(s, d, "events").select(F.col("event_id").alias("id"), F.date_format(at, " yyyy-MM-dd").alias("date"), F.date_format(at, "HH:mm ").alias("reference_utc"))


def _wide(s, d, name="values"):
    """(patch, values): the eight channels of each row of a patch."""
    return X.patch8(s, d).groupBy("patch", "i").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "v"))), lambda x: x["v"]).alias(name))


def _static(s, d):
    x = X.patch8(s, d)
    return x.groupBy("i", "j").agg(F.max("v").alias("m"), F.min("v").alias("l")).select("i", "j", F.when((F.col("i") + F.col("j")) % 3 > 0, F.col("m")).otherwise(F.lit(float("nan"))).alias("ifac"), F.col("m").alias("aspect"), F.col("m").alias("gx"), F.col("l").alias("gy"))


def _terrain(s, d):
    out = C.with_static(X.patch8(s, d), C.terrain_fields(_static(s, d)), ["i", "j"])
    return out.select("patch", "i", "j", "v", "ifac", *[F.round(c, 6).alias(c) for c in ("sin_aspect", "cos_aspect", "gradient")])


def _xi(s, d):
    x = X.patch8(s, d)
    pairs = x.where("j < 7").select("patch", "i", "j", "v").join(x.select("patch", "i", (F.col("j") - 1).alias("j"), F.col("v").alias("w")), ["patch", "i", "j"])
    rows = pairs.select(F.col("j").alias("input"), F.col("v").alias("x"), F.col("w").alias("y"), (F.col("patch") * 8 + F.col("i")).alias("key"))
    return C.ranked_inputs(xi_correlation(rows, "x", "y", "key", ["input"]), "xi", "input")


def _importance(s, d):
    o = X.table(s, d, "lineitem")
    of = lambda v: o.groupBy(F.col("l_returnflag").alias("mode"), F.col("l_suppkey").alias("input")).agg(F.sum(F.col(v).cast("double")).alias("importance"))
    return of("l_quantity"), of("l_discount")


def _importance_table(s, d):
    table = C.compare_importance(*_importance(s, d), "input", ["mode"])[0]
    return table.select("mode", "input", F.round("first", 2).alias("first"), F.round("second", 2).alias("second"))


def _rounded(df, names, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


def _stored_statistics(s, d):
    path = new_path(s, "statistics")
    Q.statistics(X.patch8(s, d)).write.parquet(path)
    return tables.read_statistics(s, path)


def _stored_predictions(s, d):
    path = new_path(s, "predictions")
    _wide(s, d).select("patch", "i", F.array("values").alias("values")).write.parquet(path)
    frame = X.patch8(s, d).groupBy("patch", "i").agg(F.min("v").alias("lat"), F.max("v").alias("lon"))
    return C.placed_predictions(s.read.parquet(path), frame, ["patch", "i"]).select("patch", "i", "lat", "lon", F.element_at("values", 1).alias("first"), F.size("values").alias("n"))


def _boxes(s, d):
    return X.table(s, d, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), (F.col("l_partkey") % 60 - 10).alias("i1"), (F.col("l_suppkey") % 60 - 10).alias("j1"), (F.col("l_partkey") % 60).alias("i2"), (F.col("l_suppkey") % 60).alias("j2")
    )


def _grid(s, d):
    return X.strokes(s, d).groupBy((F.col("i") % 40).alias("i"), (F.col("j") % 40).alias("j")).agg(F.min(F.col("lat").cast("double")).alias("lat"), F.max(F.col("lon").cast("double")).alias("lon"))


def _regridded(s, d):
    x = X.patch8(s, d).select((F.col("patch") % 3).alias("variable"), F.col("patch").alias("key"), "i", "j", (F.col("i") * 8 + F.col("j")).alias("src"), F.when(F.col("v") > -0.1, F.col("v")).alias("v"))
    cell = x.select("src", F.floor(F.col("i") / 2).alias("ti"), F.floor(F.col("j") / 2).alias("tj"), ((F.col("i") + F.col("j")) % 2 * 2 + 1).alias("w"), (F.col("i") % 2 + F.col("j") % 2 == 0).alias("corner")).distinct()
    of = lambda rows, name, w: rows.select(F.lit(name).alias("method"), F.col("ti").alias("i"), F.col("tj").alias("j"), "src", w.cast("double").alias("w"))
    routes = x.select("variable").distinct().withColumn("method", F.when(F.col("variable") == 0, "nearest").otherwise("weighted"))
    out = C.regrid(x.select("variable", "key", "src", "v"), routes, of(cell.where("corner"), "nearest", F.lit(1.0)).union(of(cell, "weighted", F.col("w"))))
    return out.withColumn("v", F.round("v", 6))


def _appended(s, d):
    path, x = new_path(s, "variables"), X.patch8(s, d)
    keys = ["patch", "i", "j"]
    sinks.append_variables(x.withColumn("twice", F.col("v") * 2), path, keys, ["v", "twice"])
    sinks.append_variables(x.where("j < 4").withColumn("half", F.col("v") / 2), path, keys, ["half"])
    return tables.read_wide(s, path, keys, ["v", "twice", "half"])


def _apart(s, d):
    done, dead = jobs.drained_apart(jobs.events_stream(s, d), (F.col("value").cast("double") < 90) & F.col("event_type").isin("click", "view", "purchase"))
    return done.select("event_id", F.lit(True).alias("done")).union(dead.select("event_id", F.lit(False)))


_WIDE = "wide AS (SELECT patch, i, list(v ORDER BY j) AS vs FROM patch8 GROUP BY ALL)"
_CUTS = ("light", "moderate", "heavy", "extreme")
_STATS = dict(zip(_CUTS, (0.33, 0.66, 0.9, 0.99)))
_IMPORTANCE = "im AS (SELECT l_returnflag AS mode, l_suppkey AS input, sum(l_quantity::DOUBLE) AS a, sum(l_discount::DOUBLE) AS b FROM lineitem GROUP BY ALL)"

QUERIES = {
    "files_on_dates": (lambda s, d: C.on_dates(_files(s, d), ["1995-03-01", "1995-03-02", "1996-07-15"], ["O", "F"]), "SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderstatus AS \"group\" FROM orders WHERE CAST(o_orderdate AS DATE) IN (DATE '1995-03-01', DATE '1995-03-02', DATE '1996-07-15') AND o_orderstatus IN ('O', 'F')"),
    "sequences_at_times": (
        lambda s, d: C.at_times(_sequences(s, d), _DAY, _TIMES),
        f"WITH q AS (SELECT event_id AS id, time_bucket(INTERVAL 15 MINUTE, CAST(ts AS TIMESTAMP)) AS slot FROM events) SELECT id, strftime(slot, ' %Y-%m-%d') AS date, strftime(slot, '%H:%M ') AS reference_utc FROM q WHERE CAST(slot AS DATE) = DATE '{_DAY}' AND strftime(slot, '%H:%M') IN ({', '.join(map(repr, _TIMES))})",
    ),
    "continuity_in_hours": (lambda s, d: C.in_hours(S.continuity(X.patch_active(s, d)), 60, 6, 18), f"WITH {_A}, {activity._REFS} SELECT * FROM refs WHERE slot % 24 BETWEEN 6 AND 17"),
    "sources_by_age": (
        lambda s, d: C.by_age((x := X.strokes(s, d)).where("intra = 'IC'").select("id", "s", "current"), x.where("intra = 'CG'").select("id", "s", "current"), "s", x.agg(F.max("s") - 5 * 86400).scalar()),
        f"WITH {_S} SELECT id, s, current FROM strokes WHERE (intra = 'IC') = (s >= (SELECT max(s) FROM strokes) - 432000)",
    ),
    "all_ids": (lambda s, d: C.all_ids([X.table(s, d, "documents").select(F.col("doc_id").alias("id")), X.table(s, d, "labels").select(F.col("doc_id").alias("id")), X.table(s, d, "pages").select(F.col("page_id").alias("id"))], "id"), "SELECT doc_id AS id FROM documents UNION SELECT doc_id FROM labels UNION SELECT page_id FROM pages"),
    "append_splits": (
        lambda s, d: C.append_splits({k: activity.splits(s, d).where(F.col("split") == k).drop("split") for k in ("train", "validation", "test")}),
        f"WITH {_A}, {activity._REFS}, {activity._SPLIT} SELECT * FROM split",
    ),
    "flatten_groups": (
        lambda s, d: C.flatten_groups(X.patch_active(s, d).groupBy("slot", F.floor(F.col("patch_id") / 6).alias("g")).agg(F.collect_list("patch_id").alias("p")).groupBy("slot").agg(F.collect_list("p").alias("groups")), "groups", "patch_id"),
        f"WITH {_A} SELECT slot, patch_id FROM active",
    ),
    "first_rows": (lambda s, d: C.first_rows(X.predictions(s, d), ["y_pred", "id"], 100), f"WITH {X.SQL_PREDICTIONS} SELECT * FROM predictions ORDER BY y_pred, id LIMIT 100"),
    "ranked_inputs": (
        _xi,
        f"WITH {_P8}, p AS (SELECT a.j AS input, a.v AS x, b.v AS y, a.patch * 8 + a.i AS key FROM patch8 a JOIN patch8 b ON a.patch = b.patch AND a.i = b.i AND b.j = a.j + 1), r AS (SELECT *, row_number() OVER (PARTITION BY input ORDER BY y, key) AS ry, row_number() OVER (PARTITION BY input ORDER BY x, key) AS rx FROM p), "
        "t AS (SELECT input, abs(ry - lag(ry) OVER (PARTITION BY input ORDER BY rx)) AS step FROM r), x AS (SELECT input, round(greatest(0, least(1, 1 - sum(step)::DOUBLE / (2 * count(*)::DOUBLE * count(*) / 3))), 6) AS xi FROM t GROUP BY 1) SELECT input, xi, row_number() OVER (ORDER BY xi DESC, input) AS place FROM x",
    ),
    "batches": (lambda s, d: C.batches(X.predictions(s, d), ["y_pred", "id"], 64), f"WITH {X.SQL_PREDICTIONS}, n AS (SELECT *, row_number() OVER (ORDER BY y_pred, id) - 1 AS n FROM predictions) SELECT id, lead, y_true, y_pred, n // 64 AS batch, n % 64 AS pos FROM n"),
    "largest_channel": (lambda s, d: _wide(s, d).select("patch", "i", C.largest_channel(F.col("values")).alias("channel")), f"WITH {_P8}, {_WIDE} SELECT patch, i, list_position(vs, list_max(vs)) - 1 AS channel FROM wide"),
    "one_lead": (lambda s, d: _wide(s, d).select("patch", "i", C.one_lead(F.col("values"), 2).alias("v")), f"WITH {_P8} SELECT patch, i, v FROM patch8 WHERE j = 2"),
    "zero_predictor": (
        lambda s, d: C.zero_predictor((x := X.pixels(s, d)).where("v > 40"), x.where("v <= 40"), ["frame", "i", "j"]),
        f"WITH {X.SQL_PIXELS} SELECT frame, i, j, 0.0::DOUBLE AS zeros FROM pixels",
    ),
    "terrain_fields": (
        _terrain,
        f"WITH {_P8}, m AS (SELECT i, j, max(v) AS m, min(v) AS l FROM patch8 GROUP BY ALL) SELECT patch, i, j, v, CASE WHEN (i + j) % 3 > 0 THEN m ELSE 1.0 END AS ifac, round(sin(m), 6) AS sin_aspect, round(cos(m), 6) AS cos_aspect, round(sqrt(m * m + l * l), 6) AS gradient FROM patch8 JOIN m USING (i, j)",
    ),
    "stored_predictions": (_stored_predictions, f"WITH {_P8} SELECT patch, i, min(v) AS lat, max(v) AS lon, max(v) FILTER (j = 0) AS \"first\", CAST(count(*) AS INT) AS n FROM patch8 GROUP BY ALL"),
    "stored_statistics": (_stored_statistics, quality.QUERIES["patch_statistics"][1]),
    "first_files": (
        lambda s, d: C.first_files(X.table(s, d, "lineitem").select(F.col("l_returnflag").alias("variable"), F.date_format("l_shipdate", "yyyyMMdd").alias("folder"), F.concat_ws("_", "l_orderkey", "l_linenumber").alias("path"))),
        "WITH f AS (SELECT l_returnflag AS variable, strftime(l_shipdate, '%Y%m%d') AS folder, l_orderkey || '_' || l_linenumber AS path FROM lineitem) SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY variable ORDER BY folder, path) = 1",
    ),
    "corner_coordinates": (
        lambda s, d: C.corner_coordinates(_boxes(s, d), _grid(s, d), 40, 40),
        f"WITH {_S}, g AS (SELECT i % 40 AS i, j % 40 AS j, min(lat::DOUBLE) AS lat, max(lon::DOUBLE) AS lon FROM strokes GROUP BY ALL), b AS (SELECT l_orderkey * 8 + l_linenumber AS id, greatest(0, least(39, l_partkey % 60 - 10)) AS i1, greatest(0, least(39, l_suppkey % 60 - 10)) AS j1, least(39, l_partkey % 60) AS i2, least(39, l_suppkey % 60) AS j2 FROM lineitem) "
        "SELECT id, p.lat AS lat1, p.lon AS lon1, q.lat AS lat2, q.lon AS lon2 FROM b JOIN g p ON p.i = i1 AND p.j = j1 JOIN g q ON q.i = i2 AND q.j = j2",
    ),
    "importance_table": (_importance_table, f"WITH {_IMPORTANCE} SELECT mode, input, round(a, 2) AS \"first\", round(b, 2) AS \"second\" FROM im"),
    "importance_correlation": (
        lambda s, d: C.compare_importance(*(_rounded(x, ["importance"], 2) for x in _importance(s, d)), "input", ["mode"])[1],
        f"WITH {_IMPORTANCE}, q AS (SELECT mode, input, round(a, 2) AS a, round(b, 2) AS b FROM im), r AS (SELECT mode, rank() OVER (PARTITION BY mode ORDER BY a) + (count(*) OVER (PARTITION BY mode, a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY mode ORDER BY b) + (count(*) OVER (PARTITION BY mode, b) - 1) / 2.0::DOUBLE AS rb FROM q) SELECT mode, round(corr(ra, rb), 6) AS rho FROM r GROUP BY 1",
    ),
    "object_keys": (
        lambda s, d: X.table(s, d, "events").select(F.col("event_id").alias("id"), C.object_key(F.timestamp_seconds(F.expr(X.SECONDS)), "-composite.h5").alias("key")),
        "SELECT event_id AS id, strftime(date_trunc('second', CAST(ts AS TIMESTAMP)) + INTERVAL 10 MINUTE, '%Y/%m/%d/%Y-%m-%dT%H%M%SZ') || '-composite.h5' AS key FROM events",
    ),
    "frame_report": (
        lambda s, d: _rounded(C.frame_report(X.patch8(s, d), "patch", "v", 0.05, 2.0), ["mean", "std", "coverage", *[f"{c}_from" for c in _CUTS]]),
        f"WITH {_P8}, a AS (SELECT patch, v, {', '.join(f'quantile_cont(v, {q}) FILTER (v > 0.05) OVER (PARTITION BY patch) AS {c}' for c, q in _STATS.items())} FROM patch8) SELECT patch, round(avg(v), 6) AS mean, max(v) AS max, min(v) AS min, round(stddev_pop(v), 6) AS std, count(*) AS n, count(*) FILTER (v > 0.05) AS n_active, {', '.join(f'round(any_value({c}), 6) AS {c}_from' for c in _CUTS)}, "
        "4.0::DOUBLE * count(*) FILTER (v > 0.05 AND v <= light) AS light_km2, 4.0::DOUBLE * count(*) FILTER (v > light AND v <= moderate) AS moderate_km2, 4.0::DOUBLE * count(*) FILTER (v > moderate AND v <= heavy) AS heavy_km2, 4.0::DOUBLE * count(*) FILTER (v > heavy) AS extreme_km2, round(count(*) FILTER (v > 0.05) * 100 / count(*)::DOUBLE, 6) AS coverage FROM a GROUP BY patch",
    ),
    "regridded": (
        _regridded,
        f"WITH {_P8} SELECT patch % 3 AS variable, patch AS key, i // 2 AS i, j // 2 AS j, round(sum(v * CASE WHEN patch % 3 = 0 THEN 1 ELSE (i + j) % 2 * 2 + 1 END) / sum(CASE WHEN patch % 3 = 0 THEN 1 ELSE (i + j) % 2 * 2 + 1 END), 6) AS v FROM patch8 WHERE v > -0.1 AND (patch % 3 > 0 OR (i % 2 = 0 AND j % 2 = 0)) GROUP BY patch, i // 2, j // 2",
    ),
    "appended_variables": (_appended, f"WITH {_P8} SELECT patch, i, j, v, v * 2 AS twice, CASE WHEN j < 4 THEN v / 2 END AS half FROM patch8"),
    "stitch_json": (
        lambda s, d: sinks.stitch_json(assembly._stitched(s, d)),
        f"WITH {_S}, {assembly._LOC}, {assembly._CELLS} SELECT oid, dt, '{{\"found\":' || count(*) FILTER (status = 'patch') || ',\"zeros\":' || count(*) FILTER (status = 'zero') || ',\"missing\":[' || coalesce(string_agg('{{\"i\":' || i || ',\"j\":' || j || '}}', ',' ORDER BY i, j) FILTER (status = 'missing'), '') || ']}}' AS value FROM st GROUP BY ALL",
    ),
    "stream_dead_letters": (_apart, "SELECT event_id, coalesce(value < 90 AND event_type IN ('click', 'view', 'purchase'), false) AS done FROM events"),
}
