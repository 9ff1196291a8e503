"""Queries over geometry, rain scores, reports, stores and archives."""

from pyspark.sql import functions as F

from gridloom.operators import geometry as G
from gridloom.operators import rain as R
from gridloom.operators import reports as P
from gridloom.operators import verify as V
from gridloom.operators.grid import zero_patches
from gridloom.operators.sampling import spaced_sample
from gridloom.operators.shared import new_path
from gridloom.plans import fixtures as X
from gridloom.sources import sinks, tables
from gridloom.streaming import jobs

r6 = lambda c: F.round(c, 6)
_S, _PX, _P8, _PR = X.SQL_STROKES, X.SQL_PIXELS, X.SQL_PATCH8, X.SQL_PREDICTIONS


def _erf(x):
    t = f"(1 / (1 + 0.3275911 * abs({x})))"
    return f"(sign({x}) * (1 - {t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429)))) * exp(-({x}) * ({x}))))"


# Rain: a series of twelve samples for every dozen strokes.
_BINS, _SHARES = [0.5, 2.0, 10.0], [0.4, 0.3, 0.2, 0.1]


def _rain(s, d):
    return X.strokes(s, d).select(F.floor(F.col("id") / 12).alias("g"), (F.col("id") % 12 + 1).alias("step"), (F.abs("current") / 10).alias("r"))


_SQL_RAIN = "rain AS (SELECT id // 12 AS g, id % 12 + 1 AS step, abs(current) / 10 AS r FROM strokes)"


def _loss_sql(totals, keys):
    mu = "(ln(10.0::DOUBLE) * log10(CASE WHEN total < 0.1 THEN 0.01 ELSE total END) - 0.3215 * 0.3215 / 2)"
    cdf = [f"0.5 * (1 + {_erf(f'((ln({b}::DOUBLE) - mu) / (sqrt(2.0::DOUBLE) * 0.3215))')})" for b in _BINS]
    shares = [cdf[0], *[f"{b} - {a}" for a, b in zip(cdf[:-1], cdf[1:])], f"1 - {cdf[-1]}"]
    loss = " + ".join(f"-({x}) * ln({p}::DOUBLE)" for x, p in zip(shares, _SHARES))
    return f"WITH {_S}, {_SQL_RAIN}, tot AS ({totals}), m AS (SELECT *, {mu} AS mu FROM tot) SELECT {keys}, round(total, 6) AS total, round(CASE WHEN total < 0.1 THEN -ln(0.4::DOUBLE) ELSE {loss} END, 4) AS loss FROM m"


def _hist(totals, *keys):
    predicted = F.array(*map(F.lit, _SHARES))
    return R.histogram_cross_entropy(totals, _BINS, predicted, 0.1).select(*keys, r6("total").alias("total"), F.round("loss", 4).alias("loss"))


def _motion(s, d):
    return X.patch8(s, d).select(F.col("patch").alias("frame"), "i", "j", ((F.col("i") % 3) * 0.5).alias("u"), ((F.col("j") % 2) * -0.75).alias("w"))


def _moved(s, d):
    return X.pixels(s, d).select("frame", "i", "j", (F.col("i") + 0.3 * F.col("v") / 50).alias("y"), (F.col("j") - 0.2).alias("x"))


def _axes(s, d):
    rows = s.range(40).select(F.col("id").alias("i"), G.axis(F.col("id"), 48.5, 43.0, 40).alias("lat"))
    return rows, s.range(80).select(F.col("id").alias("j"), G.axis(F.col("id"), 20.0, 30.0, 80).alias("lon"))


def _spaced(s, d):
    candidates = X.pixels(s, d).select("frame", "i", "j", ((F.col("i") * 192 + F.col("j")) * 7919 % 18433).alias("rank"))
    return spaced_sample(candidates, 3.0)


_NAMES, _COLS = ["a", "b", "c", "d", "e"], ["d", "e"]


def _coalitions(s, d):
    scores = X.table(s, d, "orders").groupBy((F.col("o_custkey") % 32).alias("bits")).agg(F.round(F.avg(F.col("o_totalprice").cast("double")), 4).alias("score"))
    return scores.select("bits", F.filter(F.array(*map(F.lit, _NAMES)), lambda x, k: F.call_function("shiftright", F.col("bits"), k) % 2 == 1).alias("members"), "score")


def _models(s, d):
    return X.predictions(s, d).select("y_true", F.col("y_pred").alias("m1"), F.pow(F.col("y_pred") - 0.5, 2).alias("m2"))


_SQL_MODELS = "m AS (SELECT y_true, y_pred AS m1, (y_pred - 0.5) * (y_pred - 0.5) AS m2 FROM predictions)"


def _mapped(s, d):
    rows = X.predictions(s, d).select("id", "lead", "y_pred", (F.col("y_pred") * F.col("y_pred") * 2).alias("t"))
    return P.map_by_quantiles(rows, "y_pred", V.quantile_map(rows, "y_pred", "t", ["lead"], 10), ["lead"]).select("id", "lead", F.round("mapped", 5).alias("mapped"))


def _inputs(s, d):
    frames = X.strokes(s, d).groupBy(F.floor(F.col("s") / 3600).alias("t"), F.col("intra").alias("variable")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    still = X.strokes(s, d).agg(F.lit(None).cast("long").alias("t"), F.lit("height").alias("variable"), F.max("lat").alias("v"))
    return P.sample_inputs(frames.union(still), frames.select("t").distinct(), {"CG": "past", "IC": "future", "height": "static"}, 3, 2)


def _hooked(s, d):
    hooks = P.Registry("hook")
    hooks.add("CG", lambda x: F.abs(x))
    hooks.add("IC", lambda x: F.greatest(F.lit(0.0), x))
    return hooks.apply(X.strokes(s, d), "intra", "current").select("id", F.round("current", 4).alias("current"))


# Stores: written below the shared folder and read back.


def _training(s, d):
    path = new_path(s, "training")
    rows = X.patch_active(s, d).withColumn("split", F.when(F.col("slot") % 10 < 7, "train").when(F.col("slot") % 10 < 9, "validation").otherwise("test"))
    sinks.write_training_store(rows, path)
    meta = s.read.text(f"{path}/metadata").select(F.from_json("value", "split string, n long, columns map<string,string>").alias("m")).select("m.split", F.col("m.n").alias("n"), F.size("m.columns").alias("n_columns"))
    stored = s.read.parquet(f"{path}/samples").groupBy("split").agg(F.sum("slot").alias("slots"), F.sum("patch_id").alias("patches"))
    return meta.join(stored, "split")


def _report(s, d):
    path = new_path(s, "report")
    sinks.write_report(V.confusion_sweep(V.with_overall(X.predictions(s, d)), 10, ["lead"]).select("lead", F.col("k").cast("int").alias("k"), "tp", "fp"), path, ["lead"])
    rows = s.read.text(path).select(F.from_json("value", "lead int, k array<int>, tp array<long>, fp array<long>").alias("r"))
    return rows.select("r.lead", F.inline(F.arrays_zip("r.k", "r.tp", "r.fp"))).toDF("lead", "k", "tp", "fp")


def _bundle(s, d):
    path = new_path(s, "bundle")
    sinks.write_bundle(zero_patches(X.pixels(s, d), F.col("v") > 49, 16, 12), path)
    return s.read.parquet(f"{path}/patches").select("frame", "patch_id", F.lit(False).alias("empty"), "n").union(s.read.parquet(f"{path}/zero_patches").select("frame", "patch_id", F.lit(True), F.lit(0).cast("long")))


def _scores(s, d):
    path = new_path(s, "scores")
    names = F.when(F.size("members") == 0, "null").otherwise(F.array_join("members", ""))
    sinks.write_named_files(_coalitions(s, d).select(F.concat(F.lit("eval-x-"), names, F.lit(".csv")).alias("name"), F.concat(F.lit("0.5\n"), F.col("score").cast("string"), F.lit("\n")).alias("content")), path)
    return tables.read_scores(s, path, "x", 1)


def _archive(s, d):
    """A small file for each active quarter of an hour, in dated folders."""
    path = new_path(s, "archive")
    slots = X.patch_active(s, d, 60).select((F.col("slot") * 3600).alias("s")).distinct()
    t = F.timestamp_seconds("s")
    sinks.write_named_files(slots.select(F.concat(F.date_format(t, "yyyy-MM-dd"), F.lit("-Romania/lightning_density_"), F.date_format(t, "yyyyMMdd_HHmm"), F.lit(".nc")).alias("name"), F.col("s").cast("string").alias("content")), path)
    return path


def _discovered(s, d):
    from gridloom.functions import names as N

    found = tables.discover(s, _archive(s, d), "*.nc")
    return found.select("folder", "file", F.unix_timestamp(N.lightning_time(F.col("file"))).alias("s")).where(N.is_dated_folder(F.col("folder")))


def _before(s, d):
    times = X.patch_active(s, d, 360).select((F.col("slot") * 21600).alias("t"))
    return tables.files_before(_discovered(s, d), times, 7200).groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.max_by("file", "s").alias("latest"))


def _patch_store(s, d):
    path = new_path(s, "patches")
    rows = X.strokes(s, d).select(F.col("intra").alias("variable"), F.date_format(F.timestamp_seconds("s"), "yyyy-MM-dd").alias("date"), "id", "current")
    sinks.write_partitioned(rows, path, ["variable", "date"])
    P.READERS.add("patches", tables.read_patches)
    return P.READERS.get("patches")(s, path, "CG").groupBy(F.col("date").cast("string").alias("date")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("current"), 3).alias("total"))


def _consolidated(s, d):
    day = F.date_format(F.timestamp_seconds("s"), "yyyy-MM-dd")
    rows = X.strokes(s, d).select(F.col("intra").alias("variable"), day.alias("date"), F.concat_ws("_", day, F.col("i")).alias("file"), "current")
    return sinks.consolidate_days(rows, new_path(s, "days"))


def _kinds(s, d):
    """Points of two origins in one table, and apart again by their kind."""
    rows = X.strokes(s, d)
    both = rows.where("intra = 'IC'").select("id", "i", "j", "current", F.lit("event").alias("kind")).unionByName(rows.where("intra = 'CG'").select("id", "i", "j", "current", F.lit("flash").alias("kind")))
    return both.groupBy("kind", "i", "j").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("current"), 4).alias("energy"))


_TYPES = ["click", "view", "purchase"]
_SPLIT = "CASE WHEN slot % 10 < 7 THEN 'train' WHEN slot % 10 < 9 THEN 'validation' ELSE 'test' END"
_DAY = "strftime(to_timestamp(s) AT TIME ZONE 'UTC', '%Y-%m-%d')"
_COAL = "co AS (SELECT o_custkey % 32 AS bits, round(avg(o_totalprice::DOUBLE), 4) AS score FROM orders GROUP BY ALL)"
_FILES = "f AS (SELECT DISTINCT slot * 3600 AS s FROM active)"
_FILE = "'lightning_density_' || strftime(to_timestamp(s) AT TIME ZONE 'UTC', '%Y%m%d_%H%M') || '.nc'"
_TENTHS = "[0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]"
_KNOTS = f"k0 AS (SELECT lead, quantile_cont(y_pred, {_TENTHS}) AS s, quantile_cont(y_pred * y_pred * 2, {_TENTHS}) AS t FROM predictions GROUP BY lead), k AS (SELECT lead, [round(z, 6) FOR z IN s] AS s, [round(z, 6) FOR z IN t] AS t FROM k0)"
QUERIES = {
    "rain_histogram_loss": (lambda s, d: _hist(R.accumulated(_rain(s, d), ["g"], 0.1, 12.0), "g"), _loss_sql("SELECT g, sum(CASE WHEN r < 0.1 THEN 0 ELSE r END) / 12 AS total FROM rain GROUP BY g", "g")),
    "rain_running_loss": (lambda s, d: _hist(R.running_rain(_rain(s, d), ["g"], "step", 0.1), "g", "step"), _loss_sql("SELECT g, step, avg(CASE WHEN r < 0.1 THEN 0 ELSE r END) OVER (PARTITION BY g ORDER BY step ROWS UNBOUNDED PRECEDING) AS total FROM rain", "g, step")),
    "rain_lognormal_loss": (
        lambda s, d: X.predictions(s, d).select("id", F.round(R.soft_cross_entropy(F.col("y_pred") * 0.5 + 0.25, F.lit(0.3) + 0.4 * F.col("y_true")), 6).alias("soft"), F.round(R.gaussian_cross_entropy(R.log_mean(F.log10(F.col("y_pred") + 0.1)), F.lit(R.SIGMA), F.lit(-0.5), F.lit(0.7)), 6).alias("gauss")),
        f"WITH {_PR} SELECT id, round(-((y_pred * 0.5 + 0.25) * ln(0.3 + 0.4 * y_true::DOUBLE) + (0.75 - y_pred * 0.5) * ln(0.7 - 0.4 * y_true::DOUBLE)), 6) AS soft, round(0.5 * (pow(0.3215 / 0.7::DOUBLE, 2) + pow((ln(10.0::DOUBLE) * log10(y_pred + 0.1::DOUBLE) - 0.3215 * 0.3215::DOUBLE / 2 + 0.5) / 0.7, 2) - 1) - ln(0.3215 / 0.7::DOUBLE), 6) AS gauss FROM predictions",
    ),
    "upscale": (
        lambda s, d: G.upscale(X.patch8(s, d), ["patch"], 8).select("patch", "i", "j", r6("v").alias("v")),
        f"WITH {_P8}, t AS (SELECT patch, i, j, i // 4 AS i0, least(i // 4 + 1, 7) AS i1, j // 4 AS j0, least(j // 4 + 1, 7) AS j1, (i % 4) / 4.0 AS fi, (j % 4) / 4.0 AS fj FROM (SELECT DISTINCT patch FROM patch8), (SELECT unnest(range(0, 32)) AS i), (SELECT unnest(range(0, 32)) AS j)) SELECT t.patch, t.i, t.j, round((1 - fi) * (1 - fj) * a.v + (1 - fi) * fj * b.v + fi * (1 - fj) * c.v + fi * fj * e.v, 6) AS v FROM t JOIN patch8 a ON a.patch = t.patch AND a.i = i0 AND a.j = j0 JOIN patch8 b ON b.patch = t.patch AND b.i = i0 AND b.j = j1 JOIN patch8 c ON c.patch = t.patch AND c.i = i1 AND c.j = j0 JOIN patch8 e ON e.patch = t.patch AND e.i = i1 AND e.j = j1",
    ),
    "flow_warp": (
        lambda s, d: G.warp(X.patch8(s, d).withColumnRenamed("patch", "frame"), _motion(s, d), 8, 8),
        f"WITH {_P8}, m AS (SELECT patch, i, j, greatest(0, least(7 - 1e-9, i - (i % 3) * 0.5)) AS y, greatest(0, least(7 - 1e-9, j + (j % 2) * 0.75)) AS x FROM patch8), c AS (SELECT patch, i, j, CAST(floor(y) AS BIGINT) + a AS ci, CAST(floor(x) AS BIGINT) + b AS cj, (CASE a WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE b WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS w FROM m, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b)) SELECT c.patch AS frame, c.i, c.j, round(sum(w * p.v), 6) AS v FROM c JOIN patch8 p ON p.patch = c.patch AND p.i = ci AND p.j = cj GROUP BY ALL",
    ),
    "parallax_grid": (
        lambda s, d: G.relocate(_moved(s, d), 1, 0.8).select("frame", "i", "j", r6("si").alias("si"), r6("sj").alias("sj")),
        f"WITH {_PX}, m AS (SELECT frame, i, j, i + 0.3 * v / 50 AS y, j - 0.2::DOUBLE AS x FROM pixels), t AS (SELECT frame, i AS pi, j AS pj, y, x, CAST(floor(y + 0.5) AS BIGINT) + a AS i, CAST(floor(x + 0.5) AS BIGINT) + b AS j FROM m, (SELECT unnest([-1, 0, 1]) AS a), (SELECT unnest([-1, 0, 1]) AS b)), w AS (SELECT *, exp(-(pow(i - y, 2) + pow(j - x, 2)) / (2 * 0.8 * 0.8)::DOUBLE) AS w FROM t) SELECT frame, i, j, round(sum(w * pi) / sum(w), 6) AS si, round(sum(w * pj) / sum(w), 6) AS sj FROM w GROUP BY ALL",
    ),
    "affine_grid": (
        lambda s, d: X.strokes(s, d).select("id", G.to_pixel(F.col("lon"), F.col("lat"), 20.0, 48.5, 0.25).alias("p")).select("id", r6("p.i").alias("i"), r6("p.j").alias("j"), G.from_pixel(F.col("p.i"), F.col("p.j"), 20.0, 48.5, 0.25).alias("b")).select("id", "i", "j", r6("b.x").alias("x"), r6("b.y").alias("y")),
        f"WITH {_S} SELECT id, round((48.5 - lat) / 0.25, 6)::DOUBLE AS i, round((lon - 20) / 0.25, 6)::DOUBLE AS j, lon::DOUBLE AS x, lat::DOUBLE AS y FROM strokes",
    ),
    "coordinate_pairs": (
        lambda s, d: G.coordinate_pairs(X.strokes(s, d).select("id", "i", "j"), *_axes(s, d), 40, 80).select("id", r6("lat").alias("lat"), r6("lon").alias("lon")),
        f"WITH {_S} SELECT id, round(48.5 - least(i, 39) * 5.5 / 39::DOUBLE, 6) AS lat, round(20 + least(j, 79) * 10 / 79::DOUBLE, 6) AS lon FROM strokes",
    ),
    "spaced_sample": (_spaced, None),  # a sequential choice; tests compare with it
    "samples_per_date": (lambda s, d: P.samples_per_date(X.patch_active(s, d).withColumn("date", F.floor(F.col("slot") / 24)), "date"), f"WITH {X.sql_active()}, c AS (SELECT slot // 24 AS date, count(*) AS n FROM active GROUP BY ALL) SELECT date, n, round((SELECT avg(n) FROM c), 6) AS mean FROM c"),
    "paired_ranges": (lambda s, d: P.paired_ranges(X.strokes(s, d), "intra", "current", F.col("current") > -50, "i"), f"WITH {_S} SELECT intra, min(current) FILTER (current > -50) AS low, max(current) FILTER (current > -50) AS high, count(*) FILTER (current > -50) AS n_valid, count(DISTINCT i) FILTER (current > -50) AS n_patches FROM strokes GROUP BY intra"),
    "exclusion_table": (lambda s, d: P.exclusion_table(_coalitions(s, d), _NAMES, _COLS), f"WITH {_COAL} SELECT bits % 8 AS row, " + ", ".join(f"max(score) FILTER (bits // 8 = {k}) AS c{k}" for k in range(4)) + " FROM co GROUP BY 1"),
    "ensemble_weights": (
        lambda s, d: P.ensemble_weights(_models(s, d), ["m1", "m2"], "y_true", 0.01).select("model", F.round("weight", 6).alias("weight")),
        f"WITH {_PR}, {_SQL_MODELS}, g AS (SELECT avg(m1 * m1) + 0.01 AS a, avg(m1 * m2) AS b, avg(m2 * m2) + 0.01 AS c, avg(m1 * y_true) AS y1, avg(m2 * y_true) AS y2 FROM m) SELECT 'm1' AS model, round((c * y1 - b * y2) / (a * c - b * b), 6) AS weight FROM g UNION ALL SELECT 'm2', round((a * y2 - b * y1) / (a * c - b * b), 6) FROM g",
    ),
    "model_correlation": (
        lambda s, d: P.model_correlation(_models(s, d), ["m1", "m2", "y_true"]).select("a", "b", r6("r").alias("r")),
        f"WITH {_PR}, {_SQL_MODELS} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM m" for a in ("m1", "m2", "y_true") for b in ("m1", "m2", "y_true")),
    ),
    "quantile_mapped": (
        _mapped,
        f"WITH {_PR}, {_KNOTS}, j AS (SELECT id, p.lead, y_pred AS x, s, t, greatest(1, least(10, len([z FOR z IN s IF z <= y_pred]))) AS n FROM predictions p JOIN k USING (lead)) SELECT id, lead, round(CASE WHEN s[1] = s[11] THEN x WHEN x <= s[1] THEN t[1] WHEN x >= s[11] THEN t[11] ELSE t[n] + greatest(0, least(1, CASE WHEN s[n+1] > s[n] THEN (x - s[n]) / (s[n+1] - s[n]) ELSE 0 END)) * (t[n+1] - t[n]) END, 5) AS mapped FROM j",
    ),
    "sample_inputs": (
        _inputs,
        f"WITH {_S}, f AS (SELECT s // 3600 AS t, intra AS variable, count(*)::DOUBLE AS v FROM strokes GROUP BY ALL), r AS (SELECT DISTINCT t FROM f) SELECT r.t, variable, k AS step, v FROM r, (SELECT unnest([-2, -1, 0]) AS k), f WHERE f.t = r.t + k AND variable = 'CG' UNION ALL SELECT r.t, variable, k, v FROM r, (SELECT unnest([1, 2]) AS k), f WHERE f.t = r.t + k AND variable = 'IC' UNION ALL SELECT t, 'height', 0, (SELECT max(lat) FROM strokes) FROM r",
    ),
    "variable_hooks": (_hooked, f"WITH {_S} SELECT id, round(CASE intra WHEN 'CG' THEN abs(current) ELSE greatest(0, current) END, 4) AS current FROM strokes"),
    "training_store": (_training, f"WITH {X.sql_active()} SELECT {_SPLIT} AS split, count(*) AS n, 2 AS n_columns, CAST(sum(slot) AS BIGINT) AS slots, CAST(sum(patch_id) AS BIGINT) AS patches FROM active GROUP BY 1"),
    "evaluation_report": (_report, f"WITH {_PR}, b AS (SELECT lead, y_true, y_pred FROM predictions UNION ALL SELECT 0, y_true, y_pred FROM predictions) SELECT lead, k, CAST(count(*) FILTER (y_true = 1 AND floor(y_pred * 10 + 1e-9) >= k) AS BIGINT) AS tp, CAST(count(*) FILTER (y_true = 0 AND floor(y_pred * 10 + 1e-9) >= k) AS BIGINT) AS fp FROM b, (SELECT CAST(unnest(range(0, 11)) AS INT) AS k) GROUP BY ALL"),
    "patch_bundle": (_bundle, f"WITH {_PX} SELECT frame, (i // 16) * 12 + j // 16 + 1 AS patch_id, count(*) FILTER (v > 49) = 0 AS empty, count(*) FILTER (v > 49) AS n FROM pixels GROUP BY ALL"),
    "score_files": (_scores, f"WITH {_COAL} SELECT " + " || ".join(f"CASE WHEN (bits >> {k}) % 2 = 1 THEN '{x}' ELSE '' END" for k, x in enumerate(_NAMES)) + " AS coalition, score FROM co"),
    "dated_discovery": (_discovered, f"WITH {X.sql_active(60)}, {_FILES} SELECT {_DAY} || '-Romania' AS folder, {_FILE} AS file, s FROM f"),
    "files_before": (_before, f"WITH {X.sql_active(60)}, {_FILES}, t AS (SELECT DISTINCT floor(epoch(ts) / 21600)::BIGINT * 21600 AS t FROM events) SELECT t, count(*) AS n, max_by({_FILE}, s) AS latest FROM t JOIN f ON s >= t - 7200 AND s < t GROUP BY t"),
    "patch_store": (_patch_store, f"WITH {_S} SELECT {_DAY} AS date, count(*) AS n, round(sum(current), 3) AS total FROM strokes WHERE intra = 'CG' GROUP BY 1"),
    "consolidated_days": (_consolidated, f"WITH {_S} SELECT intra AS variable, count(DISTINCT {_DAY}) AS days, count(DISTINCT {_DAY} || '_' || i) AS files, count(*) AS total FROM strokes GROUP BY 1"),
    "point_kinds": (_kinds, f"WITH {_S} SELECT CASE intra WHEN 'IC' THEN 'event' ELSE 'flash' END AS kind, i, j, count(*) AS n, round(sum(current), 4) AS energy FROM strokes GROUP BY ALL"),
    "stream_complete": (lambda s, d: jobs.drained(jobs.complete_steps(jobs.events_stream(s, d), _TYPES)), "WITH w AS (SELECT *, time_bucket(INTERVAL 15 MINUTES, ts) AS start FROM events), m AS (SELECT max(ts) - INTERVAL 10 MINUTES AS wm FROM events) SELECT CAST(epoch(start) AS BIGINT) AS start, count(DISTINCT event_type) FILTER (event_type IN ('click', 'view', 'purchase')) = 3 AS complete, concat_ws(',', CASE WHEN count(*) FILTER (event_type = 'click') = 0 THEN 'click' END, CASE WHEN count(*) FILTER (event_type = 'purchase') = 0 THEN 'purchase' END, CASE WHEN count(*) FILTER (event_type = 'view') = 0 THEN 'view' END) AS missing FROM w, m WHERE start + INTERVAL 15 MINUTES <= wm GROUP BY start"),
}
