"""Queries over scalar transforms and names."""

from pyspark.sql import functions as F

from gridloom.functions import names as N
from gridloom.functions import transforms as T
from gridloom.plans import fixtures as X

_L = "q AS (SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_orderkey % 97 = 0 THEN 'NaN'::DOUBLE ELSE CAST(l_extendedprice AS DOUBLE) / 1000 * (1 + l_orderkey % 40) / 7.3::DOUBLE END AS x FROM lineitem)"


def _values(s, d):
    x = F.when(F.col("l_orderkey") % 97 == 0, F.lit(float("nan"))).otherwise(F.col("l_extendedprice").cast("double") / 1000 * (1 + F.col("l_orderkey") % 40) / 7.3)
    return X.table(s, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), x.alias("x"))


def _fill(x, v):
    return f"(CASE WHEN isnan({x}) THEN {v} ELSE {x} END)"


_SQL = {
    "rzc": f"(log10(greatest({_fill('x', 0.01)}, 0.01)) + 0.051) / 0.528", "czc": f"({_fill('x', -5)} - 21.3) / 8.71", "ezc": f"{_fill('x', 0)} / 1.97", "lzc": f"(log10(greatest({_fill('x', 0.5)}, 0.5)) + 0.274) / 0.135", "bzc": f"{_fill('x', 0)} / 100",
    "cpch": f"log10(CASE WHEN {_fill('x', 0.01)} < 0.1 THEN 0.01 ELSE {_fill('x', 0.01)} END)", "density": f"(log10(greatest({_fill('x', 1e-4)}, 1e-4)) + 0.593) / 0.640", "current": f"(log10(greatest({_fill('x', 1e-8)}, 1e-8)) - 0.0718) / 0.731", "occurrence": f"least(1, greatest(0, {_fill('x', 0)}))",
    "visible": f"{_fill('x', 0)} / 100", "ir039": f"({_fill('x', 274)} - 274) / 17.5", "thermal": f"({_fill('x', 250)} - 250) / 10", "ctth_alti": "((CASE WHEN isnan(x) OR x > 60000 THEN -1000 ELSE x END) - 5260) / 2810", "ctth_tempe": "((CASE WHEN isnan(x) OR x > 60000 THEN 330 ELSE x END) - 260) / 19.2",
    "cmic_cot": "(log10(greatest((CASE WHEN isnan(x) OR x > 60000 THEN 0.1 ELSE x END), 0.1)) - 0.94) / 0.588", "rain_label": f"least(70, greatest(0, {_fill('x', 0)})) / 70",
}


def _known(s, d):
    return X.table(s, d, "nation").select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("item"))


def _misspelt(s, d):
    n = X.table(s, d, "nation").select("n_nationkey", "n_name")
    rows = X.table(s, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select(F.concat(F.substring("n_name", 1, 4), F.lit("x"), F.expr("substring(n_name, 6)"), F.when(F.col("s_suppkey") % 3 == 0, "yyyy").otherwise("")).alias("name"))


_SEC = "CAST(floor(epoch(ts)) AS BIGINT)"
QUERIES = {
    "transforms": (lambda s, d: _values(s, d).select("k", "n", *[F.round(f(F.col("x")), 10).alias(v) for v, f in T.TRANSFORMS.items()]), f"WITH {_L} SELECT k, n, " + ", ".join(f"round(({e})::DOUBLE, 10) + 0 AS {v}" for v, e in _SQL.items()) + " FROM q"),
    "rain_class": (lambda s, d: _values(s, d).select("k", "n", T.rain_class(F.col("x")).alias("c")), f"WITH {_L} SELECT k, n, CASE WHEN {_fill('x', 0)} < 10 THEN 0 WHEN {_fill('x', 0)} < 20 THEN 1 WHEN {_fill('x', 0)} < 30 THEN 2 WHEN {_fill('x', 0)} < 40 THEN 3 ELSE 4 END AS c FROM q"),
    "phase_one_hot": (lambda s, d: X.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.aggregate(F.transform(T.phase_one_hot((F.col("l_quantity") % 7).cast("double") * 0.75), lambda x, i: x.cast("int") * F.pow(F.lit(10), i).cast("int")), F.lit(0), lambda a, x: a + x).alias("bits")), "WITH c AS (SELECT l_orderkey, l_linenumber, CAST(round_even((l_quantity % 7)::DOUBLE * 0.75, 0) AS INT) AS c FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN c BETWEEN 1 AND 4 THEN CAST(pow(10, c - 1) AS INT) ELSE 10000 END AS bits FROM c"),
    "class_confidence": (lambda s, d: X.predictions(s, d).select("id", F.round(T.class_confidence(F.col("y_pred"), [0.0, 0.2, 0.5, 0.8, 1.0]), 6).alias("confidence")), f"WITH {X.SQL_PREDICTIONS}, c AS (SELECT id, y_pred AS p, CASE WHEN y_pred < 0.2 THEN [0.0, 0.2] WHEN y_pred < 0.5 THEN [0.2, 0.5] WHEN y_pred < 0.8 THEN [0.5, 0.8] WHEN y_pred < 1 THEN [0.8, 1.0] END::DOUBLE[] AS b FROM predictions) SELECT id, round(CASE WHEN b IS NULL THEN 0 ELSE greatest(0::DOUBLE, least(1::DOUBLE, 1 - abs(p - (b[1] + b[2]) / 2) / ((b[2] - b[1]) / 2))) END, 6) AS confidence FROM c"),
    "log_quantize": (lambda s, d: X.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", T.log_quantize(F.col("l_extendedprice").cast("double"), 1000.0, 60000.0, 50).alias("code")), "WITH x AS (SELECT l_orderkey, l_linenumber, l_extendedprice::DOUBLE AS x, (log10(60000::DOUBLE) - log10(1000::DOUBLE)) / 49 AS st FROM lineitem), a AS (SELECT *, (log10(greatest(x, 1000)) - log10(1000::DOUBLE)) / st AS t FROM x) SELECT l_orderkey, l_linenumber, CAST(CASE WHEN x < 1000 THEN 0 WHEN x >= 60000 THEN 50 WHEN t < 1 THEN 1 ELSE floor(t + 0.5) + 1 END AS INT) AS code FROM a"),
    "lookup_decode": (lambda s, d: T.decode(X.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("int") + 5).alias("code")), T.scale_table(s, 0.1, 100.0, 50), 4.0).withColumn("value", F.round("value", 6)), "WITH c AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) + 5 AS code FROM lineitem) SELECT l_orderkey, l_linenumber, code, round(log10(CASE WHEN code BETWEEN 1 AND 50 THEN pow(10::DOUBLE, -1 + (code - 1) * 3::DOUBLE / 49) ELSE 0 END + 4), 6) AS value FROM c"),
    "heat_index": (lambda s, d: X.strokes(s, d).select("id", F.round(T.heat_index(F.col("lat").cast("double") - 20, F.col("j").cast("double")), 4).alias("hi")), f"WITH {X.SQL_STROKES}, c AS (SELECT id, (lat::DOUBLE - 20) * 9 / 5 + 32 AS f, j::DOUBLE AS h FROM strokes) SELECT id, round((-42.379 + 2.04901523 * f + 10.14333127 * h - 0.22475541 * f * h - 6.83783e-3 * f * f - 5.481717e-2 * h * h + 1.22874e-3 * f * f * h + 8.5282e-4 * f * h * h - 1.99e-6 * f * f * h * h - 32) * 5 / 9, 4) AS hi FROM c"),
    "saturate": (lambda s, d: X.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", T.saturate(F.col("l_extendedprice").cast("double") - 30000, "smallint").cast("int").alias("y")), "SELECT l_orderkey, l_linenumber, CAST(trunc(greatest(-32768, least(32767, l_extendedprice::DOUBLE - 30000))) AS INT) AS y FROM lineitem"),
    "time_parts": (
        lambda s, d: X.strokes(s, d).select("id", N.hhmm(F.col("s")).alias("hhmm"), N.nearest_hour(F.col("s")).alias("hour"), N.hour_block(F.col("s"), 6).alias("block"), N.slot_of(F.col("s"), 1_704_100_000, 900).alias("slot")),
        f"SELECT event_id AS id, strftime(ts, '%H%M') AS hhmm, CAST(floor(({_SEC} + 1800) / 3600::DOUBLE) * 3600 AS BIGINT) AS hour, CAST(hour(ts) // 6 * 6 AS BIGINT) AS block, CAST(floor(({_SEC} - 1704100000) / 900::DOUBLE) AS BIGINT) AS slot FROM events",
    ),
    "radar_names": (
        lambda s, d: X.strokes(s, d).select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("RZC"), F.date_format(F.timestamp_seconds("s"), "yyDDDHHmm"), F.lit("VL.801.h5"))).otherwise(F.concat(F.lit("radar_"), F.date_format(F.timestamp_seconds("s"), "yyyyMMdd_HHmm"), F.lit(".nc"))).alias("name"))
        .select("id", F.date_format(N.radar_time(F.col("name")), "yyyy-MM-dd HH:mm").alias("time"), N.quarter_hour(F.col("name")).alias("quarter")),
        "SELECT event_id AS id, strftime(ts, '%Y-%m-%d %H:%M') AS time, minute(ts) % 15 = 0 AS quarter FROM events",
    ),
    "path_parts": (lambda s, d: X.table(s, d, "pages").select("page_id", N.path_parts(F.regexp_replace("url", r"[?#].*$", "")).alias("p")).select("page_id", "p.*"), "WITH u AS (SELECT page_id, list_filter(string_split(regexp_replace(url, '[?#].*$', ''), '/'), lambda x: x <> '') AS p FROM pages) SELECT page_id, p[-2] AS folder, p[-1] AS file, regexp_replace(p[-1], '\\.[^.]*$', '') AS stem, regexp_extract(p[-1], '\\.([^.]*)$', 1) AS extension FROM u"),
    "clean_names": (lambda s, d: X.strokes(s, d).select("id", N.clean_name(F.concat(F.lit("nc4_"), F.date_format(F.timestamp_seconds("s"), "yyyy-MM-dd"), F.lit("-"), F.col("intra"), F.when(F.col("id") % 3 == 0, "##a b").otherwise(""))).alias("name")), f"WITH {X.SQL_STROKES} SELECT id, lower(intra) || CASE WHEN id % 3 = 0 THEN '##a b' ELSE '' END AS name FROM strokes"),
    "best_match": (lambda s, d: N.best_match(_misspelt(s, d), _known(s, d)), "WITH m AS (SELECT DISTINCT substring(n_name, 1, 4) || 'x' || substring(n_name, 6) || CASE WHEN s_suppkey % 3 = 0 THEN 'yyyy' ELSE '' END AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey), b AS (SELECT name, n_name AS item, levenshtein(lower(name), lower(n_name)) AS d, n_nationkey AS pos FROM m, nation WHERE levenshtein(lower(name), lower(n_name)) <= 3 QUALIFY row_number() OVER (PARTITION BY name ORDER BY d, pos) = 1) SELECT name, item, CAST(d AS INT) AS distance FROM m LEFT JOIN b USING (name)"),
    "name_by_size": (lambda s, d: N.name_by_size(X.table(s, d, "documents").groupBy(F.col("source").alias("name")).count().withColumnRenamed("count", "n"), X.table(s, d, "region").select(F.col("r_regionkey").cast("long").alias("pos"), F.col("r_name").alias("item"))), "WITH g AS (SELECT source AS name, count(*) AS n FROM documents GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY n DESC, name) - 1 AS k FROM g) SELECT name, n, CASE WHEN k < 5 THEN r_name ELSE r_name || '_' || (k // 5) END AS given FROM k JOIN region ON r_regionkey = k % 5"),
}
