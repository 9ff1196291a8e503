"""Queries over declared predictors, resolved files and distances of patches."""

from pyspark.sql import functions as F

from gridloom.operators import distances, predictors
from gridloom.plans import fixtures as X

_S = X.SQL_STROKES


def _hourly(kind):
    def load(s, d):
        rows = X.strokes(s, d).where(F.col("intra") == kind)
        return rows.groupBy(F.floor(F.col("s") / 3600).alias("t"), (F.col("i") % 5).alias("key")).agg(F.round(F.sum(F.abs("current")), 4).alias("v"))

    return load


def declared(d) -> predictors.Catalog:
    """Sources of the given tables in folder ``d``, and what models read of them."""
    still = lambda s: X.table(s, d, "nation").select(F.lit(None).cast("long").alias("t"), (F.col("n_nationkey") % 5).alias("key"), F.length("n_name").alias("v")).groupBy("t", "key").agg(F.max("v").alias("v"))
    orders = lambda s: X.table(s, d, "orders").select((F.unix_date(F.col("o_orderdate").cast("date")) * 24).alias("t"), (F.col("o_orderkey") % 5).alias("key"), F.col("o_totalprice").cast("double").alias("v"))
    out = predictors.Catalog()
    out.add(predictors.Source("cg", lambda s: _hourly("CG")(s, d)), predictors.Source("ic", lambda s: _hourly("IC")(s, d)), predictors.Source("height", still), predictors.Source("orders", orders))
    out.add(
        predictors.Predictor("cg_log", ("cg",), lambda v: F.round(F.log10(F.when(v < 0.1, F.lit(0.1)).otherwise(v)), 6)),
        predictors.Predictor("excess", ("cg", "ic"), lambda a, b: F.round(F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0)), 4)),
        predictors.Predictor("ic_target", ("ic",), lambda v: (v > 50).cast("double"), "future"),
        predictors.Predictor("terrain", ("height",), lambda v: v / 10, "static"),
        predictors.Predictor("orders", ("orders",), lambda v: v),
    )
    return out


def _plan(s, d):
    references = X.strokes(s, d).select(F.floor(F.col("s") / 3600).alias("t"))
    return declared(d).plan(s, ["cg_log", "excess", "ic_target", "terrain"], references, 2, 3)


_VARIABLES = [v for known in predictors.PRODUCTS.values() for v in known]


def _requests(s, d):
    names = F.array(*map(F.lit, _VARIABLES + ["unknown"]))
    return X.strokes(s, d).select(F.get(names, (F.col("id") % (len(_VARIABLES) + 1)).cast("int")).alias("variable"), (F.floor(F.col("s") / 900) * 900).alias("s")).distinct()


def _paths(s, d):
    """Of the files of all requests a seventh is missing; every cloud file is there twice, under the names of two satellites."""
    asked = _requests(s, d)
    there = asked.join(F.broadcast(predictors.products(s)), "variable").where("s % 6300 <> 0").withColumn("key", predictors.file_key(F.col("product_group"), F.col("variable"), F.col("s")))
    cloud = F.split("key", "/")
    name = lambda sat: F.concat(F.lit("S_NWC_"), cloud[2], F.lit(f"_{sat}_Romania-VISIR_"), cloud[3], F.lit("Z.nc"))
    two = F.array(*[F.concat_ws("/", cloud[0], cloud[1], name(sat)) for sat in ("MSG4", "MSG3")])
    files = there.select(F.explode(F.when(F.col("product_group") == "nwcsaf", two).otherwise(F.array("key"))).alias("p")).select(F.concat(F.lit("file:/data/regridded_data/"), F.col("p")).alias("path")).distinct()
    return predictors.resolved_paths(asked, files).select("variable", "s", "product_group", "resolution", "pool", "path")


def _paths_sql():
    known = ", ".join(f"('{v}', '{g}', '{r}', {p})" for g, rows in predictors.PRODUCTS.items() for v, (r, p) in rows.items())
    names = ", ".join(f"'{v}'" for v in [*_VARIABLES, "unknown"])
    day, time, compact = ("strftime(t, '%Y-%m-%d')", "strftime(t, '%H%M')", "strftime(t, '%Y%m%d')")
    folder = f"variable || '/nc4_' || {day} || '-Romania_' || variable || '/'"
    plain = f"'nc4_' || {day} || '-Romania_' || {time} || '_' || variable || '.npy'"
    return f"""WITH {_S}, asked AS (SELECT DISTINCT ([{names}])[id % {len(_VARIABLES) + 1} + 1] AS variable, CAST(s // 900 * 900 AS BIGINT) AS s FROM strokes),
k(variable, product_group, resolution, pool) AS (VALUES {known}), j AS (SELECT asked.*, product_group, resolution, pool, to_timestamp(s) AT TIME ZONE 'UTC' AS t FROM asked LEFT JOIN k USING (variable))
SELECT variable, s, product_group, resolution, pool, CASE WHEN s % 6300 <> 0 THEN 'file:/data/regridded_data/' || CASE product_group
  WHEN 'radar' THEN 'radar_data/' || {folder} || {plain} WHEN 'satellite_MSG' THEN 'satellite_data/MSG/' || {folder} || {plain} WHEN 'satellite_MTG' THEN 'satellite_data/MTG/' || {folder} || {plain}
  WHEN 'lightning' THEN 'lightning_data/' || {folder} || 'lightning_' || variable || '_' || {compact} || '_' || {time} || '.npy'
  WHEN 'nwcsaf' THEN 'nwcsaf_data/' || {day} || '-Romania/S_NWC_' || upper(split_part(variable, '_', 1)) || '_MSG3_Romania-VISIR_' || {compact} || 'T' || {time} || '00Z.nc' END END AS path FROM j"""


def _distances(s, d):
    return distances.distance_statistics(X.table(s, d, "embeddings"), "vec_id", "embedding", 512)


QUERIES = {
    "predictor_plan": (
        _plan,
        f"""WITH {_S}, h AS (SELECT CAST(s // 3600 AS BIGINT) AS t, i % 5 AS key, round(sum(abs(current)) FILTER (intra = 'CG'), 4) AS cg, round(sum(abs(current)) FILTER (intra = 'IC'), 4) AS ic FROM strokes GROUP BY ALL),
p AS (SELECT t, key, 'past' AS timeframe, 'cg_log' AS predictor, round(log10(greatest(cg, 0.1)), 6) AS v FROM h WHERE cg IS NOT NULL UNION ALL SELECT t, key, 'past', 'excess', round(coalesce(cg, 0) - coalesce(ic, 0), 4) FROM h UNION ALL SELECT t, key, 'future', 'ic_target', CAST(ic > 50 AS INT)::DOUBLE FROM h WHERE ic IS NOT NULL),
r AS (SELECT DISTINCT t FROM h), w AS (SELECT t, step, CASE WHEN step > 0 THEN 'future' ELSE 'past' END AS timeframe FROM r, (SELECT CAST(unnest(range(-1, 4)) AS INT) AS step))
SELECT w.t, predictor, step, key, v FROM w JOIN p ON p.t = w.t + w.step AND p.timeframe = w.timeframe UNION ALL SELECT NULL, 'terrain', 0, n_nationkey % 5, max(length(n_name)) / 10::DOUBLE FROM nation GROUP BY ALL""",
    ),
    "resolved_paths": (_paths, _paths_sql()),
    "distance_statistics": (_distances, "WITH p AS (SELECT list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id) SELECT count(*) AS pairs, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS std FROM p"),
}
