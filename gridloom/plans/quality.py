"""Queries over dense 8 x 8 patches."""

from pyspark.sql import functions as F

from gridloom.functions.draws import drawn_sql
from gridloom.operators import grid as G
from gridloom.operators import patches as P
from gridloom.plans import fixtures as X

_Q = "WITH " + X.SQL_PATCH8
_GRAD = ", g AS (SELECT patch, CASE i WHEN 0 THEN lead(v) OVER a - v WHEN 7 THEN v - lag(v) OVER a ELSE (lead(v) OVER a - lag(v) OVER a) / 2 END AS gi, CASE j WHEN 0 THEN lead(v) OVER b - v WHEN 7 THEN v - lag(v) OVER b ELSE (lead(v) OVER b - lag(v) OVER b) / 2 END AS gj FROM patch8 WINDOW a AS (PARTITION BY patch, j ORDER BY i), b AS (PARTITION BY patch, i ORDER BY j))"
_N = "64"


def _vectors(s, d):
    return X.table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))


def _processed(s, d):
    return X.patch8(s, d).groupBy("patch", F.floor(F.col("i") / 2).alias("bi"), F.floor(F.col("j") / 2).alias("bj")).agg(F.round(F.avg("v"), 3).alias("v"))


QUERIES = {
    "patch_statistics": (
        lambda s, d: P.statistics(X.patch8(s, d)),
        _Q + ", m AS (SELECT patch, avg(v) AS mu, stddev_pop(v) AS sd FROM patch8 GROUP BY 1) SELECT patch, round(any_value(mu), 6) AS mean, round(any_value(sd), 6) AS std, min(v) AS min, max(v) AS max, round(quantile_cont(v, 0.5), 6) AS median, round(avg(pow((v - mu) / sd, 3)), 5) AS skew, round(avg(pow((v - mu) / sd, 4)) - 3, 5) AS kurtosis, round(max(v) - min(v), 6) AS range, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.75), 6) AS q75, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr, count(*) FILTER (v <> 0) AS nonzero, count(*) FILTER (v < 0) AS negative, count(*) FILTER (v > 0) AS positive FROM patch8 JOIN m USING (patch) GROUP BY patch",
    ),
    "gradient_statistics": (lambda s, d: P.gradient_statistics(G.gradient(X.patch8(s, d), ["patch"])), _Q + _GRAD + " SELECT patch, round(avg(sqrt(gi * gi + gj * gj)), 6) AS grad_mean, round(stddev_pop(sqrt(gi * gi + gj * gj)), 6) AS grad_std FROM g GROUP BY patch"),
    "histogram_entropy": (
        lambda s, d: P.histogram_entropy(X.patch8(s, d), 50, True),
        _Q + ", r AS (SELECT patch, v, min(v) OVER w AS lo, max(v) OVER w AS hi, count(*) OVER w AS n FROM patch8 WINDOW w AS (PARTITION BY patch)), c AS (SELECT patch, least(floor((v - lo) / ((hi - lo) / 50)), 49) AS k, count(*) / any_value(n)::DOUBLE AS h FROM r GROUP BY ALL) SELECT patch, round(-sum(h * log2(h + 1e-10)), 4) AS entropy FROM c GROUP BY patch",
    ),
    "histogram_entropy_density": (
        lambda s, d: P.histogram_entropy(X.patch8(s, d)),
        _Q + ", r AS (SELECT patch, v, min(v) OVER w AS lo, max(v) OVER w AS hi, count(*) OVER w AS n FROM patch8 WINDOW w AS (PARTITION BY patch)), c AS (SELECT patch, least(floor((v - lo) / ((hi - lo) / 50)), 49) AS k, count(*) / any_value(n)::DOUBLE / ((any_value(hi) - any_value(lo)) / 50) AS h FROM r GROUP BY ALL) SELECT patch, round(-sum(h * log2(h + 1e-10)), 4) AS entropy FROM c GROUP BY patch",
    ),
    "patch_anomalies": (
        lambda s, d: P.anomalies(X.patch8(s, d), 2.0),
        _Q + ", e AS (SELECT patch, avg(v) AS m, stddev_pop(v) AS s FROM patch8 GROUP BY 1), g AS (SELECT avg(m) AS mm, stddev_pop(m) AS ms, avg(s) AS sm, stddev_pop(s) AS ss FROM e) SELECT patch, round((m - mm) / ms, 5) AS z_mean, round((s - sm) / ss, 5) AS z_std, abs((m - mm) / ms) > 2 OR abs((s - sm) / ss) > 2 AS anomaly FROM e, g",
    ),
    "grid_structure": (
        lambda s, d: P.grid_structure(X.patch8(s, d)),
        _Q + ", r AS (SELECT patch, i, round(stddev_pop(v), 6) AS s FROM patch8 GROUP BY ALL), c AS (SELECT patch, j, round(stddev_pop(v), 6) AS s FROM patch8 GROUP BY ALL), a AS (SELECT patch, first(i ORDER BY s DESC, i) AS max_row, first(i ORDER BY s, i) AS min_row FROM r GROUP BY patch), b AS (SELECT patch, first(j ORDER BY s DESC, j) AS max_col, first(j ORDER BY s, j) AS min_col FROM c GROUP BY patch), u AS (SELECT patch, count(DISTINCT v) AS \"unique\" FROM patch8 GROUP BY patch) SELECT * FROM a JOIN b USING (patch) JOIN u USING (patch)",
    ),
    "pool_check": (
        lambda s, d: P.pool_check(X.patch8(s, d), _processed(s, d), 2),
        _Q + ", e AS (SELECT patch, i // 2 AS bi, j // 2 AS bj, avg(v) AS e, round(avg(v), 3) AS a FROM patch8 GROUP BY ALL) SELECT patch, round(avg(pow(e - a, 2)), 9) AS mse, round(corr(e, a), 5) AS corr, count(*) FILTER (abs(e - a) <= 1e-6 + 1e-5 * abs(a)) AS \"close\", bool_and(abs(e - a) <= 1e-6 + 1e-5 * abs(a)) AS all_close FROM e GROUP BY patch",
    ),
    "resize": (
        lambda s, d: P.resize(X.patch8(s, d), 8, 16),
        _Q + ", o AS (SELECT CAST(k AS BIGINT) AS o, least(CAST(floor(k * 7 / 15::DOUBLE + 1e-12) AS BIGINT), 6) AS a, k * 7 / 15::DOUBLE AS x FROM (SELECT unnest(range(0, 16)) AS k)), r AS (SELECT o, a + d AS p, abs(1 - d - (x - a)) AS w FROM o, (SELECT unnest([0, 1]) AS d)) SELECT patch, r.o AS i, c.o AS j, round(sum(v * r.w * c.w), 6) AS v FROM patch8 JOIN r ON r.p = patch8.i JOIN r c ON c.p = patch8.j GROUP BY ALL",
    ),
    "flip": (lambda s, d: P.flip(X.patch8(s, d), 8, 8, True, False, True), _Q + " SELECT patch, 7 - j AS i, i AS j, v FROM patch8"),
    "augment": (lambda s, d: P.augment(X.patch8(s, d), 8, 16, 1), f"WITH {X.SQL_PATCH8}, h AS (SELECT *, {drawn_sql("'1-' || (patch // 16)", '8')} AS h FROM patch8), t AS (SELECT patch, h, v, CASE WHEN h % 2 = 1 THEN j ELSE i END AS a, CASE WHEN h % 2 = 1 THEN i ELSE j END AS b FROM h) SELECT patch, CASE WHEN h // 2 % 2 = 1 THEN 7 - a ELSE a END AS i, CASE WHEN h // 4 % 2 = 1 THEN 7 - b ELSE b END AS j, v FROM t"),
    "boxes": (lambda s, d: X.patch_active(s, d).select("slot", "patch_id", F.explode(P.boxes(F.col("patch_id"), 256, 64, 6)).alias("b")).select("slot", "patch_id", "b.*"), f"WITH {X.sql_active()} SELECT slot, patch_id, (patch_id - 1) // 6 * 256 + a AS i0, (patch_id - 1) // 6 * 256 + a + 64 AS i1, (patch_id - 1) % 6 * 256 + b AS j0, (patch_id - 1) % 6 * 256 + b + 64 AS j1 FROM active, (SELECT unnest(range(0, 256, 64)) AS a), (SELECT unnest(range(0, 256, 64)) AS b)"),
    "tile_sums": (lambda s, d: P.tile_arrays(X.patch8(s, d)).select("patch", F.size("values").alias("n"), F.round(F.get("values", F.lit(9)), 6).alias("v9"), F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 5).alias("total")), _Q + " SELECT patch, CAST(count(*) AS INT) AS n, round(max(v) FILTER (i = 1 AND j = 1), 6) AS v9, round(sum(v), 5) AS total FROM patch8 GROUP BY patch"),
    "pairwise_distance": (lambda s, d: P.pairwise_distance(X.patch8(s, d)), _Q + ", v AS (SELECT sum(s) AS s FROM (SELECT var_pop(v) AS s FROM patch8 GROUP BY i, j)), n AS (SELECT count(DISTINCT patch) AS n FROM patch8) SELECT round(2 * s * n / (n - 1), 6) AS mean_squared_distance FROM v, n"),
    "principal_components": (lambda s, d: P.principal_components(_vectors(s, d), "x", 8), None),
    "patch_clusters": (lambda s, d: P.clusters(_vectors(s, d), "vec_id", "x"), None),
}
