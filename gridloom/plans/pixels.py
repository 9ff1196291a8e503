"""Queries over the pixel frames."""

import math

from pyspark.sql import functions as F

from gridloom.operators import grid as G
from gridloom.plans import fixtures as X

_P = X.SQL_PIXELS
_DISC = "(SELECT a.d AS di, b.d AS dj FROM (SELECT unnest(range(-{r}, {r} + 1)) AS d) a, (SELECT unnest(range(-{r}, {r} + 1)) AS d) b WHERE a.d * a.d + b.d * b.d <= {r} * {r})"
_SQUARE = "(SELECT a.d AS di, b.d AS dj FROM (SELECT unnest(range(-1, 2)) AS d) a, (SELECT unnest(range(-1, 2)) AS d) b)"
_MASK = f"""hits AS (SELECT frame, i, j FROM pixels WHERE v > 45),
sc AS (SELECT frame, i + di AS i, j + dj AS j FROM hits, {_DISC.format(r=5)}),
cores AS (SELECT h.frame, h.i, h.j FROM hits h JOIN (SELECT frame, i, j, count(*) AS n FROM sc GROUP BY ALL) c USING (frame, i, j) WHERE n >= 12),
reach AS (SELECT DISTINCT frame, i + di AS i, j + dj AS j FROM cores, {_DISC.format(r=5)}),
mask AS (SELECT h.* FROM hits h JOIN reach USING (frame, i, j))"""


def _mask(s, d):
    return G.density_mask(X.pixels(s, d), 45, 5, 12)


def _regions(s, d):
    return G.connected_regions(X.pixels(s, d).where("v > 47"))


_REGIONS = f"""WITH RECURSIVE {_P}, h AS (SELECT frame, i * 1048576 + j AS node, i, j FROM pixels WHERE v > 47),
e AS (SELECT a.frame, a.node AS a, b.node AS b FROM h a, {_SQUARE} o, h b WHERE b.frame = a.frame AND b.i = a.i + o.di AND b.j = a.j + o.dj),
r AS (SELECT frame, node, node AS label FROM h UNION SELECT e.frame, e.b AS node, r.label FROM r JOIN e ON e.frame = r.frame AND e.a = r.node),
lab AS (SELECT frame, node, min(label) AS label FROM r GROUP BY ALL)"""


def _points(s, d):
    return X.strokes(s, d).select("id", F.floor(F.col("id") / 4000).alias("frame"), (F.col("i") * 1.5 + 0.25).cast("double").alias("y"), (F.col("j") * 1.25).cast("double").alias("x"))


def _sources(s, d):
    rows = X.table(s, d, "customer")
    return rows.select(F.col("c_custkey").alias("sid"), ((F.col("c_custkey") * 37 % 1000) / 10).alias("x"), ((F.col("c_custkey") * 91 % 777) / 10).alias("y"))


def _targets(s, d):
    rows = X.table(s, d, "part")
    return rows.select(F.col("p_partkey").alias("tid"), ((F.col("p_partkey") * 53 % 991) / 10).alias("x"), ((F.col("p_partkey") * 29 % 769) / 10).alias("y"))


def _gauss(a, b):
    return math.exp(-(a * a + b * b) / 8) if a * a + b * b <= 16 else 0


QUERIES = {
    "patch_of_pixel": (lambda s, d: X.pixels(s, d).select("frame", "i", "j", G.patch_id(F.col("i"), F.col("j"), 32, 6).alias("patch_id")), f"WITH {_P} SELECT frame, i, j, (i // 32) * 6 + j // 32 + 1 AS patch_id FROM pixels"),
    "patch_bounds": (lambda s, d: X.patch_active(s, d).select("slot", "patch_id", G.patch_bounds(F.col("patch_id"), 256, 6).alias("b")).select("slot", "patch_id", "b.*"), f"WITH {X.sql_active()} SELECT slot, patch_id, (patch_id - 1) // 6 * 256 AS i0, (patch_id - 1) // 6 * 256 + 256 AS i1, (patch_id - 1) % 6 * 256 AS j0, (patch_id - 1) % 6 * 256 + 256 AS j1 FROM active"),
    "area_threshold": (lambda s, d: G.area_threshold(X.pixels(s, d), 45, 2), f"WITH {_P}, s AS (SELECT frame, i + di AS i, j + dj AS j FROM pixels, {_DISC.format(r=2)} WHERE v > 45), n AS (SELECT frame, i, j, count(*) AS n FROM s GROUP BY ALL) SELECT p.frame, p.i, p.j, n.n FROM pixels p JOIN n USING (frame, i, j)"),
    "density_mask": (_mask, f"WITH {_P}, {_MASK} SELECT * FROM mask"),
    "density_patches": (lambda s, d: G.active_patches(_mask(s, d), 32, 6), f"WITH {_P}, {_MASK} SELECT DISTINCT frame, (i // 32) * 6 + j // 32 + 1 AS patch_id FROM mask"),
    "connected_regions": (_regions, _REGIONS + " SELECT frame, node // 1048576 AS i, node % 1048576 AS j, label FROM lab"),
    "region_table": (lambda s, d: G.region_table(_regions(s, d), 2), _REGIONS + " SELECT frame, label, count(*) AS area, CAST(floor(avg(node // 1048576)) AS BIGINT) AS ci, CAST(floor(avg(node % 1048576)) AS BIGINT) AS cj FROM lab GROUP BY ALL HAVING count(*) >= 2"),
    "largest_regions": (lambda s, d: G.region_table(_regions(s, d), 1, 5), _REGIONS + " SELECT frame, label, count(*) AS area, CAST(floor(avg(node // 1048576)) AS BIGINT) AS ci, CAST(floor(avg(node % 1048576)) AS BIGINT) AS cj, CAST(row_number() OVER (PARTITION BY frame ORDER BY count(*) DESC, label) AS INT) AS rank FROM lab GROUP BY frame, label QUALIFY rank <= 5"),
    "average_pool": (lambda s, d: G.average_pool(X.pixels(s, d), 7, 96, 192), f"WITH {_P} SELECT frame, i // 7 AS bi, j // 7 AS bj, round(avg(v), 6) AS v FROM pixels WHERE i < 91 AND j < 189 GROUP BY ALL"),
    "average_pool_missing": (lambda s, d: G.average_pool_missing(X.pixels(s, d), 4, 50), f"WITH {_P} SELECT frame, i // 4 AS bi, j // 4 AS bj, round(CASE WHEN count(*) FILTER (v <> 50) >= 8 THEN avg(v) FILTER (v <> 50) ELSE 50 END, 6) AS v FROM pixels GROUP BY ALL"),
    "mode_pool": (lambda s, d: G.mode_pool(X.pixels(s, d), 8), f"WITH {_P}, n AS (SELECT frame, i // 8 AS bi, j // 8 AS bj, v, count(*) AS n FROM pixels GROUP BY ALL) SELECT frame, bi, bj, v FROM n QUALIFY row_number() OVER (PARTITION BY frame, bi, bj ORDER BY n DESC, v) = 1"),
    "gradient": (
        lambda s, d: G.gradient(X.patch8(s, d), ["patch"]).withColumns({c: F.round(c, 6) for c in ("gi", "gj")}),
        f"WITH {X.SQL_PATCH8} SELECT patch, i, j, round(CASE i WHEN 0 THEN lead(v) OVER a - v WHEN 7 THEN v - lag(v) OVER a ELSE (lead(v) OVER a - lag(v) OVER a) / 2 END, 6) AS gi, round(CASE j WHEN 0 THEN lead(v) OVER b - v WHEN 7 THEN v - lag(v) OVER b ELSE (lead(v) OVER b - lag(v) OVER b) / 2 END, 6) AS gj FROM patch8 WINDOW a AS (PARTITION BY patch, j ORDER BY i), b AS (PARTITION BY patch, i ORDER BY j)",
    ),
    "moving_mean": (
        lambda s, d: G.moving_mean(X.patch8(s, d), ["patch"], 2),
        f"WITH {X.SQL_PATCH8} SELECT p.patch, p.i, p.j, round(CASE WHEN p.i BETWEEN 2 AND 5 AND p.j BETWEEN 2 AND 5 THEN avg(q.v) ELSE 0 END, 6) + 0 AS mean FROM patch8 p JOIN patch8 q ON q.patch = p.patch AND abs(q.i - p.i) <= 2 AND abs(q.j - p.j) <= 2 GROUP BY p.patch, p.i, p.j",
    ),
    "local_maxima": (lambda s, d: G.local_maxima(X.patch8(s, d), ["patch"], 2), f"WITH {X.SQL_PATCH8} SELECT p.patch, p.i, p.j, p.v FROM patch8 p JOIN patch8 q ON q.patch = p.patch AND abs(q.i - p.i) <= 2 AND abs(q.j - p.j) <= 2 GROUP BY ALL HAVING p.v = max(q.v)"),
    "fill_holes": (lambda s, d: G.fill_holes(X.pixels(s, d), 96, 192), f"WITH {_P}, n AS (SELECT frame, i + di AS i, j + dj AS j, v FROM pixels, {_SQUARE}), m AS (SELECT frame, i, j, round(avg(v), 6) AS v FROM n WHERE i BETWEEN 0 AND 95 AND j BETWEEN 0 AND 191 GROUP BY ALL) SELECT m.* FROM m ANTI JOIN pixels USING (frame, i, j)"),
    "kernel_sum": (lambda s, d: G.kernel_sum(X.pixels(s, d), 4, _gauss), f"WITH {_P} SELECT frame, i + di AS i, j + dj AS j, round(sum(v * exp(-(di * di + dj * dj) / 8::DOUBLE)), 6) AS s FROM pixels, {_DISC.format(r=4)} GROUP BY ALL"),
    "zero_patches": (lambda s, d: G.zero_patches(X.pixels(s, d), F.col("v") > 49, 16, 12), f"WITH {_P} SELECT frame, (i // 16) * 12 + j // 16 + 1 AS patch_id, count(*) FILTER (v > 49) AS n, count(*) FILTER (v > 49) = 0 AS is_zero FROM pixels GROUP BY ALL"),
    "nonzero_fraction": (lambda s, d: G.nonzero_fraction(X.table(s, d, "lineitem").select("l_returnflag", F.col("l_discount").cast("double").alias("v")), "l_returnflag", "v"), "WITH b AS (SELECT l_returnflag AS product, CAST(l_discount AS DOUBLE) AS v FROM lineitem UNION ALL SELECT NULL, CAST(l_discount AS DOUBLE) FROM lineitem) SELECT product, count(*) FILTER (v <> 0) AS ones, count(*) AS total, round(count(*) FILTER (v <> 0) / count(*)::DOUBLE, 6) AS fraction, CAST(floor(count(*) / (count(*) FILTER (v <> 0))::DOUBLE) AS BIGINT) AS ratio FROM b GROUP BY product"),
    "bilinear_sample": (
        lambda s, d: G.bilinear_sample(X.pixels(s, d), _points(s, d)),
        f"WITH {_P}, {X.SQL_STROKES}, pt AS (SELECT id, id // 4000 AS frame, CAST(i * 1.5 + 0.25 AS DOUBLE) AS y, CAST(j * 1.25 AS DOUBLE) AS x FROM strokes), c AS (SELECT id, frame, CAST(floor(y) AS BIGINT) + a AS i, CAST(floor(x) AS BIGINT) + b AS j, (CASE a WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE b WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS w FROM pt, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b)) SELECT id, round(CASE WHEN count(v) = 4 THEN sum(w * v) END, 6) AS v FROM c LEFT JOIN pixels USING (frame, i, j) GROUP BY id",
    ),
    "nearest_neighbour": (
        lambda s, d: G.nearest_neighbour(_targets(s, d), _sources(s, d), 2.0),
        "WITH s AS (SELECT c_custkey AS sid, (c_custkey * 37 % 1000) / 10::DOUBLE AS x, (c_custkey * 91 % 777) / 10::DOUBLE AS y FROM customer), t AS (SELECT p_partkey AS tid, (p_partkey * 53 % 991) / 10::DOUBLE AS x, (p_partkey * 29 % 769) / 10::DOUBLE AS y FROM part), p AS (SELECT tid, sid, round(pow(t.x - s.x, 2) + pow(t.y - s.y, 2), 9) AS d2 FROM t JOIN s ON abs(t.x - s.x) <= 2.1 AND abs(t.y - s.y) <= 2.1) SELECT tid, sid, round(sqrt(d2), 6) AS dist FROM p WHERE d2 <= 4 QUALIFY row_number() OVER (PARTITION BY tid ORDER BY d2, sid) = 1",
    ),
}
