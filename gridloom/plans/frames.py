"""Queries over whole frames: density clusters with labels, and reports."""

from pyspark.sql import functions as F

from gridloom.operators import clusters as K
from gridloom.operators import grid as G
from gridloom.operators import insight as I
from gridloom.plans import fixtures as X
from gridloom.sources import containers as C

_PX = X.SQL_PIXELS
_EPS, _MIN, _OVER = 5, 12, 45
_DISC = "(SELECT a.d AS di, b.d AS dj FROM (SELECT unnest(range(-{r}, {r} + 1)) AS d) a, (SELECT unnest(range(-{r}, {r} + 1)) AS d) b WHERE a.d * a.d + b.d * b.d <= {r} * {r})"
_W = K.WIDTH

#: All pairs within the disc, cores, their components by the recursion, and the nearest core of each other hit.
_SQL_CLUSTERS = f"""{_PX}, h AS (SELECT frame, i, j, i * {_W} + j AS p FROM pixels WHERE v > {_OVER}),
near AS (SELECT a.frame, a.p AS a, b.p AS b, o.di * o.di + o.dj * o.dj AS d2 FROM h a, {_DISC.format(r=_EPS)} o, h b WHERE b.frame = a.frame AND b.i = a.i + o.di AND b.j = a.j + o.dj),
cores AS (SELECT frame, a AS p FROM near GROUP BY ALL HAVING count(*) >= {_MIN}),
edges AS (SELECT n.frame, n.a, n.b FROM near n JOIN cores c ON c.frame = n.frame AND c.p = n.a JOIN cores d ON d.frame = n.frame AND d.p = n.b),
r AS (SELECT frame, p, p AS label FROM cores UNION SELECT e.frame, e.b AS p, r.label FROM r JOIN edges e ON e.frame = r.frame AND e.a = r.p),
named AS (SELECT frame, p, min(label) AS label FROM r GROUP BY ALL),
border AS (SELECT n.frame, n.a AS p, arg_min(c.label, (n.d2, n.b)) AS label FROM near n JOIN named c ON c.frame = n.frame AND c.p = n.b WHERE NOT EXISTS (FROM cores k WHERE k.frame = n.frame AND k.p = n.a) GROUP BY ALL),
clusters AS (SELECT h.frame, h.i, h.j, coalesce(c.label, b.label) AS label, c.label IS NOT NULL AS core FROM h LEFT JOIN named c USING (frame, p) LEFT JOIN border b USING (frame, p))"""


def _clusters(s, d):
    return K.density_clusters(X.pixels(s, d), _OVER, _EPS, _MIN)


_ON, _STRONG, _H, _WD = 10, 47, 96, 192


def _insight(s, d):
    pixels = X.pixels(s, d)
    return I.frame_insight(pixels, C.dense_lines(pixels, ["frame"], _H, _WD), _ON, _STRONG, radius=1, eps=_EPS, min_points=_MIN)


def _insight_sql():
    taps = "(SELECT k, w / sum(w) OVER () AS w FROM (SELECT k, exp(-0.5 * (k / 2.0::DOUBLE) * (k / 2.0::DOUBLE)) AS w FROM (SELECT unnest(range(-8, 9)) AS k)))"
    cross = "(SELECT unnest([0, 0, 0, 1, -1]) AS di, unnest([0, 1, -1, 0, 0]) AS dj)"
    inside = f"i BETWEEN 0 AND {_H - 1} AND j BETWEEN 0 AND {_WD - 1}"
    spread = lambda t: f"(SELECT * FROM (SELECT DISTINCT frame, i + di AS i, j + dj AS j FROM {t}, {cross}) WHERE {inside})"
    along = lambda a, b: f"CASE WHEN {a} = 0 THEN lead(v) OVER {b} - v WHEN {a} = {(_H if a == 'i' else _WD) - 1} THEN v - lag(v) OVER {b} ELSE (lead(v) OVER {b} - lag(v) OVER {b}) / 2 END"
    cut = lambda p: f"quantile_cont(v, {p}) FILTER (v > {_ON})"
    clusters = _SQL_CLUSTERS.replace(f"v > {_OVER}", f"v > {_STRONG}")
    return f"""WITH RECURSIVE {clusters},
e8 AS (SELECT a.frame, a.p AS a, b.p AS b FROM h a, (SELECT x.d AS di, y.d AS dj FROM (SELECT unnest([-1, 0, 1]) AS d) x, (SELECT unnest([-1, 0, 1]) AS d) y) o, h b WHERE b.frame = a.frame AND b.i = a.i + o.di AND b.j = a.j + o.dj),
r8 AS (SELECT frame, p, p AS label FROM h UNION SELECT e8.frame, e8.b AS p, r8.label FROM r8 JOIN e8 ON e8.frame = r8.frame AND e8.a = r8.p),
areas AS (SELECT frame, label, count(*) AS area FROM (SELECT frame, p, min(label) AS label FROM r8 GROUP BY ALL) GROUP BY ALL),
sys AS (SELECT frame, count(*) AS systems, max(area) AS largest_system, round(avg(area), 6) AS mean_system FROM areas GROUP BY frame),
clu AS (SELECT frame, count(DISTINCT label) AS clusters, count(*) FILTER (label IS NULL) AS noise FROM clusters GROUP BY frame HAVING count(*) >= {_MIN}),
g AS (SELECT f.frame, i, j, coalesce(v, 0) AS v FROM (SELECT DISTINCT frame FROM pixels) f CROSS JOIN (SELECT unnest(range(0, {_H})) AS i) CROSS JOIN (SELECT unnest(range(0, {_WD})) AS j) LEFT JOIN pixels p USING (frame, i, j)),
base AS (SELECT frame, avg(v) AS mean, max(v) AS max, min(v) AS min, stddev_pop(v) AS std, count(*) AS pixels, count(*) FILTER (v > {_ON}) AS active, {cut(0.33)} AS light, {cut(0.66)} AS moderate, {cut(0.9)} AS heavy, {cut(0.99)} AS extreme, {cut(0.8)} AS hot FROM g GROUP BY frame),
area AS (SELECT frame, count(*) FILTER (v > {_ON} AND v <= light) AS light_area, count(*) FILTER (v > light AND v <= moderate) AS moderate_area, count(*) FILTER (v > moderate AND v <= heavy) AS heavy_area, count(*) FILTER (v > heavy) AS extreme_area FROM g JOIN base USING (frame) GROUP BY frame),
grad AS (SELECT frame, {along('i', 'c')} AS gy, {along('j', 'r')} AS gx FROM g WINDOW r AS (PARTITION BY frame, i ORDER BY j), c AS (PARTITION BY frame, j ORDER BY i)),
steep AS (SELECT frame, sqrt(gx * gx + gy * gy) AS s, atan2(gy, gx) AS a FROM grad),
steepness AS (SELECT frame, max(s) AS gradient_max, avg(s) AS gradient_mean, stddev_pop(a) AS direction_std, quantile_cont(s, 0.95) AS q FROM steep GROUP BY frame),
steeper AS (SELECT frame, count(*) FILTER (s > q) AS steep_area FROM steep JOIN steepness USING (frame) GROUP BY frame),
s1 AS (SELECT a.frame, a.i, a.j, sum(w * b.v) AS v FROM g a, {taps} t, g b WHERE b.frame = a.frame AND b.i = a.i AND b.j = greatest(0, least({_WD - 1}, a.j + k)) GROUP BY ALL),
s2 AS (SELECT a.frame, a.i, a.j, sum(w * b.v) AS s FROM s1 a, {taps} t, s1 b WHERE b.frame = a.frame AND b.j = a.j AND b.i = greatest(0, least({_H - 1}, a.i + k)) GROUP BY ALL),
rough AS (SELECT frame, round(abs(v - s), 9) AS t FROM g JOIN s2 USING (frame, i, j)),
roughness AS (SELECT frame, avg(t) AS texture_mean, max(t) AS texture_max, stddev_pop(t) AS sd, quantile_cont(t, 0.9) AS q FROM rough GROUP BY frame),
rougher AS (SELECT frame, count(*) FILTER (t > q) AS rough_area FROM rough JOIN roughness USING (frame) GROUP BY frame),
m1 AS (SELECT *, max(v) OVER (PARTITION BY frame, i ORDER BY j ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM g),
m2 AS (SELECT frame, v, max(m) OVER (PARTITION BY frame, j ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM m1),
hots AS (SELECT frame, count(*) FILTER (v = m AND v > hot) AS hotspots, max(v) FILTER (v = m AND v > hot) AS strongest FROM m2 JOIN base USING (frame) GROUP BY frame),
onn AS (SELECT frame, i, j FROM g WHERE v > {_ON}), off AS (SELECT frame, i, j FROM g WHERE v <= {_ON}),
eroded AS (FROM onn EXCEPT FROM {spread('off')}), opened AS (FROM {spread('eroded')}),
dilated AS (FROM {spread('onn')}), outside AS (SELECT frame, i, j FROM g EXCEPT FROM dilated), closed AS (SELECT frame, i, j FROM g EXCEPT FROM {spread('outside')}),
shape AS (SELECT frame, (SELECT count(*) FROM opened o WHERE o.frame = b.frame) AS o, (SELECT count(*) FROM closed c WHERE c.frame = b.frame) AS c FROM base b)
SELECT frame, round(mean, 6) AS mean, max, min, round(std, 6) AS std, round(light, 6) AS light, round(moderate, 6) AS moderate, round(heavy, 6) AS heavy, round(extreme, 6) AS extreme,
round(gradient_max, 6) AS gradient_max, round(gradient_mean, 6) AS gradient_mean, round(direction_std, 6) AS direction_std, round(texture_mean, 6) AS texture_mean, round(texture_max, 6) AS texture_max, round(1 - sd / (std + 1e-10), 6) AS smoothness, strongest,
round(o / active, 6) AS compactness, round(c / active, 6) AS connectivity, round(1 - o / (c + 1e-10), 6) AS fragmentation, pixels, active, light_area, moderate_area, heavy_area, extreme_area, steep_area, rough_area, hotspots,
coalesce(systems, 0) AS systems, coalesce(largest_system, 0) AS largest_system, coalesce(mean_system, 0) AS mean_system, clusters, noise, round(100 * active / pixels, 6) AS coverage
FROM base JOIN area USING (frame) JOIN steepness USING (frame) JOIN steeper USING (frame) JOIN roughness USING (frame) JOIN rougher USING (frame) JOIN hots USING (frame) JOIN shape USING (frame) LEFT JOIN sys USING (frame) LEFT JOIN clu USING (frame)"""


QUERIES = {
    "frame_insight": (_insight, _insight_sql()),
    "density_clusters": (_clusters, f"WITH RECURSIVE {_SQL_CLUSTERS} SELECT * FROM clusters"),
    "largest_clusters": (
        lambda s, d: G.region_table(_clusters(s, d).where("label IS NOT NULL"), _MIN, 3),
        f"WITH RECURSIVE {_SQL_CLUSTERS}, t AS (SELECT frame, label, count(*) AS area, CAST(floor(avg(i)) AS BIGINT) AS ci, CAST(floor(avg(j)) AS BIGINT) AS cj FROM clusters WHERE label IS NOT NULL GROUP BY ALL HAVING count(*) >= {_MIN}) SELECT *, CAST(row_number() OVER (PARTITION BY frame ORDER BY area DESC, label) AS INT) AS rank FROM t QUALIFY rank <= 3",
    ),
}
