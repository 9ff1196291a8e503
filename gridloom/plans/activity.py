"""Queries over patch activity."""

from gridloom.operators import sequences as S
from gridloom.plans import fixtures as X

_A = X.sql_active()
_REFS = "refs AS (SELECT slot, patch_id FROM (SELECT *, count(*) OVER (PARTITION BY patch_id ORDER BY slot RANGE BETWEEN 2 PRECEDING AND 3 FOLLOWING) AS n FROM active) WHERE n = 6)"
_SPLIT = """slots AS (SELECT slot, row_number() OVER (PARTITION BY slot // 6 ORDER BY slot) AS k, count(*) OVER (PARTITION BY slot // 6) AS n FROM (SELECT DISTINCT slot FROM refs)),
named AS (SELECT slot, greatest(1, CAST(round_even(n * 0.1, 0) AS INT)) AS t, k, n FROM slots),
split AS (SELECT r.slot, r.patch_id, CASE WHEN n < 3 OR 2 * t >= n THEN 'train' WHEN k <= t THEN 'test' WHEN k <= 2 * t THEN 'validation' ELSE 'train' END AS split FROM refs r JOIN named USING (slot))"""


def splits(spark, d, minutes=60):
    return S.block_split(S.continuity(X.patch_active(spark, d, minutes)), minutes)


QUERIES = {
    "continuity": (lambda s, d: S.continuity(X.patch_active(s, d)), f"WITH {_A}, {_REFS} SELECT * FROM refs"),
    "continuity_splits": (splits, f"WITH {_A}, {_REFS}, {_SPLIT} SELECT * FROM split"),
    "split_summary": (lambda s, d: S.split_summary(splits(s, d)), f"WITH {_A}, {_REFS}, {_SPLIT} SELECT split, count(DISTINCT slot) AS refs, count(*) AS pairs, min(slot) AS first_slot, max(slot) AS last_slot FROM split GROUP BY split"),
    "active_positions": (lambda s, d: S.positions(X.patch_active(s, d)), f"WITH {_A} SELECT slot, patch_id, row_number() OVER (PARTITION BY slot ORDER BY patch_id) - 1 AS pos FROM active"),
    "step_positions": (
        lambda s, d: S.step_positions(X.patch_active(s, d)),
        f"WITH {_A}, {_REFS}, p AS (SELECT slot, patch_id, row_number() OVER (PARTITION BY slot ORDER BY patch_id) - 1 AS pos FROM active) SELECT r.slot, r.patch_id, CAST(t.step AS INT) AS step, p.pos FROM refs r, (SELECT unnest(range(-2, 4)) AS step) t, p WHERE p.slot = r.slot + t.step AND p.patch_id = r.patch_id",
    ),
    "activity_runs": (lambda s, d: S.runs_of_activity(X.patch_active(s, d)), f"WITH {_A}, g AS (SELECT *, slot - row_number() OVER (PARTITION BY patch_id ORDER BY slot) AS g FROM active) SELECT patch_id, min(slot) AS first_slot, max(slot) AS last_slot, count(*) AS n FROM g GROUP BY patch_id, g"),
    "patch_survival": (
        lambda s, d: S.survival(a := X.patch_active(s, d), S.continuity(a)),
        f"WITH {_A}, {_REFS}, a AS (SELECT patch_id, count(*) AS n FROM active GROUP BY 1), q AS (SELECT patch_id, count(*) AS n FROM refs GROUP BY 1) SELECT patch_id, coalesce(a.n, 0) AS n_active, coalesce(q.n, 0) AS n_qualifying, round(coalesce(q.n * 100.0::DOUBLE / a.n, 0), 6) AS rate FROM a FULL JOIN (SELECT * FROM q) q USING (patch_id)".replace("coalesce(q.n * 100.0::DOUBLE / a.n, 0)", "coalesce(coalesce(q.n, 0) * 100.0::DOUBLE / a.n, 0)"),
    ),
    "diurnal_cycle": (
        lambda s, d: S.diurnal_cycle(X.patch_active(s, d), 60),
        f"WITH {_A}, c AS (SELECT slot // 24 AS day, slot % 24 AS hour, count(*) AS n FROM active GROUP BY ALL), g AS (SELECT day, CAST(h AS BIGINT) AS hour FROM (SELECT DISTINCT day FROM c), (SELECT unnest(range(0, 24)) AS h)) SELECT hour, round(avg(coalesce(n, 0)), 6) AS mean, round(stddev_pop(coalesce(n, 0)), 6) AS std FROM g LEFT JOIN c USING (day, hour) GROUP BY hour",
    ),
    "spatial_frequency": (lambda s, d: S.spatial_frequency(X.patch_active(s, d)), f"WITH {_A} SELECT patch_id, (patch_id - 1) // 6 AS row, (patch_id - 1) % 6 AS col, round(count(DISTINCT slot) * 100 / (SELECT count(DISTINCT slot) FROM active)::DOUBLE, 6) AS percent FROM active GROUP BY patch_id"),
    "daily_timeline": (lambda s, d: S.daily_timeline(X.patch_active(s, d), 60), f"WITH {_A} SELECT slot // 24 AS day, " + ", ".join(f"count(*) FILTER (slot % 24 = {k}) AS s{k}" for k in range(24)) + " FROM active GROUP BY 1"),
    "activity_distribution": (
        lambda s, d: S.activity_distribution(X.patch_active(s, d)),
        f"WITH {_A}, p AS (SELECT slot, count(*) AS n_active FROM active GROUP BY 1) SELECT n_active, count(*) AS slots, (SELECT round(avg(n_active), 6) FROM p) AS mean, (SELECT median(n_active) FROM p) AS median FROM p GROUP BY 1",
    ),
}
