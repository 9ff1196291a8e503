"""Queries over streams with keyed state, timers and sessions."""

from pyspark.sql import functions as F

from gridloom.plans import fixtures as X
from gridloom.streaming import jobs
from gridloom.streaming import stateful as S

_THRESHOLDS = [0.1, 0.3, 0.5, 0.7, 0.9]
_INPUTS = ["click", "view", "purchase"]
_PATCHES = 18


def _confusion(s, d):
    """Predictions, and truths that are valid up to 89 minutes later; those of over an hour don't count."""
    events = jobs.events_stream(s, d)
    lead = (F.col("event_id") % 3 + 1).cast("int").alias("lead")
    said = events.select(F.col("event_id").alias("id"), lead, "ts", F.least(F.col("value").cast("double") / 100, F.lit(1.0)).alias("y_pred"))
    later = F.col("ts") + F.make_dt_interval(mins=(F.col("event_id") % 90).cast("int"))
    was = events.select(F.col("event_id").alias("id"), lead, later.alias("ts"), F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("y_true"))
    return S.confusion_by_lead(S.Latest(S.running_confusion(said, was, _THRESHOLDS), ["lead", "shard"]).drain(), _THRESHOLDS)


def _waiting(s, d):
    """Quarters of an hour that wait for three kinds of events; those that don't get them are given up."""
    slot = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 900)
    steps = X.table(s, d, "events").select(slot.alias("step")).distinct().count()
    arrivals = jobs.events_stream(s, d).select(slot.alias("step"), F.col("event_type").alias("input"))
    latest = S.Latest(S.waiting_steps(arrivals, _INPUTS, "1 second", "2 seconds"), ["step"])
    return S.run_until(latest, lambda now: now.count() == steps, most_seconds=600).select("step", "status", F.array_join("missing", ",").alias("missing"))


def _runs(s, d):
    stream = jobs.events_stream(s, d)
    slot = F.floor(F.unix_timestamp("ts") / 3600)
    active = stream.select(F.timestamp_seconds(slot * 3600).alias("ts"), slot.alias("slot"), (F.col("user_id") % _PATCHES + 1).alias("patch_id"))
    return jobs.drained(S.activity_runs(active, 3600, "10 minutes"))


_HAVE = "', '".join(_INPUTS)
QUERIES = {
    "stream_running_confusion": (
        _confusion,
        f"WITH {X.SQL_PREDICTIONS}, m AS (SELECT * FROM predictions WHERE id % 90 <= 60), t AS (SELECT unnest({_THRESHOLDS}) AS threshold) SELECT lead, threshold::DOUBLE AS threshold, count(*) FILTER (y_pred >= threshold AND y_true = 1) AS tp, count(*) FILTER (y_pred >= threshold AND y_true = 0) AS fp, count(*) FILTER (y_pred < threshold AND y_true = 1) AS fn, count(*) FILTER (y_pred < threshold AND y_true = 0) AS tn FROM m, t GROUP BY ALL",
    ),
    "stream_waiting": (
        _waiting,
        f"WITH s AS (SELECT CAST(floor(epoch(ts) / 900) AS BIGINT) AS step, event_type FROM events), k AS (SELECT unnest(['{_HAVE}']) AS k), g AS (SELECT DISTINCT step FROM s), x AS (SELECT g.step, k, EXISTS (FROM s WHERE s.step = g.step AND s.event_type = k) AS there FROM g, k) SELECT step, CASE WHEN bool_and(there) THEN 'complete' ELSE 'given up' END AS status, coalesce(string_agg(k, ',' ORDER BY k) FILTER (NOT there), '') AS missing FROM x GROUP BY step",
    ),
    "stream_activity_runs": (
        _runs,
        f"WITH {X.sql_active(60, _PATCHES)}, g AS (SELECT *, slot - row_number() OVER (PARTITION BY patch_id ORDER BY slot) AS g FROM active), r AS (SELECT patch_id, min(slot) AS first_slot, max(slot) AS last_slot, count(*) AS n FROM g GROUP BY patch_id, g) SELECT * FROM r WHERE last_slot * 3600 + 3601 <= (SELECT max(slot) * 3600 - 600 FROM active)",
    ),
}
