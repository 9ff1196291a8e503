"""Streams with state and timers against sweeps over what has arrived."""

import os
import threading
import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import sequences
from gridloom.streaming import stateful as S

THRESHOLDS = [0.0, 0.25, 0.5, 0.75]
T0 = datetime(2024, 6, 1)


def put(spark, folder, name, rows, schema):
    """A file that appears at once."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/.new-{name}")
    part = next(f for f in os.listdir(f"{folder}/.new-{name}") if f.startswith("part-"))
    os.rename(f"{folder}/.new-{name}/{part}", f"{folder}/{name}.parquet")


SIDES = "id long, lead int, ts timestamp, y double"


def sweep(predictions, truths):
    found = {}
    was = {r[0]: r for r in truths}
    for id_, lead, ts, p in predictions:
        if id_ in was and timedelta(0) <= was[id_][2] - ts <= timedelta(hours=1):
            for k in THRESHOLDS:
                cell = found.setdefault((lead, k), [0, 0, 0, 0])
                cell[(0 if was[id_][3] else 1) if p >= k else (2 if was[id_][3] else 3)] += 1
    return found


def test_running_confusion_after_each_batch_and_restart(spark, tmp_path):
    rng = np.random.default_rng(1)
    ids = range(300)
    predictions = [(k, k % 3 + 1, T0 + timedelta(minutes=k), float(rng.random())) for k in ids]
    # Truths come up to 100 minutes later; some never, some are valid too late to count.
    truths = [(k, k % 3 + 1, T0 + timedelta(minutes=k + int(rng.integers(0, 100))), float(rng.random() < 0.4)) for k in ids if rng.random() < 0.9]
    for side in "pt":
        os.makedirs(f"{tmp_path}/{side}")
    stream = lambda side, y: spark.readStream.schema(SIDES).parquet(f"file://{tmp_path}/{side}").withColumnRenamed("y", y)
    seen = [[], []]
    for batch in range(3):
        lo, hi = T0 + timedelta(minutes=batch * 150), T0 + timedelta(minutes=(batch + 1) * 150)
        for rows, side, have in zip((predictions, truths), "pt", seen):
            new = [r for r in rows if lo <= r[2] < hi]
            have += new
            put(spark, f"{tmp_path}/{side}", f"{batch}", new, SIDES)
        # A new query each time: it goes on from the checkpoint.
        latest = S.Latest(S.running_confusion(stream("p", "y_pred"), stream("t", "y_true"), THRESHOLDS, shards=4), ["lead", "shard"], f"file://{tmp_path}/run")
        now = latest.drain()
        got = {(r.lead, r.threshold): [r.tp, r.fp, r.fn, r.tn] for r in S.confusion_by_lead(now, THRESHOLDS).collect()}
        want = sweep(*seen)
        assert got == {(lead, k): want.get((lead, k), [0, 0, 0, 0]) for lead in (1, 2, 3) for k in THRESHOLDS}
    # What can't be matched any more has left the state.
    left = now.agg(F.sum("open").alias("n")).first().n
    assert left < 120


def test_steps_wait_retry_and_give_up(spark, tmp_path):
    folder = f"{tmp_path}/in"
    os.makedirs(folder)
    schema = "step long, input string"
    put(spark, folder, "a", [(1, "radar"), (1, "lightning"), (2, "radar"), (3, "radar"), (3, "other"), (3, None)], schema)
    arrivals = spark.readStream.schema(schema).parquet(f"file://{folder}")
    latest = S.Latest(S.waiting_steps(arrivals, ["radar", "lightning"], "2 seconds", "12 seconds"), ["step"], f"file://{tmp_path}/run")

    def later():
        # Once the first retry has passed, the input of step 2 arrives; that of step 3 never does.
        time.sleep(6)
        put(spark, folder, "b", [(2, "lightning"), (1, "lightning")], schema)

    helper = threading.Thread(target=later)
    helper.start()
    got = {r.step: r for r in S.run_until(latest, lambda now: now.count() == 3, most_seconds=90).collect()}
    helper.join()
    assert (got[1].status, got[1].missing, got[1].attempts) == ("complete", [], 0)
    assert got[2].status == "complete" and got[2].attempts >= 1
    assert got[3].status == "given up" and got[3].missing == ["lightning"] and got[3].attempts >= 2


def test_runs_of_activity_with_late_slots(spark, tmp_path):
    os.makedirs(f"{tmp_path}/in")
    schema = "ts timestamp, slot long, patch_id int"
    row = lambda slot, patch: (T0 + timedelta(hours=slot), slot, patch)
    files = [[row(0, 1), row(1, 1), row(3, 1), row(1, 2), row(1, 2)], [row(2, 1), row(6, 2), row(4, 1)], [row(7, 2), row(9, 1), row(30, 3)], [row(60, 4)]]
    for k, rows in enumerate(files):
        put(spark, f"{tmp_path}/in", f"{k}", rows, schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    out = S.activity_runs(stream, 3600, "6 hours")
    out.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/out").collect()))
    batch = sequences.runs_of_activity(spark.createDataFrame([r for rows in files for r in rows if r[2] != 4], schema))
    assert got == sorted(map(tuple, batch.select("patch_id", "first_slot", "last_slot", "n").collect()))
    assert (1, 0, 4, 5) in got  # the late slot 2 closed the gap
