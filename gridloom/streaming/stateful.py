"""Streams with keyed state and timers: running verification, and steps that wait for late inputs.

State lives in Spark's state store, one entry for each key; restarts go on from the checkpoint. Processors are shipped by value.
"""

from __future__ import annotations

import sys
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gridloom.operators.shared import new_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Keyed state with timers needs this store; streams without it don't change."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


# Running verification

COUNTS = "lead int, shard int, tp array<long>, fp array<long>, fn array<long>, tn array<long>, open long"


class RunningConfusion(StatefulProcessor):
    """Key: (lead, shard). Predictions and truths of an id wait for each other; a pair whose truth is valid at most ``wait`` ms after its
    prediction is counted at every threshold. What has waited longer than that, by the watermark, is dropped from the state."""

    def __init__(self, thresholds: list[float], wait: int):
        self.thresholds, self.wait = thresholds, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "tp array<long>, fp array<long>, fn array<long>, tn array<long>, open long")
        # What waits, by kind and id: time in ms and value. Ids by the time at which they are dropped.
        self.waiting = handle.getMapState("waiting", "kind int, id long", "ms long, y double")
        self.due = handle.getMapState("due", "ms long", "kinds array<int>, ids array<long>")

    def _counts(self) -> tuple[list[list[int]], int]:
        n = len(self.thresholds)
        found = self.counts.get() if self.counts.exists() else None
        return ([list(x) for x in found[:4]], found[4]) if found is not None else ([[0] * n for _ in range(4)], 0)

    def _row(self, key: tuple, counts: list[list[int]], waiting: int) -> pd.DataFrame:
        return pd.DataFrame({"lead": [key[0]], "shard": [key[1]], "tp": [counts[0]], "fp": [counts[1]], "fn": [counts[2]], "tn": [counts[3]], "open": [waiting]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        counts, waiting = self._counts()
        fresh: dict[tuple[int, int], tuple[int, float]] = {}
        for batch in rows:
            for kind, id_, ms, y in zip(batch["kind"].tolist(), batch["id"].tolist(), batch["ms"].tolist(), batch["y"].tolist()):
                other = fresh.pop((1 - kind, id_), None)
                if other is None and waiting and self.waiting.containsKey((1 - kind, id_)):
                    other = self.waiting.getValue((1 - kind, id_))
                    self.waiting.removeKey((1 - kind, id_))
                    waiting -= 1
                if other is None:
                    fresh[kind, id_] = (ms, y)
                    continue
                (said, p), (was, t) = ((ms, y), other) if kind == 0 else (other, (ms, y))
                if 0 <= was - said <= self.wait:
                    for k, threshold in enumerate(self.thresholds):
                        counts[(0 if t > 0 else 1) if p >= threshold else (2 if t > 0 else 3)][k] += 1
        due: dict[int, tuple[list[int], list[int]]] = {}
        for (kind, id_), (ms, y) in fresh.items():
            self.waiting.updateValue((kind, id_), (ms, y))
            kinds, ids = due.setdefault(-(-(ms + self.wait + 1) // 60_000) * 60_000, ([], []))
            kinds.append(kind), ids.append(id_)
        for ms, (kinds, ids) in due.items():
            if self.due.containsKey((ms,)):
                earlier = self.due.getValue((ms,))
                kinds, ids = list(earlier[0]) + kinds, list(earlier[1]) + ids
            self.due.updateValue((ms,), (kinds, ids))
            self.handle.registerTimer(ms)
        waiting += len(fresh)
        self.counts.update((*counts, waiting))
        yield self._row(key, counts, waiting)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ms = expiredTimerInfo.getExpiryTimeInMs()
        counts, waiting = self._counts()
        if self.due.containsKey((ms,)):
            for kind, id_ in zip(*self.due.getValue((ms,))):
                if self.waiting.containsKey((kind, id_)) and self.waiting.getValue((kind, id_))[0] + self.wait < ms:
                    self.waiting.removeKey((kind, id_))
                    waiting -= 1
            self.due.removeKey((ms,))
            self.counts.update((*counts, waiting))
        yield self._row(key, counts, waiting)

    def close(self) -> None:
        pass


def running_confusion(predictions: DataFrame, truths: DataFrame, thresholds: list[float], wait: str = "1 hour", delay: str = "10 minutes", shards: int = 16) -> DataFrame:
    """COUNTS, a row for each key that a batch has changed, with all that has been counted so far: ids of a lead are dealt to
    ``shards`` keys, so that a frequent lead is no single task. predictions: (id, lead, ts, y_pred), truths: (id, lead, ts, y_true)."""
    use_state_store(predictions.sparkSession)
    ms = int(pd.Timedelta(wait).total_seconds() * 1000)
    both = predictions.select(F.lit(0).alias("kind"), F.col("id").cast("long").alias("id"), F.col("lead").cast("int").alias("lead"), "ts", F.col("y_pred").cast("double").alias("y")).union(
        truths.select(F.lit(1), F.col("id").cast("long"), F.col("lead").cast("int"), "ts", F.col("y_true").cast("double"))
    )
    keyed = both.withWatermark("ts", delay).withColumns({"shard": F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"), "ms": F.unix_millis("ts")})
    return keyed.groupBy("lead", "shard").transformWithStateInPandas(RunningConfusion(thresholds, ms), COUNTS, "Update", "EventTime")


class Latest:
    """The newest row of each key of a stream in update mode: each batch writes what it changed below its number, so that a
    batch that runs again replaces what it wrote."""

    def __init__(self, stream: DataFrame, keys: list[str], folder: str | None = None):
        self.stream, self.keys, self.spark = stream, keys, stream.sparkSession
        self.folder = folder or new_path(self.spark, "latest")

    def _write(self, batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.folder}/out/batch={number}")

    def start(self, **trigger):
        return self.stream.writeStream.outputMode("update").foreachBatch(self._write).option("checkpointLocation", f"{self.folder}/state").trigger(**trigger).start()

    def drain(self) -> DataFrame:
        self.start(availableNow=True).awaitTermination()
        return self.now()

    def now(self) -> DataFrame:
        self.stream_schema = self.stream.schema.add("batch", "long")
        rows = self.spark.read.schema(self.stream_schema).parquet(f"{self.folder}/out")
        rest = [c for c in self.stream.columns if c not in self.keys]
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(*self.keys, "x.*")


def confusion_by_lead(latest: DataFrame, thresholds: list[float]) -> DataFrame:
    """(lead, threshold, tp, fp, fn, tn) from the newest row of each key."""
    each = latest.select("lead", F.posexplode(F.arrays_zip("tp", "fp", "fn", "tn")).alias("k", "c"))
    sums = each.groupBy("lead", "k").agg(*[F.sum(f"c.{n}").alias(n) for n in ("tp", "fp", "fn", "tn")])
    return sums.select("lead", F.get(F.array(*map(F.lit, thresholds)), F.col("k")).alias("threshold"), "tp", "fp", "fn", "tn")


# Steps that wait for their inputs

STEPS = "step long, status string, missing array<string>, attempts int"


class WaitForInputs(StatefulProcessor):
    """Key: a time step. It completes as soon as all required inputs have come. Until then it tries again every ``retry`` ms of
    processing time, and is given up once ``timeout`` ms have passed since its first input, without needing further events."""

    def __init__(self, required: list[str], retry: int, timeout: int):
        self.required, self.retry, self.timeout = frozenset(required), retry, timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("step", "have array<string>, began long, attempts int, status string")

    def _result(self, step: int, status: str, have: set, attempts: int) -> pd.DataFrame:
        return pd.DataFrame({"step": [step], "status": [status], "missing": [sorted(self.required - have)], "attempts": [attempts]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = set().union(*(set(batch["input"].dropna()) for batch in rows))
        now = timerValues.getCurrentProcessingTimeInMs()
        have, began, attempts, status = self.state.get() if self.state.exists() else ([], now, 0, "waiting")
        if status != "waiting":
            return  # settled: what comes now is too late
        have = set(have) | (new & self.required)
        if have == self.required:
            status = "complete"
            yield self._result(key[0], status, have, attempts)
        elif not self.state.exists():
            self.handle.registerTimer(now + min(self.retry, self.timeout))
        self.state.update((sorted(have), began, attempts, status))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        have, began, attempts, status = self.state.get()
        if status != "waiting":
            return
        now, attempts = timerValues.getCurrentProcessingTimeInMs(), attempts + 1
        if now - began >= self.timeout:
            status = "given up"
            yield self._result(key[0], status, set(have), attempts)
        else:
            self.handle.registerTimer(now + min(self.retry, began + self.timeout - now))
        self.state.update((list(have), began, attempts, status))

    def close(self) -> None:
        pass


def waiting_steps(arrivals: DataFrame, required: list[str], retry: str = "1 minute", timeout: str = "10 minutes") -> DataFrame:
    """STEPS, a row when a step is settled. arrivals: (step, input)."""
    use_state_store(arrivals.sparkSession)
    ms = lambda t: int(pd.Timedelta(t).total_seconds() * 1000)
    rows = arrivals.select(F.col("step").cast("long").alias("step"), F.col("input").cast("string").alias("input"))
    return rows.groupBy("step").transformWithStateInPandas(WaitForInputs(required, ms(retry), ms(timeout)), STEPS, "Update", "ProcessingTime")


def run_until(latest: Latest, settled: Callable[[DataFrame], bool], interval: str = "500 milliseconds", most_seconds: float = 120.0) -> DataFrame:
    """Runs a stream with timers until ``settled`` says so of its result, and stops it; raises if that takes too long."""
    query = latest.start(processingTime=interval)
    try:
        until = time.monotonic() + most_seconds
        while time.monotonic() < until:
            if query.exception() is not None:
                raise query.exception()
            if query.lastProgress is not None and query.lastProgress["batchId"] >= 0 and _has_output(latest) and settled(latest.now()):
                return latest.now()
            time.sleep(0.2)
        raise TimeoutError(f"the stream did not settle in {most_seconds} seconds")
    finally:
        query.stop()


def _has_output(latest: Latest) -> bool:
    try:
        latest.spark.read.parquet(f"{latest.folder}/out").schema
    except Exception as missing:
        if "PATH_NOT_FOUND" in str(missing) or "UNABLE_TO_INFER_SCHEMA" in str(missing):
            return False
        raise
    return True


# Runs of activity


def activity_runs(active: DataFrame, step_seconds: int, delay: str = "0 seconds") -> DataFrame:
    """(patch_id, first_slot, last_slot, n): runs of consecutive slots of a patch, from a stream (ts, slot, patch_id) with ts the begin of
    the slot. Session windows whose gap is just over a step: a late slot that closes a gap merges the runs beside it. A run comes out
    when the watermark has passed it."""
    rows = active.withWatermark("ts", delay).groupBy("patch_id", F.session_window("ts", f"{step_seconds + 1} seconds").alias("w"))
    return rows.agg(F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot")).select("patch_id", "first_slot", "last_slot", (F.col("last_slot") - F.col("first_slot") + 1).alias("n"))
