"""Structured Streaming twins of operators that work per arriving time step.

Streams read new files, keep event-time state under a watermark, and append to Parquet below
the session's shared folder; each result equals its batch twin over closed windows.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.shared import new_path


def events_stream(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """A file stream of a table; ``ts`` as a timestamp, for watermarks."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame) -> DataFrame:
    """What a stream appends until it has read all that is there."""
    folder = new_path(stream.sparkSession, "stream")
    run = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def stroke_windows(events: DataFrame, length: str = "15 minutes", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts and sums of tumbling or sliding windows; a window comes out once the watermark has passed its end."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    counts = events.withWatermark("ts", delay).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("value").cast("double")), 4).alias("total"))
    return counts.select(F.unix_timestamp("w.start").alias("start"), "event_type", "n", "total")


def first_arrivals(events: DataFrame, keys: list[str], delay: str = "10 minutes") -> DataFrame:
    """Repeated keys dropped while they may still arrive."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys).select(*keys)


def verified_online(predictions: DataFrame, truth: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Predictions joined to truths that arrive up to an hour later; both sides' state is bounded by watermarks."""
    p = predictions.withWatermark("ts", delay).alias("p")
    t = truth.withWatermark("truth_ts", delay).alias("t")
    return p.join(t, F.expr("p.id = t.truth_id AND t.truth_ts BETWEEN p.ts AND p.ts + INTERVAL 1 HOUR")).select("id", "lead", "y_pred", "y_true")


def complete_steps(events: DataFrame, required: list[str], length: str = "15 minutes", timeout: str = "10 minutes") -> DataFrame:
    """Time steps with what has arrived of the ``required`` inputs: a step waits for late ones until the watermark, its end and
    the timeout, has passed; then it comes out as complete, or as given up with what is missing."""
    have = events.withWatermark("ts", timeout).groupBy(F.window("ts", length)).agg(F.collect_set("event_type").alias("have"))
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, required)), "have"))
    return have.select(F.unix_timestamp("window.start").alias("start"), (F.size(missing) == 0).alias("complete"), F.array_join(missing, ",").alias("missing"))


def drained_apart(stream: DataFrame, good: Column) -> tuple[DataFrame, DataFrame]:
    """The rows that a step can process, and the others, in two tables: a bad row never stops the run. Each batch writes
    below its number, so that one that is run again after a failure replaces what it wrote."""
    spark = stream.sparkSession
    folder, fine = new_path(spark, "apart"), F.coalesce(good, F.lit(False))

    def write(batch: DataFrame, number: int) -> None:
        for name, rows in (("done", batch.where(fine)), ("dead", batch.where(~fine))):
            rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")

    write(spark.createDataFrame([], stream.schema), -1)
    run = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    done, dead = (spark.read.parquet(f"{folder}/{name}").drop("batch") for name in ("done", "dead"))
    return done, dead
