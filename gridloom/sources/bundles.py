"""Bundles of patches, stores of samples, evaluation reports: written with what a reader needs, and read back from disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.grid import patch_bounds, patch_id

_META = "size int, columns int, zero_value double, scale double"


def write_patches(pixels: DataFrame, path: str, size: int, columns: int, nonzero: Column, zero_value: float = 0.0, scale: float = 1.0) -> None:
    """Patches of sparse pixels (frame, i, j, v): those with a ``nonzero`` pixel with all their values (v / scale, zero_value
    where there is no pixel), the others as a place only; beside them one line of JSON with size, columns, zero value and scale."""
    cell = F.struct((F.col("i") % size * size + F.col("j") % size).cast("int"), (F.col("v") / scale).cast("double"))
    cells = pixels.groupBy("frame", patch_id(F.col("i"), F.col("j"), size, columns).alias("patch_id")).agg(F.map_from_entries(F.collect_list(cell)).alias("m"), F.bool_or(F.coalesce(nonzero, F.lit(False))).alias("filled"))
    b = patch_bounds(F.col("patch_id"), size, columns)
    values = F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(zero_value / scale)))
    placed = cells.select("frame", "patch_id", b["i0"].alias("i0"), b["j0"].alias("j0"), "filled", F.when(F.col("filled"), values).alias("values"))
    placed.write.mode("overwrite").partitionBy("filled").parquet(f"{path}/patches")
    one = pixels.sparkSession.range(1).select(F.to_json(F.struct(F.lit(size).alias("size"), F.lit(columns).alias("columns"), F.lit(float(zero_value)).alias("zero_value"), F.lit(float(scale)).alias("scale"))).alias("value"))
    one.write.mode("overwrite").text(f"{path}/metadata")


def read_patches(spark: SparkSession, path: str) -> DataFrame:
    """(frame, patch_id, filled, i, j, v): all pixels of all patches of a bundle, empty ones filled with the zero value."""
    meta = spark.read.text(f"{path}/metadata").select(F.from_json("value", _META).alias("m")).first().m
    rows = spark.read.parquet(f"{path}/patches").withColumn("filled", F.col("filled").cast("boolean"))
    none = F.array_repeat(F.lit(meta.zero_value / meta.scale), meta.size * meta.size)
    cells = rows.select("frame", "patch_id", "filled", "i0", "j0", F.posexplode(F.coalesce("values", none)).alias("k", "v"))
    return cells.select("frame", "patch_id", "filled", (F.col("i0") + F.floor(F.col("k") / meta.size)).alias("i"), (F.col("j0") + F.col("k") % meta.size).alias("j"), (F.col("v") * meta.scale).alias("v"))


_SAMPLES = "split string, n long, channels array<string>, shapes map<string,int>, label string, label_type string, positive long"


def write_samples(samples: DataFrame, path: str, split: str, channels: list[str], label: str) -> None:
    """Samples by split, and a line of JSON for each split, counted from what lies on disk: samples, channels in order and their
    lengths, the label with its type and its positive samples. Raises if the samples of a channel aren't equally long."""
    samples.select(split, *channels, label).write.mode("overwrite").partitionBy(split).parquet(f"{path}/samples")
    there = samples.sparkSession.read.parquet(f"{path}/samples")
    lengths = there.agg(*[f(F.size(c)).alias(f"{n}{k}") for k, c in enumerate(channels) for n, f in (("a", F.min), ("b", F.max))]).first()
    uneven = [c for k, c in enumerate(channels) if lengths[f"a{k}"] != lengths[f"b{k}"]]
    if uneven:
        raise ValueError(f"channels with samples of different length: {uneven}")
    shapes = F.map_from_arrays(F.array(*map(F.lit, channels)), F.array(*[F.lit(lengths[f"a{k}"]).cast("int") for k in range(len(channels))]))
    rows = there.groupBy(F.col(split).cast("string").alias("split")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) > 0).alias("positive"))
    facts = F.struct("split", "n", F.array(*map(F.lit, channels)).alias("channels"), shapes.alias("shapes"), F.lit(label).alias("label"), F.lit(dict(there.dtypes)[label]).alias("label_type"), "positive")
    rows.select(F.to_json(facts).alias("value")).write.mode("overwrite").text(f"{path}/metadata")


def read_sample_facts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(f"{path}/metadata").select(F.inline(F.array(F.from_json("value", _SAMPLES))))


_REPORT = "lead int, best int, csi double, pod double, far double, curve array<struct<k:int,tp:long,fp:long,fn:long,tn:long>>"


def write_evaluation(sweep: DataFrame, path: str) -> None:
    """A JSON object for each lead (0: the aggregate): its best threshold by CSI with the scores there, and the whole curve. sweep: (lead, k, tp, fp, fn, tn)."""
    csi = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    pod = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    far = F.coalesce(F.try_divide(F.col("fp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    point = F.struct(F.col("k").cast("int").alias("k"), *[F.col(c).cast("long").alias(c) for c in ("tp", "fp", "fn", "tn")])
    best = F.min(F.struct(-F.round(csi, 6), F.col("k").cast("int").alias("k"), F.round(csi, 6).alias("csi"), F.round(pod, 6).alias("pod"), F.round(far, 6).alias("far")))
    rows = sweep.groupBy(F.col("lead").cast("int").alias("lead")).agg(best.alias("b"), F.array_sort(F.collect_list(point)).alias("curve"))
    rows.select(F.to_json(F.struct("lead", F.col("b.k").alias("best"), "b.csi", "b.pod", "b.far", "curve")).alias("value")).write.mode("overwrite").text(path)


def read_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """A row for each lead and threshold, with the lead's best threshold and scores."""
    rows = spark.read.text(path).select(F.from_json("value", _REPORT).alias("r")).select("r.*")
    return rows.select("lead", "best", "csi", "pod", "far", F.inline("curve"))
