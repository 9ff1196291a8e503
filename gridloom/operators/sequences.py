"""Temporal continuity, positions and leakage-free splits of patch activity (slot, patch_id)."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def continuity(active: DataFrame, past: int = 2, future: int = 3) -> DataFrame:
    """Pairs (slot, patch_id) whose patch is active in every slot from -past to +future. Duplicates don't count."""
    span = Window.partitionBy("patch_id").orderBy("slot").rangeBetween(-past, future)
    return active.select("slot", "patch_id").distinct().withColumn("n", F.count(F.lit(1)).over(span)).where(F.col("n") == past + future + 1).drop("n")


def positions(active: DataFrame) -> DataFrame:
    """0-based position of each patch in its slot's ordered list."""
    return active.select("slot", "patch_id").distinct().withColumn("pos", (F.row_number().over(Window.partitionBy("slot").orderBy("patch_id")) - 1).cast("long"))


def step_positions(active: DataFrame, past: int = 2, future: int = 3) -> DataFrame:
    """For qualifying pairs, the position of the patch in each step's own list: (slot, patch_id, step, pos)."""
    steps = continuity(active, past, future).select("slot", "patch_id", F.explode(F.sequence(F.lit(-past), F.lit(future))).alias("step"))
    listed = positions(active).withColumnRenamed("slot", "at")
    return steps.withColumn("at", F.col("slot") + F.col("step")).join(listed, ["at", "patch_id"]).select("slot", "patch_id", "step", "pos")


def block_split(refs: DataFrame, minutes: int, block_hours: int = 6, test: float = 0.1, validation: float = 0.1) -> DataFrame:
    """``split`` for reference slots: in each block of a day the first go to test, the next to validation.

    Half-even rounding, at least one each; blocks of under 3, or too small for both, are all train.
    """
    if 24 % block_hours:
        raise ValueError("block_hours must divide 24")
    block = F.floor(F.col("slot") * minutes / (60 * block_hours))
    in_block = Window.partitionBy("block")
    slots = refs.select("slot").distinct().withColumn("block", block)
    slots = slots.withColumn("k", F.row_number().over(in_block.orderBy("slot"))).withColumn("n", F.count(F.lit(1)).over(in_block))
    n_test, n_val = (F.greatest(F.lit(1), F.bround(F.col("n") * f).cast("int")) for f in (test, validation))
    small = (F.col("n") < 3) | (n_test + n_val >= F.col("n"))
    split = F.when(small, "train").when(F.col("k") <= n_test, "test").when(F.col("k") <= n_test + n_val, "validation").otherwise("train")
    return refs.join(slots.select("slot", split.alias("split")), "slot")


def split_summary(split: DataFrame) -> DataFrame:
    """References, pairs and the range of slots of each split."""
    return split.groupBy("split").agg(F.countDistinct("slot").alias("refs"), F.count(F.lit(1)).alias("pairs"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"))


def runs_of_activity(active: DataFrame) -> DataFrame:
    """Runs of consecutive slots of a patch: (patch_id, first_slot, last_slot, n)."""
    by_patch = Window.partitionBy("patch_id").orderBy("slot")
    rows = active.select("slot", "patch_id").distinct().withColumn("g", F.col("slot") - F.row_number().over(by_patch))
    return rows.groupBy("patch_id", "g").agg(F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.count(F.lit(1)).alias("n")).drop("g")


def survival(active: DataFrame, qualifying: DataFrame) -> DataFrame:
    """Active and qualifying counts of each patch and the rate in percent; 0 without activity."""
    a = active.groupBy("patch_id").agg(F.count(F.lit(1)).alias("n_active"))
    q = qualifying.groupBy("patch_id").agg(F.count(F.lit(1)).alias("n_qualifying"))
    both = a.join(q, "patch_id", "full_outer").na.fill(0, ["n_active", "n_qualifying"])
    return both.withColumn("rate", F.round(F.coalesce(F.try_divide(F.col("n_qualifying") * F.lit(100.0), F.col("n_active")), F.lit(0.0)), 6))


def diurnal_cycle(active: DataFrame, minutes: int) -> DataFrame:
    """Per hour of day the mean and population deviation of activity over all dates; missing hours count 0."""
    hours = active.select(F.floor(F.col("slot") * minutes / 60).alias("h"))
    counts = hours.groupBy(F.floor(F.col("h") / 24).alias("day"), F.pmod("h", F.lit(24)).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    grid = counts.select("day").distinct().select("day", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))).alias("hour"))
    full = grid.join(counts, ["day", "hour"], "left").na.fill(0, ["n"])
    return full.groupBy("hour").agg(F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_pop("n"), 6).alias("std"))


def spatial_frequency(active: DataFrame, columns: int = 6) -> DataFrame:
    """Share of time steps in which each patch is active, in percent, with its row and column."""
    steps = active.agg(F.countDistinct("slot")).scalar()
    n = active.groupBy("patch_id").agg(F.countDistinct("slot").alias("n"))
    return n.select("patch_id", F.floor((F.col("patch_id") - 1) / columns).alias("row"), ((F.col("patch_id") - 1) % columns).alias("col"), F.round(F.col("n") * 100 / steps, 6).alias("percent"))


def daily_timeline(active: DataFrame, minutes: int) -> DataFrame:
    """One row a day, one column a time step of the day, active patches in each."""
    steps = 24 * 60 // minutes
    rows = active.select(F.floor(F.col("slot") / steps).alias("day"), F.pmod("slot", F.lit(steps)).alias("step"))
    return rows.groupBy("day").pivot("step", list(range(steps))).count().na.fill(0).select("day", *[F.col(str(k)).alias(f"s{k}") for k in range(steps)])


def activity_distribution(active: DataFrame) -> DataFrame:
    """How many slots have how many active patches, with the mean and exact median on each row."""
    per_slot = active.groupBy("slot").agg(F.countDistinct("patch_id").alias("n_active"))
    mean, median = per_slot.agg(F.round(F.avg("n_active"), 6)).scalar(), per_slot.agg(F.median("n_active")).scalar()
    return per_slot.groupBy("n_active").agg(F.count(F.lit(1)).alias("slots")).withColumns({"mean": mean, "median": median})
