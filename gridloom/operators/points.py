"""Point lightning: gridding, splats, slots; and as-of and interval joins."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grid_strokes(strokes: DataFrame, seconds: int, include_zero: bool = True) -> DataFrame:
    """Counts and current sums of each (slot, i, j); index 0 may be left out."""
    rows = strokes if include_zero else strokes.where((F.col("i") > 0) & (F.col("j") > 0))
    c = F.col("current")
    return rows.groupBy(F.floor(F.col("s") / seconds).alias("slot"), "i", "j").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("intra") == "IC").alias("ic"), F.count_if(F.col("intra") == "CG").alias("cg"),
        F.round(F.sum(F.abs(c)), 4).alias("abs_current"), F.round(F.coalesce(F.sum(F.when(c < 0, c)), F.lit(0.0)), 4).alias("neg_current"), F.round(F.coalesce(F.sum(F.when(c > 0, c)), F.lit(0.0)), 4).alias("pos_current"),
    )


def current_per_stroke(cells: DataFrame) -> DataFrame:
    return cells.select("slot", "i", "j", F.round(F.try_divide("abs_current", "n"), 4).alias("current_per_stroke"))


def splat(points: DataFrame, y: Column, x: Column, weight: Column) -> DataFrame:
    """Bilinear splat: each point gives four fractional weights, and weighted ones, to the pixels around."""
    i, j = F.floor(y), F.floor(x)
    fy, fx = y - i, x - j
    corners = F.array(*[F.struct((i + a).alias("i"), (j + b).alias("j"), ((fy if a else 1 - fy) * (fx if b else 1 - fx)).alias("w")) for a in (0, 1) for b in (0, 1)])
    return points.select(F.explode(corners).alias("c"), weight.alias("e")).where("c.w > 0").groupBy("c.i", "c.j").agg(F.round(F.sum("c.w"), 6).alias("density"), F.round(F.sum(F.col("c.w") * F.col("e")), 4).alias("energy"))


def slot_join(strokes: DataFrame, slots: DataFrame, seconds: int) -> DataFrame:
    """Strokes with t < slot and slot - t < seconds, both ends open; slots (slot_s). Joined by equal buckets of that length."""
    b = lambda c: F.floor(c / seconds)
    left = strokes.select("id", "s", F.explode(F.array(b(F.col("s")), b(F.col("s")) + 1)).alias("b"))
    right = slots.select("slot_s", b(F.col("slot_s")).alias("b"))
    return left.join(right, "b").where((F.col("s") < F.col("slot_s")) & (F.col("slot_s") - F.col("s") < seconds)).select("id", "slot_s")


def _neighbours(requests: DataFrame, frames: DataFrame, span: int, sides: tuple[str, ...], tie) -> DataFrame:
    """Requests (rid, t) with ``before`` and ``after``, the last frame (ft, fid) up to their time and the first one from it on, as far as
    the bucket of ``span`` and the next ones go. Frames of equal time are one, by ``tie``; a bucket lends its last frame to the
    next bucket and its first to the one before, so that requests and frames meet in a window, never in pairs."""
    b = lambda c: F.floor(c / span)
    once = frames.where("ft IS NOT NULL").groupBy("ft").agg(tie("fid").alias("fid")).withColumn("b", b(F.col("ft")))
    ends = once.groupBy("b").agg(F.max(F.struct("ft", "fid")).alias("last"), F.min(F.struct("ft", "fid")).alias("first"))
    lent = {"before": ends.select(F.col("last.ft").alias("ft"), F.col("last.fid").alias("fid"), (F.col("b") + 1).alias("b")), "after": ends.select(F.col("first.ft").alias("ft"), F.col("first.fid").alias("fid"), (F.col("b") - 1).alias("b"))}
    for side in sides:
        once = once.union(lent[side])
    shown = once.select(F.lit(None).cast(requests.schema["rid"].dataType).alias("rid"), F.col("ft").alias("t"), "b", F.struct("ft", "fid").alias("frame"), F.lit(False).alias("asks"))
    asked = requests.select("rid", "t", b(F.col("t")).alias("b"), F.lit(None).cast(shown.schema["frame"].dataType).alias("frame"), F.lit(True).alias("asks"))
    up = {"before": F.max("frame").over(Window.partitionBy("b").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)), "after": F.min("frame").over(Window.partitionBy("b").orderBy(F.desc("t")).rangeBetween(Window.unboundedPreceding, 0))}
    return shown.unionByName(asked).select("rid", "t", "asks", *[up[side].alias(side) for side in sides]).where("asks").drop("asks")


def nearest_in_time(requests: DataFrame, frames: DataFrame, limit: int) -> DataFrame:
    """For every request (rid, t) the frame (fid, ft) nearest in time within the limit; the earlier on ties, then the lesser id; null if none."""
    both = _neighbours(requests, frames, limit, ("before", "after"), F.min)
    away = lambda c: F.when(F.abs(F.col("t") - F.col(f"{c}.ft")) <= limit, F.struct(F.abs(F.col("t") - F.col(f"{c}.ft")).alias("dt"), F.col(f"{c}.ft").alias("ft"), F.col(f"{c}.fid").alias("fid")))
    return both.select("rid", F.least(away("before"), away("after")).alias("m")).select("rid", F.col("m.fid").alias("fid"), F.col("m.dt").alias("dt"))


def latest_before(requests: DataFrame, frames: DataFrame, interval: int) -> DataFrame:
    """The latest frame in [t - interval, t) of each request, times whole seconds; the greatest id of that time, null if none."""
    last = _neighbours(requests.withColumn("t", F.col("t") - 1), frames, interval, ("before",), F.max)
    return last.select("rid", F.when(F.col("before.ft") >= F.col("t") + 1 - interval, F.col("before.fid")).alias("fid"))


def shortest_lead(runs: DataFrame, days: DataFrame) -> DataFrame:
    """For each valid day the run that covers it with the shortest lead; the smallest id on ties.

    A run is spread over the days that it covers; the least of each day is taken before the shuffle, and days meet only that.
    """
    spread = runs.where("start_day <= end_day").select("run_id", "start_day", F.explode(F.sequence("start_day", "end_day")).alias("day"))
    best = spread.groupBy("day").agg(F.min(F.struct((F.col("day") - F.col("start_day")).alias("lead"), "run_id")).alias("m"))
    return days.join(best, "day").select("day", F.col("m.run_id").alias("run_id"), F.col("m.lead").cast("int").alias("lead"))


def interpolate(known: DataFrame, stride: int, key: list[str]) -> DataFrame:
    """Values at every step from frames known each ``stride`` steps: (key, t, linear, nearest)."""
    after = known.select(*key, (F.col("t") - stride).alias("t"), F.col("v").alias("v1"))
    steps = known.join(after, [*key, "t"], "left").select(*key, "t", "v", "v1", F.explode(F.sequence(F.lit(0), F.lit(stride - 1))).alias("dt"))
    w = F.col("dt") / stride
    linear = F.when(F.col("dt") == 0, F.col("v")).otherwise((1 - w) * F.col("v") + w * F.col("v1"))
    nearest = F.when(F.col("dt") < stride / 2, F.col("v")).otherwise(F.col("v1"))
    return steps.select(*key, (F.col("t") + F.col("dt")).alias("t"), F.round(linear, 6).alias("linear"), nearest.alias("nearest"))


def persistence(observed: DataFrame, leads: int) -> DataFrame:
    """The last observed value of each key, repeated over the leads."""
    last = observed.groupBy("key").agg(F.max(F.struct("t", "id", "v")).alias("m"))
    return last.select("key", F.explode(F.sequence(F.lit(1), F.lit(leads))).alias("lead"), F.col("m.v").alias("v"))


def latitude_bands(rows: DataFrame, x: str, v: str, bins: int) -> DataFrame:
    """Equal-width, right-closed bins between the extremes: mean, sample deviation, count of each."""
    lo, hi = rows.agg(F.min(x)).scalar(), rows.agg(F.max(x)).scalar()
    k = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.ceil((F.col(x) - lo) / ((hi - lo) / bins) - 1e-9) - 1))
    return rows.groupBy(k.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_samp(v), 6).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))


def consecutive(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Spacing between successive different coordinates of each key: median and the most frequent (smallest on ties)."""
    w = Window.partitionBy(key).orderBy(*order)
    steps = rows.select(key, *order).distinct().withColumn("step", F.col(order[0]) - F.lag(order[0]).over(w)).where("step IS NOT NULL")
    mode = steps.groupBy(key, "step").agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg(F.min(F.struct(-F.col("n"), F.col("step").alias("step"))).alias("m"))
    return steps.groupBy(key).agg(F.median("step").alias("median")).join(mode.select(key, F.col("m.step").alias("dominant")), key)
