"""Rows chosen by date, time and place, joined to what has no time, put in order and cut into batches."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.fields import spearman
from gridloom.operators.ranks import numbered


def on_dates(files: DataFrame, dates: list[str] | None = None, groups: list[str] | None = None) -> DataFrame:
    """Files (date, group, ...) of the dates and product groups; None takes all. Plain comparisons, so that partitions are pruned."""
    kept = files if dates is None else files.where(F.col("date").isin(dates))
    return kept if groups is None else kept.where(F.col("group").isin(groups))


def at_times(sequences: DataFrame, date: str, times: list[str]) -> DataFrame:
    """Sequences (date, reference_utc, ...) of a date whose reference time, without blanks around it, is among ``times``."""
    return sequences.where((F.trim("date") == date) & F.trim("reference_utc").isin(times))


def in_hours(refs: DataFrame, minutes: int, start: int, end: int) -> DataFrame:
    """References (slot, ...) whose hour of the day is in [start, end)."""
    hour = F.floor(F.col("slot") * minutes / 60) % 24
    return refs.where((hour >= start) & (hour < end))


def by_age(live: DataFrame, archive: DataFrame, time: str, cutoff: Column) -> DataFrame:
    """Rows since the cutoff from the live source, earlier ones from the archive."""
    return live.where(F.col(time) >= cutoff).unionByName(archive.where(F.col(time) < cutoff))


def all_ids(tables: list[DataFrame], key: str) -> DataFrame:
    """The different keys of several tables; every table is made distinct by the partial aggregate before the shuffle."""
    union = tables[0].select(key)
    for t in tables[1:]:
        union = union.union(t.select(key))
    return union.distinct()


def append_splits(splits: dict[str, DataFrame]) -> DataFrame:
    """The rows of all splits, by column name, with the split that each came from."""
    named = [df.withColumn("split", F.lit(name)) for name, df in splits.items()]
    union = named[0]
    for df in named[1:]:
        union = union.unionByName(df)
    return union


def flatten_groups(rows: DataFrame, groups: str, name: str) -> DataFrame:
    """A row for each member of an array of arrays; empty groups and nulls give none."""
    return rows.withColumn(name, F.explode(F.flatten(F.filter(groups, lambda g: g.isNotNull())))).drop(groups)


def first_rows(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows by ``order``, which should end with a key; each partition offers its own first n."""
    return rows.orderBy(*order).limit(n)


def ranked_inputs(scores: DataFrame, score: str, key: str) -> DataFrame:
    """``scores`` with the place of each input, the greatest score first, null scores last, ties by key."""
    keyed = scores.withColumn("order_", F.coalesce(-F.col(score), F.lit(float("inf"))))
    return numbered(keyed, [], ["order_", key], "place").drop("order_")


def batches(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """``rows`` with ``batch`` and ``pos``: slices of ``size`` rows by ``order``, which should end with a key; the last may be short."""
    n = F.col("n_") - 1
    return numbered(rows, [], order, "n_").withColumn("batch", F.floor(n / size)).withColumn("pos", n % size).drop("n_")


def largest_channel(values: Column) -> Column:
    """The 0-based place of the largest value of an array; the first on ties, null for an empty array."""
    return F.when(F.size(values) > 0, F.array_position(values, F.array_max(values)) - 1)


def one_lead(labels: Column, k: int) -> Column:
    """The k-th lead (from 0) of an array of leads; null beyond its end."""
    return F.get(labels, F.lit(k))


def zero_predictor(patches: DataFrame, zeros: DataFrame, keys: list[str], name: str = "zeros") -> DataFrame:
    """A variable that is 0 wherever the primary one is defined, in a patch or as a patch of zeros."""
    return patches.select(*keys).union(zeros.select(*keys)).distinct().withColumn(name, F.lit(0.0))


def terrain_fields(static: DataFrame) -> DataFrame:
    """(i, j, ifac, sin_aspect, cos_aspect, gradient) of (i, j, ifac, aspect, gx, gy); no ifac is 1."""
    ifac = F.coalesce(F.nanvl(F.col("ifac"), F.lit(1.0)), F.lit(1.0))
    return static.select("i", "j", ifac.alias("ifac"), F.sin("aspect").alias("sin_aspect"), F.cos("aspect").alias("cos_aspect"), F.hypot("gx", "gy").alias("gradient"))


def with_static(rows: DataFrame, static: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of every time with the fields that have no time; rows off the static grid go."""
    return rows.join(static, keys)


def placed_predictions(predictions: DataFrame, frame: DataFrame, keys: list[str]) -> DataFrame:
    """Stored predictions, nested leading dimension of one taken off, with the coordinates of the merged frame."""
    return predictions.withColumn("values", F.element_at("values", 1)).join(frame, keys)


def first_files(files: DataFrame) -> DataFrame:
    """The first file of the first folder of each variable, from (variable, folder, path)."""
    return files.groupBy("variable").agg(F.min(F.struct("folder", "path")).alias("m")).select("variable", "m.folder", "m.path")


def corner_coordinates(boxes: DataFrame, grid: DataFrame, height: int, width: int) -> DataFrame:
    """(id, lat1, lon1, lat2, lon2) of boxes (id, i1, j1, i2, j2), corners clipped to the grid (i, j, lat, lon)."""
    clip = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), c.cast("long")))
    out = boxes
    for k in (1, 2):
        at = grid.select(F.col("i").cast("long").alias(f"ci{k}"), F.col("j").cast("long").alias(f"cj{k}"), F.col("lat").alias(f"lat{k}"), F.col("lon").alias(f"lon{k}"))
        out = out.withColumn(f"ci{k}", clip(F.col(f"i{k}"), height)).withColumn(f"cj{k}", clip(F.col(f"j{k}"), width)).join(at, [f"ci{k}", f"cj{k}"])
    return out.select("id", "lat1", "lon1", "lat2", "lon2")


def compare_importance(a: DataFrame, b: DataFrame, key: str, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Two importances of the inputs that both name, side by side, and their rank correlation in each group."""
    table = a.select(*by, key, F.col("importance").alias("first")).join(b.select(*by, key, F.col("importance").alias("second")), [*by, key])
    return table, spearman(table, "first", "second", by)


def object_key(time: Column, suffix: str, minutes: int = 10) -> Column:
    """Key of the object that is published some minutes after a time: yyyy/MM/dd/yyyy-MM-ddTHHmmssZ and the suffix."""
    at = time + F.make_dt_interval(mins=F.lit(minutes))
    return F.concat(F.date_format(at, "yyyy/MM/dd/yyyy-MM-dd'T'HHmmss'Z'"), F.lit(suffix))


def regrid(values: DataFrame, routes: DataFrame, weights: DataFrame) -> DataFrame:
    """(variable, key, i, j, v): values (variable, key, src, v) on the target grid, every variable by the method that ``routes``
    (variable, method) names; ``weights`` (method, i, j, src, w) holds nearest, bilinear and kernel mappings alike. Missing
    sources are left out of the weighted mean; a target without any is not there."""
    routed = values.where("v IS NOT NULL AND NOT isnan(v)").join(routes, "variable").join(weights, ["method", "src"])
    return routed.groupBy("variable", "key", "i", "j").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"))


def frame_report(frames: DataFrame, key: str, v: str, least: float, pixel_km: float) -> DataFrame:
    """Per frame: statistics, active share (v > least) and areas of the classes cut at the 33rd, 66th and 90th percentile of the
    active values, with the 99th as a threshold; a frame without active values has null thresholds and areas of 0."""
    active, area = F.when(F.col(v) > least, F.col(v)), pixel_km * pixel_km
    cuts = ("light", "moderate", "heavy", "extreme")
    stats = frames.groupBy(key).agg(
        F.avg(v).alias("mean"), F.max(v).alias("max"), F.min(v).alias("min"), F.stddev_pop(v).alias("std"), F.count(v).alias("n"), F.count(active).alias("n_active"),
        F.percentile(active, F.array(*map(F.lit, (0.33, 0.66, 0.9, 0.99)))).alias("p"),
    )
    stats = stats.select("*", *[F.col("p")[k].alias(f"{c}_from") for k, c in enumerate(cuts)]).drop("p")
    low, mid, high = (F.col(f"{c}_from") for c in cuts[:3])
    x = F.col(v)
    classes = [x <= low, (x > low) & (x <= mid), (x > mid) & (x <= high), x > high]
    sized = frames.where(x > least).join(stats.select(key, *[f"{c}_from" for c in cuts[:3]]), key).groupBy(key).agg(*[(F.count_if(ok) * area).alias(f"{c}_km2") for c, ok in zip(cuts, classes)])
    return stats.join(sized, key, "left").withColumn("coverage", F.col("n_active") / F.col("n") * 100).fillna(0.0, [f"{c}_km2" for c in cuts])


def shortest_steps(messages: DataFrame, keys: list[str], variables: list[str]) -> DataFrame:
    """(keys, missing, variable, step, v): of the messages (keys, variable, step, v) of a file and time, that with the shortest step for each
    wanted variable, the least value on ties; ``missing`` names the variables that a file and time lacks, so that incomplete ones can be left out."""
    best = messages.where(F.col("variable").isin(variables)).groupBy(*keys, "variable").agg(F.min(F.struct("step", "v")).alias("m"))
    every = best.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("variable", F.col("m.step").alias("step"), F.col("m.v").alias("v")))).alias("x"))
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, variables)), F.transform("x", lambda e: e["variable"])))
    return every.select(*keys, F.array_join(missing, ",").alias("missing"), F.inline("x"))
