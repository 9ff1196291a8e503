"""Cleaning rules, geometry, volumetric columns, ensembles and summaries over fields."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.draws import drawn
from gridloom.operators.ranks import numbered, running_counts, running_totals


def r6(c: Column) -> Column:
    return F.round(c, 6)


def clean_sentinel(v: Column, sentinel: float, low: float) -> Column:
    """The sentinel becomes null, values under ``low`` 0."""
    return F.when(F.isnan(v) | (v == sentinel), None).when(v < low, 0.0).otherwise(v)


def fill_with_minimum(rows: DataFrame, keys: list[str], v: str) -> DataFrame:
    """NaN and null become the least valid value of their frame."""
    valid = F.when(~F.isnan(v), F.col(v))
    return rows.withColumn(v, F.coalesce(valid, F.min(valid).over(Window.partitionBy(*keys))))


def finite_degrees(x: Column, limit: float) -> Column:
    """Off-disk coordinates (NaN, infinite) become 0; others are clipped to +-limit."""
    bad = F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, 0.0).otherwise(F.greatest(F.lit(-limit), F.least(F.lit(limit), x)))


def finite_values(x: Column, top: float = 1e6) -> Column:
    return F.when(F.isnan(x), 0.0).when(x == float("inf"), top).when(x == float("-inf"), -top).otherwise(x)


def sun_corrected(v: Column, sun_z: Column, floor: float) -> Column:
    """v / z where the sun is high enough, else 0."""
    return F.when(sun_z > floor, v / sun_z).otherwise(0.0)


def height_fixed(seconds: Column, cutoff: int, height: Column, surface: Column) -> Column:
    """Before the cutoff heights are above ground: the surface is subtracted."""
    return F.when(seconds < cutoff, height - F.coalesce(surface, F.lit(0.0))).otherwise(height)


def select_predictors(predictors: DataFrame, variables: DataFrame) -> DataFrame:
    """Predictors (pos, pred) equal to, or prefixed ``var-`` by, a variable; each once, in their order."""
    root = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(F.split("pred", "-"))), lambda k: F.array_join(F.slice(F.split("pred", "-"), F.lit(1), k), "-")))
    keyed = predictors.select("pos", "pred", F.explode(root).alias("var"))
    return keyed.join(variables.select("var").distinct(), "var", "leftsemi").select("pos", "pred").distinct()


def all_valid(pixels: DataFrame, keys: list[str], expected: int) -> DataFrame:
    """Tiles that have all their pixels and no NaN."""
    return pixels.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.bool_and(~F.isnan("v")).alias("ok")).where((F.col("n") == expected) & F.col("ok")).select(*keys)


def box_quality(boxes: DataFrame, columns: list[str]) -> DataFrame:
    """One row: how many boxes, how many different, how many with a null."""
    anynull = None
    for c in columns:
        anynull = F.col(c).isNull() if anynull is None else anynull | F.col(c).isNull()
    return boxes.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.struct(*columns)).alias("different"), F.count_if(anynull).alias("incomplete"))


def gaussian_resample(targets: DataFrame, sources: DataFrame, sigma: float, radius: float) -> DataFrame:
    """Mean of sources (x, y, v) within the radius of targets (tid, x, y), weighted by exp(-d^2 / sigma^2).

    Sources of one place are added up first, and targets of one place share their mean: only different places are paired. Neither
    side is broadcast, as small rows of many places would be.
    """
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    near = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    t = targets.select("x", "y").distinct().select("x", "y", F.explode(near).alias("o")).select("x", "y", (cell("x") + F.col("o.a")).alias("cx"), (cell("y") + F.col("o.b")).alias("cy"))
    places = sources.groupBy("x", "y").agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("k"))
    s = places.select(F.col("x").alias("sx"), F.col("y").alias("sy"), "v", "k", cell("x").alias("cx"), cell("y").alias("cy"))
    d2 = F.pow(F.col("x") - F.col("sx"), 2) + F.pow(F.col("y") - F.col("sy"), 2)
    pairs = t.join(s.hint("merge"), ["cx", "cy"]).withColumn("d2", d2).where(F.col("d2") <= radius * radius).withColumn("w", F.exp(-F.col("d2") / (sigma * sigma)))
    sums = pairs.groupBy("x", "y").agg(F.sum(F.col("w") * F.col("v")).alias("wv"), F.sum(F.col("w") * F.col("k")).alias("w"), F.sum("k").alias("n"))
    of_targets = targets.select("tid", "x", "y").join(sums.hint("merge"), ["x", "y"])
    return of_targets.groupBy("tid").agg(r6(F.sum("wv") / F.sum("w")).alias("v"), F.sum("n").alias("n"))


def active_pixels(pixels: DataFrame, patch: Column, active: DataFrame) -> DataFrame:
    """Pixels of active patches only (frame, patch_id)."""
    return pixels.withColumn("patch_id", patch).join(active, ["frame", "patch_id"], "leftsemi")


def elevation_angle(sat_lon: float, sat_km: float, lon: Column, lat: Column, earth_km: float = 6371.0) -> Column:
    """Elevation in degrees of a satellite above the equator, on a sphere."""
    cosine = F.cos(F.radians(lat)) * F.cos(F.radians(lon - sat_lon))
    ratio = earth_km / (earth_km + sat_km)
    return F.degrees(F.atan2(cosine - ratio, F.sqrt(1 - cosine * cosine)))


def parallax_shift(height_km: Column, elevation: Column) -> Column:
    """Ground distance by which a cloud top is displaced; null at elevation 0."""
    return F.try_divide(height_km, F.tan(F.radians(elevation)))


def sun_elevation(seconds: Column, lon: Column, lat: Column) -> Column:
    """Sine of the sun's elevation by a low-precision published formula (about a degree)."""
    day = seconds / 86400.0 - 10957.5
    g, q = F.radians(F.pmod(357.529 + 0.98560028 * day, F.lit(360.0))), F.pmod(280.459 + 0.98564736 * day, F.lit(360.0))
    ecliptic = F.radians(q + 1.915 * F.sin(g) + 0.020 * F.sin(2 * g))
    tilt = F.radians(F.lit(23.439) - 0.00000036 * day)
    declination = F.asin(F.sin(tilt) * F.sin(ecliptic))
    ascension = F.atan2(F.cos(tilt) * F.sin(ecliptic), F.cos(ecliptic))
    sidereal = F.radians(F.pmod(280.46061837 + 360.98564736629 * day + lon, F.lit(360.0)))
    return F.sin(F.radians(lat)) * F.sin(declination) + F.cos(F.radians(lat)) * F.cos(declination) * F.cos(sidereal - ascension)


def volumetric(columns: DataFrame, keys: list[str], threshold: float, dz: float) -> DataFrame:
    """Echo top (highest level at the threshold), integrated liquid and largest reflectivity (null under 20) of columns (keys, level, z)."""
    liquid = 3.44e-6 * F.pow(F.pow(F.lit(10.0), F.col("z") / 10), F.lit(4 / 7))
    top = F.max("z")
    return columns.groupBy(*keys).agg(F.max(F.when(F.col("z") >= threshold, F.col("level"))).alias("echo_top"), F.round(F.sum(liquid) * dz, 8).alias("vil"), F.when(top >= 20, top).alias("max_z"))


def weighted_ensemble(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted and plain mean of model predictions (id, model, p)."""
    w = F.coalesce(*[F.when(F.col("model") == m, F.lit(x)) for m, x in weights.items()], F.lit(0.0))
    return rows.groupBy("id").agg(r6(F.sum(w * F.col("p"))).alias("weighted"), r6(F.avg("p")).alias("mean"))


def distillation(rows: DataFrame, temperature: float, alpha: float) -> DataFrame:
    """Hard cross-entropy, softened KL divergence and their weighted total over (lead, y, student, teacher)."""
    clip = lambda c: F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), c))
    logit = lambda c: F.log(c / (1 - c))
    soft = lambda c: clip(1 / (1 + F.exp(-logit(c) / temperature)))
    s, t = clip(F.col("student")), clip(F.col("teacher"))
    hard = -(F.col("y") * F.log(s) + (1 - F.col("y")) * F.log(1 - s))
    kl = soft(t) * F.log(soft(t) / soft(s)) + (1 - soft(t)) * F.log((1 - soft(t)) / (1 - soft(s)))
    return rows.groupBy("lead").agg(r6(F.avg(hard)).alias("hard"), r6(F.avg(kl)).alias("soft"), r6(F.avg(alpha * hard + (1 - alpha) * temperature * temperature * kl)).alias("total"))


def ecdf_map(rows: DataFrame, source: str, target: str, key: str, by: list[str]) -> DataFrame:
    """Mean percentile of each source value, looked up among the sorted targets."""
    counts = running_counts(rows.select(*by, source), by, source).select(*by, source, F.col("n").alias("c"), "upto")
    total = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    pct = (F.col("upto") - F.col("c") + F.col("upto")) / (2 * F.col("n"))
    s = rows.select(*by, key, source).join(counts, [*by, source]).join(total, by).select(*by, key, F.greatest(F.lit(1), F.ceil(pct * F.col("n"))).cast("long").alias("k"))
    t = numbered(rows.select(*by, F.col(target).alias("mapped"), F.col(key).alias("at")), by, ["mapped", "at"], "k").drop("at")
    return s.join(t, [*by, "k"]).select(*by, key, r6(F.col("mapped")).alias("mapped"))


def value_distribution(rows: DataFrame, v: str, by: str, bins: int = 5) -> DataFrame:
    """Equal bins from 0 to the overall largest value: count in each."""
    top = rows.agg(F.max(v)).scalar()
    return rows.groupBy(by, F.least(F.floor(F.col(v) / (top / bins)), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def spearman(rows: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Rank correlation with average ranks for ties."""
    ranked = rows.select(*by, a, b)
    for c, name in ((a, "ra"), (b, "rb")):
        mean = running_counts(rows.select(*by, c), by, c).select(*by, c, (F.col("upto") - F.col("n") + 1 + (F.col("n") - 1) / 2).alias(name))
        ranked = ranked.join(mean, [*by, c])
    return ranked.groupBy(*by).agg(F.round(F.corr("ra", "rb"), 6).alias("rho"))


def attribution(rows: DataFrame, by: list[str], v: str) -> DataFrame:
    return rows.groupBy(*by).agg(r6(F.avg(F.abs(v))).alias("importance"))


def running_mean(rows: DataFrame, key: str, order: list[str], v: str) -> DataFrame:
    """Mean of all values up to each row, in groups of any size."""
    sums = running_totals(rows.select(key, *order, v), [key], order, v)
    return sums.select(key, *order, F.round(F.try_divide("sum_", "n_"), 10).alias("running"))


def expand_regions(regions: DataFrame, times: int, reach: int) -> DataFrame:
    """Regions (t, i, j) activate cells within +-reach at times within +-times; each cell once."""
    axis = lambda n: F.sequence(F.lit(-n).cast("long"), F.lit(n).cast("long"))
    at = regions.select("t", "i", "j").distinct().select(F.explode(F.transform(axis(times), lambda d: F.col("t") + d)).alias("t"), "i", "j").distinct()
    rows = at.select("t", F.explode(F.transform(axis(reach), lambda d: F.col("i") + d)).alias("i"), "j").distinct()
    return rows.select("t", "i", F.explode(F.transform(axis(reach), lambda d: F.col("j") + d)).alias("j")).distinct()


def frame_origins(cells: DataFrame, size: int, seed: int | None = None) -> DataFrame:
    """Bounding box of each time (t, i, j) and an origin: its corner, or a seeded one within it."""
    box = cells.groupBy("t").agg(*[f(c).alias(f"{c}_{n}") for c in ("i", "j") for n, f in (("min", F.min), ("max", F.max))])
    room = lambda c: F.greatest(F.lit(1), F.col(f"{c}_max") - F.col(f"{c}_min") + 1 - size + 1)
    draw = lambda c, k: F.col(f"{c}_min") if seed is None else F.col(f"{c}_min") + drawn(F.concat_ws("-", F.lit(str(seed + k)), F.col("t").cast("string")), room(c))
    return box.select("t", "i_min", "i_max", "j_min", "j_max", draw("i", 0).alias("i0"), draw("j", 1).alias("j0"))


def run_summary(active: DataFrame, seen: DataFrame) -> DataFrame:
    """Steps seen, steps with activity, their share, and how many patches were ever active."""
    n = seen.select("slot").distinct().agg(F.count(F.lit(1))).scalar()
    return active.agg(F.countDistinct("slot").alias("active_steps"), F.countDistinct("patch_id").alias("patches")).select(n.alias("steps"), "active_steps", r6(F.col("active_steps") * 100 / n).alias("percent"), "patches")


def metric_table(validation: DataFrame, test: DataFrame, scores: dict[str, Column]) -> DataFrame:
    """For each lead the threshold with the highest CSI on validation sweeps, and all scores there on test sweeps."""
    best = validation.groupBy("lead").agg(F.min(F.struct(-F.round(scores["csi"], 6), F.col("k").alias("k"))).alias("m")).select("lead", "m.k")
    return test.join(best, ["lead", "k"]).select("lead", "k", *[r6(c).alias(n) for n, c in scores.items()])
