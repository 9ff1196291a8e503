"""Verification of probabilistic and categorical forecasts.

Scores are bucketed once; every threshold's confusion counts are reverse running sums over the small
bucket table, so the number of thresholds doesn't multiply the scan.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.ranks import neighbour_steps, numbered
from gridloom.operators.ranks import quantiles as quantiles_of

EPS = 1e-10


def r6(c: Column) -> Column:
    return F.round(c, 6)


def confusion_sweep(predictions: DataFrame, steps: int, by: list[str] = ()) -> DataFrame:
    """Counts tp, fp, fn, tn for thresholds k / steps, k = 0 .. steps; positive from p >= threshold."""
    by = list(by)
    bucket = F.floor(F.col("y_pred") * steps + 1e-9).cast("int")
    cells = predictions.groupBy(*by, bucket.alias("k")).agg(F.sum("y_true").alias("pos"), F.sum(1 - F.col("y_true")).alias("neg"))
    keys = cells.select(*by).distinct() if by else predictions.sparkSession.range(1)
    grid = keys.select(*by, F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("k"))
    full = grid.join(cells, [*by, "k"], "left").na.fill(0, ["pos", "neg"])
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    above = part.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = full.select(*by, "k", F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"), F.sum("pos").over(part).alias("p"), F.sum("neg").over(part).alias("q"))
    return out.select(*by, "k", (F.col("k") / steps).alias("threshold"), "tp", "fp", (F.col("p") - F.col("tp")).alias("fn"), (F.col("q") - F.col("fp")).alias("tn"))


def with_overall(predictions: DataFrame) -> DataFrame:
    """Rows once under their lead and once under lead 0, the aggregate."""
    return predictions.withColumn("lead", F.explode(F.array(F.col("lead"), F.lit(0))))


def binary_confusion(predictions: DataFrame, threshold: float, by: list[str] = ("lead",)) -> DataFrame:
    """Fractions of all rows: tp, fp, fn, tn."""
    hit, y = F.col("y_pred") >= threshold, F.col("y_true") == 1
    part = lambda c: r6(F.avg(F.when(c, 1.0).otherwise(0.0)))
    return predictions.groupBy(*by).agg(part(hit & y).alias("tp"), part(hit & ~y).alias("fp"), part(~hit & y).alias("fn"), part(~hit & ~y).alias("tn"))


def skill_scores() -> dict[str, Column]:
    """Named scores as columns over tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    chance = (tp + fp) * (tp + fn) / (n + EPS)
    pod, fpr = tp / (tp + fn + EPS), fp / (fp + tn + EPS)
    return {
        "csi": tp / (tp + fp + fn + EPS), "pod": pod, "far": fp / (tp + fp + EPS), "fpr": fpr,
        "ets": (tp - chance) / (tp + fp + fn - chance + EPS),
        "hss": 2 * (tp * tn - fp * fn) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn) + EPS),
        "pss": pod - fpr,
    }


def score_table(sweep: DataFrame, by: list[str] = ()) -> DataFrame:
    return sweep.select(*by, "k", *[r6(c).alias(name) for name, c in skill_scores().items()])


def best_threshold(sweep: DataFrame, score: str = "csi", by: list[str] = ("lead",)) -> DataFrame:
    """The first threshold with the highest score."""
    scored = sweep.withColumn("score", skill_scores()[score])
    best = scored.groupBy(*by).agg(F.min(F.struct((-r6(F.col("score"))).alias("s"), F.col("k").alias("k"))).alias("best"))
    return best.select(*by, F.col("best.k").alias("k"), (-F.col("best.s")).alias(score))


def curve_points(sweep: DataFrame, by: list[str] = ()) -> DataFrame:
    """Precision, recall and false positive rate at every threshold."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    return sweep.select(*by, "k", r6(1 - fp / (tp + fp + EPS)).alias("precision"), r6(tp / (tp + fn + EPS)).alias("recall"), r6(fp / (fp + tn + EPS)).alias("fpr"))


def area_under(points: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Trapezoid sum over points sorted by x, then y."""
    order = Window.partitionBy(*by).orderBy(x, y)
    steps = points.select(*by, (F.col(x) - F.lag(x).over(order)).alias("dx"), ((F.col(y) + F.lag(y).over(order)) / 2).alias("mid"))
    return steps.groupBy(*by).agg(r6(F.coalesce(F.sum(F.col("dx") * F.col("mid")), F.lit(0.0))).alias("auc"))


def reliability(predictions: DataFrame, bins: int = 10, last_inclusive: bool = True, by: list[str] = ()) -> DataFrame:
    """Observed rate of each probability bin. With last_inclusive p = 1 is in the last bin, else it is dropped; empty bins rate 0 then."""
    by = list(by)
    k = F.floor(F.col("y_pred") * bins + 1e-9).cast("int")
    rows = predictions if last_inclusive else predictions.where("y_pred < 1")
    cells = rows.groupBy(*by, F.least(k, F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("y_true").alias("rate"))
    keys = predictions.select(*by).distinct() if by else predictions.sparkSession.range(1)
    grid = keys.select(*by, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    rate = F.col("rate") if last_inclusive else F.coalesce("rate", F.lit(0.0))
    return grid.join(cells, [*by, "bin"], "left").select(*by, "bin", ((F.col("bin") + 0.5) / bins).alias("centre"), F.coalesce("n", F.lit(0).cast("long")).alias("n"), r6(rate).alias("rate"))


def calibrated(predictions: DataFrame, curve: DataFrame, bins: int = 10) -> DataFrame:
    """p mapped by linear interpolation on bin centres, end segments extended, clipped to 0..1."""
    order = Window.partitionBy(F.lit(0)).orderBy("bin")
    segments = curve.select("bin", "centre", F.col("rate").alias("r0"), F.lead("rate").over(order).alias("r1")).where("r1 IS NOT NULL")
    segment = F.greatest(F.lit(0), F.least(F.lit(bins - 2), F.floor(F.col("y_pred") * bins - 0.5 + 1e-9))).cast("int")
    joined = predictions.withColumn("bin", segment).join(F.broadcast(segments), "bin")  # at most ``bins`` rows
    value = F.col("r0") + (F.col("r1") - F.col("r0")) * (F.col("y_pred") - F.col("centre")) * bins
    return joined.select("id", r6(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))).alias("p_cal"))


def class_confusion(classes: DataFrame) -> DataFrame:
    """Counts by lead (0: all), true and predicted class, with the row-normalised share."""
    n = with_overall(classes).groupBy("lead", "t", "p").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy("lead", "t"))))


def class_scores(classes: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of every class by lead (0: all), with the accuracy of the lead."""
    n = with_overall(classes).groupBy("lead", "t", "p").agg(F.count(F.lit(1)).alias("n"))
    side = lambda c: n.groupBy("lead", F.col(c).alias("class")).agg(F.sum("n").alias(f"of_{c}"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias(f"hit_{c}"))
    both = side("t").join(side("p"), ["lead", "class"], "full_outer").na.fill(0)
    precision, recall = (F.coalesce(F.try_divide(F.col(f"hit_{c}").cast("double"), F.col(f"of_{c}")), F.lit(0.0)) for c in ("p", "t"))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    lead = Window.partitionBy("lead")
    return both.select("lead", "class", r6(precision).alias("precision"), r6(recall).alias("recall"), r6(f1).alias("f1"), F.col("of_t").alias("support"), r6(F.sum("hit_t").over(lead) / F.sum("of_t").over(lead)).alias("accuracy"))


def errors_by_lead(predictions: DataFrame) -> DataFrame:
    """MAE, RMSE, cross-entropy and error of the rounded prediction (half-even); NaN predictions are left out."""
    p, y = F.when(~F.isnan("y_pred"), F.col("y_pred")), F.col("y_true").cast("double")
    q = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), p))
    return predictions.groupBy("lead").agg(
        r6(F.avg(F.abs(p - y))).alias("mae"), r6(F.sqrt(F.avg(F.pow(p - y, 2)))).alias("rmse"),
        r6(F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q)))).alias("cross_entropy"), r6(F.avg(F.abs(F.bround(p, 0) - y))).alias("binary_error"),
    )


def losses(predictions: DataFrame, weight: float = 10.0, gamma: float = 2.0) -> DataFrame:
    """Weighted focal, weighted BCE, weighted MSE, Dice, IoU (soft and rounded) over the table, by lead."""
    p, y = F.col("y_pred"), F.col("y_true").cast("double")
    q = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), p))
    b = F.bround(p, 0)
    w = F.when(y == 1, weight).otherwise(1.0)
    bce = -(y * F.log(q) + (1 - y) * F.log(1 - q))
    pt = F.when(y == 1, q).otherwise(1 - q)
    inter, both = F.sum(y * p), F.sum(y) + F.sum(p)
    hit, all_b = F.sum(y * b), F.sum(y) + F.sum(b)
    return predictions.groupBy("lead").agg(
        r6(F.avg(w * F.pow(1 - pt, F.lit(gamma)) * bce)).alias("focal"), r6(F.avg(w * bce)).alias("weighted_bce"), r6(F.avg(w * F.pow(p - y, 2))).alias("weighted_mse"),
        r6((2 * inter + 1) / (both + 1)).alias("dice"), r6(inter / (both - inter)).alias("soft_iou"), r6(hit / (all_b - hit)).alias("iou"),
    )


def banded_loss(predictions: DataFrame, weights: list[float]) -> DataFrame:
    """Squared error weighted by equal bands of the prediction target in 0..1 (last band inclusive)."""
    n = len(weights)
    band = F.least(F.floor(F.col("y_pred") * n + 1e-9).cast("int"), F.lit(n - 1))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), band + 1)
    return predictions.groupBy("lead").agg(r6(F.avg(w * F.pow(F.col("y_true") - F.col("y_pred"), 2))).alias("loss"))


def sweep_median(sweep: DataFrame) -> DataFrame:
    """Exact median over thresholds of each confusion cell, by lead."""
    return sweep.groupBy("lead").agg(*[F.median(c).alias(c) for c in ("tp", "fp", "fn", "tn")])


def xi_correlation(rows: DataFrame, x: str, y: str, key: str, by: list[str], variant: str = "reference") -> DataFrame:
    """Rank correlation 1 - sum |successive rank differences| / (2 n^2 / 3), clipped to 0..1; 'published': 1 - 3 sum / (n^2 - 1).

    Pairs with a null are dropped; fewer than 2 rows give null. Ties are ordered by key.
    """
    ranked = numbered(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y, key), by, [y, key], "ry").select(*by, x, key, "ry")
    steps = neighbour_steps(ranked, by, [x, key], F.abs(F.col("ry") - F.col("was_")), "ry")
    total = steps.select(*by, F.col("total").cast("double").alias("s"), F.col("n").cast("double").alias("n"))
    n, s = F.col("n"), F.col("s")
    xi = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - s / (2 * n * n / 3))) if variant == "reference" else 1 - 3 * s / (n * n - 1)
    return total.select(*by, F.when(n > 1, r6(xi)).alias("xi"))


def quantile_map(rows: DataFrame, source: str, target: str, by: list[str], quantiles: int = 20) -> DataFrame:
    """Matched exact quantiles of source and target: (by, q, source_q, target_q)."""
    side = lambda c, name: quantiles_of(rows.select(*by, F.col(c).cast("double").alias("x_")), by, "x_", quantiles).select(*by, "q", r6(F.col("x_")).alias(name))
    return side(source, "source_q").join(side(target, "target_q"), [*by, "q"])


def monotone_coupling(rows: DataFrame, source: str, target: str, key: str, by: list[str]) -> DataFrame:
    """One-dimensional optimal transport of equal sizes: the k-th smallest source goes to the k-th smallest target."""
    s = numbered(rows.select(*by, F.col(key).alias(key), F.col(source).alias("s")), by, ["s", key], "k")
    t = numbered(rows.select(*by, F.col(target).alias("mapped"), F.col(key).alias("at")), by, ["mapped", "at"], "k").drop("at")
    return s.join(t, [*by, "k"]).select(*by, key, r6(F.col("mapped")).alias("mapped"))


def shapley(scores: DataFrame) -> DataFrame:
    """Mean marginal contribution of each source, averaged by coalition size and then over sizes.

    scores: (coalition sorted array of strings, score). Only sizes for which both coalitions exist count.
    """
    named = scores.select(F.col("coalition").alias("c"), F.col("score").alias("with"))
    parts = named.select("c", "with", F.explode("c").alias("source")).withColumn("rest", F.array_except("c", F.array("source")))
    less = scores.select(F.col("coalition").alias("rest"), F.col("score").alias("without"))
    gain = parts.join(less, "rest").groupBy("source", F.size("c").alias("k")).agg(F.avg(F.col("with") - F.col("without")).alias("g"))
    return gain.groupBy("source").agg(r6(F.avg("g")).alias("value"), F.count(F.lit(1)).alias("sizes"))


def gram_matrix(wide: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Normal equations of a linear ensemble: sums of products of all pairs and with the target, in one row."""
    cells = [F.avg(F.col(a) * F.col(b)).alias(f"{a}_{b}") for k, a in enumerate(columns) for b in columns[k:]]
    return wide.agg(*cells, *[F.avg(F.col(a) * F.col(target)).alias(f"{a}_{target}") for a in columns])
