"""Probabilistic rain scores: lognormal parameters, Gaussian cross-entropy, and cross-entropy of rain histograms."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.transforms import erf

#: Standard deviation in log space that goes with one of 0.33 times the mean; a fixed value.
SIGMA = 0.3215


def soft_cross_entropy(y: Column, p: Column) -> Column:
    """Binary cross-entropy for targets between 0 and 1."""
    return -(y * F.log(p) + (1 - y) * F.log(1 - p))


def log_mean(log10_rain: Column) -> Column:
    """The mean in natural log space of lognormal rain with the given log10 of its mean."""
    return math.log(10.0) * log10_rain - SIGMA * SIGMA / 2


def gaussian_cross_entropy(mu: Column, sigma: Column, mu_pred: Column, sigma_pred: Column) -> Column:
    ratio = sigma / sigma_pred
    return 0.5 * (ratio * ratio + F.pow((mu - mu_pred) / sigma_pred, 2) - 1) - F.log(ratio)


def accumulated(rain: DataFrame, keys: list[str], dry_below: float, samples_per_hour: float) -> DataFrame:
    """(keys, total): the rain of a series, samples below ``dry_below`` counting as none; ``rain`` has a column ``r``."""
    return rain.groupBy(*keys).agg((F.sum(F.when(F.col("r") < dry_below, 0.0).otherwise(F.col("r"))) / samples_per_hour).alias("total"))


def running_rain(rain: DataFrame, keys: list[str], step: str, dry_below: float) -> DataFrame:
    """(keys, step, total): mean rain up to every step of a series."""
    so_far = Window.partitionBy(*keys).orderBy(step).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rain.select(*keys, step, F.avg(F.when(F.col("r") < dry_below, 0.0).otherwise(F.col("r"))).over(so_far).alias("total"))


def histogram_cross_entropy(totals: DataFrame, bins: list[float], predicted: Column, dry_below: float) -> DataFrame:
    """``totals`` with ``loss``: the cross-entropy of ``predicted`` (an array of a share for below, between and above
    ``bins``) against the lognormal histogram of ``total``; all of it is in the first bin where it is dry."""
    dry = F.col("total") < dry_below
    mu = log_mean(F.log10(F.when(dry, dry_below * 0.1).otherwise(F.col("total"))))
    below = [0.5 * (1 + erf((math.log(b) - F.col("mu_")) / (math.sqrt(2) * SIGMA))) for b in bins]
    shares = F.array(below[0], *[b - a for a, b in zip(below[:-1], below[1:])], 1 - below[-1])
    only_first = F.array(F.lit(1.0), *[F.lit(0.0)] * len(bins))
    out = totals.withColumn("mu_", mu).withColumn("shares_", F.when(dry, only_first).otherwise(shares))
    loss = F.aggregate(F.zip_with("shares_", predicted, lambda s, p: -s * F.log(p)), F.lit(0.0), lambda a, x: a + x)
    return out.withColumn("loss", loss).drop("mu_", "shares_")
