"""Physical scaling of variables as Column -> Column functions.

NaN is filled before any comparison or clip, since Spark orders NaN above everything. The numbers
are fixed values of the variables' scaling.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _log(fill: float, shift: float, scale: float) -> Callable[[Column], Column]:
    """(log10 of the value, clipped from below at the fill, plus shift) over scale."""
    return lambda x: (F.log10(F.greatest(F.nanvl(x, F.lit(fill)), F.lit(fill))) + shift) / scale


def _linear(fill: float, mean: float, std: float) -> Callable[[Column], Column]:
    return lambda x: (F.nanvl(x, F.lit(fill)) - mean) / std


def _limited(fill: float, mean: float, std: float, limit: float = 60000.0) -> Callable[[Column], Column]:
    """NaN and codes above the limit become the fill."""
    return lambda x: (F.when(F.isnan(x) | (x > limit), fill).otherwise(x) - mean) / std


def rain_accumulation(x: Column) -> Column:
    clean = F.nanvl(x, F.lit(0.01))
    return F.log10(F.when(clean < 0.1, 0.01).otherwise(clean))


def optical_thickness(x: Column) -> Column:
    clean = F.when(F.isnan(x) | (x > 60000.0), 0.1).otherwise(x)
    return (F.log10(F.greatest(clean, F.lit(0.1))) - 0.94) / 0.588


def occurrence(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.nanvl(x, F.lit(0.0))))


def phase_one_hot(x: Column) -> Column:
    """Five channels for codes 1, 2, 3, 4 and all others; half-even rounding first."""
    code = F.bround(F.nanvl(x, F.lit(0.0)), 0).cast("int")
    return F.array(*[(code == k).cast("float") for k in (1, 2, 3, 4)], (~code.isin(1, 2, 3, 4)).cast("float"))


def rain_class(x: Column) -> Column:
    """0..4 by cuts at 10, 20, 30 and 40."""
    clean = F.nanvl(x, F.lit(0.0))
    return F.when(clean < 10, 0).when(clean < 20, 1).when(clean < 30, 2).when(clean < 40, 3).otherwise(4)


def rain_label(x: Column) -> Column:
    return F.least(F.lit(70.0), F.greatest(F.lit(0.0), F.nanvl(x, F.lit(0.0)))) / 70.0


#: Transform of each variable; fixed values.
TRANSFORMS: dict[str, Callable[[Column], Column]] = {
    "rzc": _log(0.01, 0.051, 0.528),
    "czc": _linear(-5.0, 21.3, 8.71),
    "ezc": _linear(0.0, 0.0, 1.97),
    "lzc": _log(0.5, 0.274, 0.135),
    "bzc": _linear(0.0, 0.0, 100.0),
    "cpch": rain_accumulation,
    "density": _log(1e-4, 0.593, 0.640),
    "current": _log(1e-8, -0.0718, 0.731),
    "occurrence": occurrence,
    "visible": _linear(0.0, 0.0, 100.0),
    "ir039": _linear(274.0, 274.0, 17.5),
    "thermal": _linear(250.0, 250.0, 10.0),
    "ctth_alti": _limited(-1000.0, 5260.0, 2810.0),
    "ctth_tempe": _limited(330.0, 260.0, 19.2),
    "cmic_cot": optical_thickness,
    "rain_label": rain_label,
}


def class_confidence(p: Column, cuts: list[float]) -> Column:
    """1 - |p - centre| / half width of the class interval that p is in, clipped to 0..1; cuts include both ends."""
    out = None
    for low, high in zip(cuts[:-1], cuts[1:]):
        value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs(p - (low + high) / 2) / ((high - low) / 2)))
        out = F.when(p < high, value) if out is None else out.when(p < high, value)
    return out.otherwise(0.0)


def log_quantize(x: Column, low: float, high: float, levels: int) -> Column:
    """0 below low, ``levels`` from high up, else 1 + the nearest of a uniform grid in log space; in the first cell always 1."""
    step = (F.log10(F.lit(high)) - F.log10(F.lit(low))) / (levels - 1)
    at = (F.log10(F.greatest(x, F.lit(low))) - F.log10(F.lit(low))) / step
    return F.when(x < low, 0).when(x >= high, levels).otherwise(F.when(at < 1, 1).otherwise(F.floor(at + 0.5) + 1)).cast("int")


def scale_table(spark, low: float, high: float, levels: int) -> DataFrame:
    """(code, value): 0 for code 0 and a uniform log grid from low to high for 1..levels."""
    k = F.col("id") - 1
    value = F.pow(F.lit(10.0), F.log10(F.lit(low)) + k * (F.log10(F.lit(high)) - F.log10(F.lit(low))) / (levels - 1))
    return spark.range(levels + 1).select(F.col("id").cast("int").alias("code"), F.when(F.col("id") == 0, 0.0).otherwise(value).alias("value"))


def decode(rows: DataFrame, table: DataFrame, offset: float | None = None) -> DataFrame:
    """Codes to values of a lookup table (broadcast: it has a row per code); unknown codes give 0; with offset log10(value + offset)."""
    value = F.coalesce("value", F.lit(0.0))
    return rows.join(F.broadcast(table), "code", "left").withColumn("value", value if offset is None else F.log10(value + offset))


def standardise(x: Column, mean: float, std: float, threshold: float | None = None, fill: float | None = None) -> Column:
    """(x - mean) / std; below a threshold the fill is taken instead."""
    y = x if threshold is None else F.when(x < threshold, fill).otherwise(x)
    return (y - mean) / std


def saturate(x: Column, kind: str) -> Column:
    """A cast that clips to the range of the type and doesn't overflow."""
    low, high = {"float16": (-65000.0, 65000.0), "tinyint": (-128, 127), "smallint": (-32768, 32767), "int": (-(2**31), 2**31 - 1)}[kind]
    return F.greatest(F.lit(low), F.least(F.lit(high), x)).cast("float" if kind == "float16" else kind)


def heat_index(t: Column, h: Column) -> Column:
    """The polynomial in temperature (C, converted to F) and relative humidity in percent, back in C; fixed coefficients."""
    f = t * 9 / 5 + 32
    c = [-42.379, 2.04901523, 10.14333127, -0.22475541, -6.83783e-3, -5.481717e-2, 1.22874e-3, 8.5282e-4, -1.99e-6]
    terms = [F.lit(1.0), f, h, f * h, f * f, h * h, f * f * h, f * h * h, f * f * h * h]
    total = sum((k * x for k, x in zip(c[1:], terms[1:])), F.lit(c[0]))
    return (total - 32) * 5 / 9


def erf(x: Column) -> Column:
    """Error function by a published rational approximation (absolute error under 1.5e-7)."""
    t = 1 / (1 + 0.3275911 * F.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.signum(x) * (1 - poly * F.exp(-x * x))
