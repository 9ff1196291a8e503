"""What a model reads, declared: products and where their files are, sources, and predictors made of them.

A predictor names the sources that it needs, a function of their values, and its time frame: ``past`` steps up to the
reference, ``future`` steps after it, or ``static`` values without a time. A selection of predictors becomes one plan: only the
sources in use are read, their values meet once by time and place, all functions are applied to that row, and one join gives
each reference its steps.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Products by group, with their resolution and the factor by which patches are pooled.
PRODUCTS = {
    "radar": {"RZC": ("HR", 1), "BZC": ("HR", 1), "CZC": ("HR", 1), "EZC-20": ("HR", 1), "LZC": ("HR", 1), "CPCH": ("HR", 1)},
    "satellite_MSG": {"VIS006": ("LR", 4), "IR_039": ("LR", 4), "IR_108": ("LR", 4), "WV_062": ("LR", 4), "WV_073": ("LR", 4)},
    "satellite_MTG": {"vis_06": ("HR", 1), "ir_38": ("LR", 2), "ir_105": ("LR", 2), "wv_63": ("LR", 2), "wv_73": ("LR", 2)},
    "lightning": {"density": ("HR", 1), "current": ("HR", 1), "occurrence": ("HR", 1)},
    "nwcsaf": {"ctth_alti": ("LR", 4), "ctth_tempe": ("LR", 4), "cmic_phase": ("LR", 4), "cmic_cot": ("LR", 4)},
}
_FOLDERS = {"radar": "radar_data", "satellite_MSG": "satellite_data/MSG", "satellite_MTG": "satellite_data/MTG", "lightning": "lightning_data"}


def products(spark: SparkSession) -> DataFrame:
    """(variable, product_group, resolution, pool): the products as a table, small enough to be broadcast."""
    return spark.createDataFrame([(v, g, r, p) for g, known in PRODUCTS.items() for v, (r, p) in known.items()], "variable string, product_group string, resolution string, pool int")


def file_key(group: Column, variable: Column, second: Column) -> Column:
    """What names the file of a variable at a time: its path below ``regridded_data``; for cloud products, whose file names
    hold more than that, the folder, the product and the time."""
    t = F.timestamp_seconds(second)
    day = F.date_format(t, "yyyy-MM-dd")
    time, compact = F.date_format(t, "HHmm"), F.date_format(t, "yyyyMMdd")
    folder = F.concat(F.lit("nc4_"), day, F.lit("-Romania_"), variable)
    own = F.when(group == "lightning", F.concat(F.lit("lightning_"), variable, F.lit("_"), compact, F.lit("_"), time)).otherwise(F.concat(F.lit("nc4_"), day, F.lit("-Romania_"), time, F.lit("_"), variable))
    top = F.lit(None).cast("string")
    for name, place in _FOLDERS.items():
        top = F.when(group == name, F.lit(place)).otherwise(top)
    plain = F.concat_ws("/", F.when(top.isNotNull(), top), variable, folder, F.concat(own, F.lit(".npy")))
    cloud = F.concat(F.lit("nwcsaf_data/"), day, F.lit("-Romania/"), F.upper(F.substring_index(variable, "_", 1)), F.lit("/"), compact, F.lit("T"), time, F.lit("00"))
    return F.when(group == "nwcsaf", cloud).when(top.isNotNull(), plain)


def key_of_path(path: Column) -> Column:
    """The ``file_key`` that a file answers, from its path; null for files of no convention."""
    below = F.regexp_extract(path, r"(?:^|/)regridded_data/(.*)$", 1)
    cloud = r"^(nwcsaf_data/[^/]+/)S_NWC_([^_/]+)_[^/]*(\d{8}T\d{6})[^/]*\.nc$"
    return F.when(below.rlike(cloud), F.concat(F.regexp_extract(below, cloud, 1), F.regexp_extract(below, cloud, 2), F.lit("/"), F.regexp_extract(below, cloud, 3))).when(below.endswith(".npy"), below)


def resolved_paths(requests: DataFrame, files: DataFrame) -> DataFrame:
    """(variable, s, product_group, resolution, pool, path) of requests (variable, s): the file, the first by name where several answer, or a
    null path. ``files``: (path)."""
    known = requests.select("variable", "s").join(F.broadcast(products(requests.sparkSession)), "variable", "left").withColumn("key", file_key(F.col("product_group"), F.col("variable"), F.col("s")))
    found = files.withColumn("key", key_of_path(F.col("path"))).where("key IS NOT NULL").groupBy("key").agg(F.min("path").alias("path"))
    return known.join(found, "key", "left").drop("key")


@dataclass(frozen=True)
class Source:
    """``load`` gives (t, key, v); static sources have null times. It is called only if the source is in use."""

    name: str
    load: Callable[[SparkSession], DataFrame]


@dataclass(frozen=True)
class Predictor:
    name: str
    sources: tuple[str, ...]
    function: Callable[..., Column]
    timeframe: str = "past"


class Catalog:
    """Declared sources and predictors, to which users add their own."""

    def __init__(self):
        self.sources: dict[str, Source] = {}
        self.predictors: dict[str, Predictor] = {}

    def add(self, *declared: Source | Predictor) -> Catalog:
        for one in declared:
            if isinstance(one, Source):
                self.sources[one.name] = one
                continue
            if one.timeframe not in ("past", "future", "static"):
                raise ValueError(f"{one.name}: timeframe {one.timeframe}")
            if unknown := [s for s in one.sources if s not in self.sources]:
                raise KeyError(f"{one.name} needs sources that aren't declared: {unknown}")
            self.predictors[one.name] = one
        return self

    def _values(self, spark: SparkSession, chosen: list[Predictor]) -> DataFrame:
        """(t, key, timeframe, predictor, v) of predictors: their sources as columns of one row for each time and key."""
        names = sorted({s for p in chosen for s in p.sources})
        rows = None
        for name in names:
            one = self.sources[name].load(spark).select(F.col("t").cast("long").alias("t"), F.col("key"), F.lit(name).alias("source"), F.col("v").cast("double").alias("v"))
            rows = one if rows is None else rows.union(one)
        wide = rows.groupBy("t", "key").agg(*[F.max(F.when(F.col("source") == n, F.col("v"))).alias(f"v{k}") for k, n in enumerate(names)])
        column = {n: F.col(f"v{k}") for k, n in enumerate(names)}
        made = F.array(*[F.struct(F.lit(p.timeframe).alias("timeframe"), F.lit(p.name).alias("predictor"), p.function(*[column[s] for s in p.sources]).cast("double").alias("v")) for p in chosen])
        return wide.select("t", "key", F.explode(made).alias("x")).select("t", "key", "x.*").where("v IS NOT NULL")

    def plan(self, spark: SparkSession, names: list[str], references: DataFrame, past: int, future: int) -> DataFrame:
        """(t, predictor, step, key, v) for the references (t): the past steps 1 - past .. 0, the future ones 1 .. future, and static
        values once, with a null t, as they are the same for all references."""
        chosen = [self.predictors[n] for n in dict.fromkeys(names)]
        moving, still = [p for p in chosen if p.timeframe != "static"], [p for p in chosen if p.timeframe == "static"]
        parts = []
        if moving:
            steps = [F.struct(F.lit("past").alias("timeframe"), F.lit(k).alias("step")) for k in range(1 - past, 1)] + [F.struct(F.lit("future").alias("timeframe"), F.lit(k).alias("step")) for k in range(1, future + 1)]
            used = {p.timeframe for p in moving}
            wanted = references.select(F.col("t").cast("long").alias("t")).distinct().select("t", F.explode(F.array(*steps)).alias("x")).select("t", "x.*", (F.col("t") + F.col("x.step")).alias("at")).where(F.col("timeframe").isin(*used))
            values = self._values(spark, moving).withColumnRenamed("t", "at")
            parts.append(wanted.join(values, ["at", "timeframe"]).select("t", "predictor", "step", "key", "v"))
        if still:
            parts.append(self._values(spark, still).select(F.lit(None).cast("long").alias("t"), "predictor", F.lit(0).alias("step"), "key", "v"))
        return parts[0] if len(parts) == 1 else parts[0].union(parts[1])
