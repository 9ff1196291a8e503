"""Tables for reports: samples by date, paired ranges, exclusion tables, ensemble weights, mapped values, registries."""

import importlib
from collections.abc import Callable
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def samples_per_date(samples: DataFrame, date: str) -> DataFrame:
    """(date, n, mean): samples of each date, beside the mean over dates."""
    counts = samples.groupBy(date).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("mean", F.round(counts.agg(F.avg("n")).scalar(), 6))


def paired_ranges(rows: DataFrame, variable: str, value: str, valid: Column, patch: str) -> DataFrame:
    """Least and greatest valid value, valid values and patches of each variable, to be compared side by side."""
    kept = F.when(valid, F.col(value))
    return rows.groupBy(variable).agg(F.min(kept).alias("low"), F.max(kept).alias("high"), F.count(kept).alias("n_valid"), F.countDistinct(F.when(valid, F.col(patch))).alias("n_patches"))


def exclusion_table(scores: DataFrame, sources: list[str], columns: list[str]) -> DataFrame:
    """Scores of coalitions (members array, score) as a table: a row for the members among the other sources, a column for
    those among ``columns``; both as bit sets, the first source as bit 0."""
    rows = [x for x in sources if x not in columns]
    bits = lambda names: sum((F.when(F.array_contains("members", x), 1 << k).otherwise(0) for k, x in enumerate(names)), F.lit(0))
    wide = scores.select(bits(rows).alias("row"), bits(columns).alias("col"), "score").groupBy("row").pivot("col", list(range(1 << len(columns)))).agg(F.first("score"))
    return wide.select(F.col("row").cast("long").alias("row"), *[F.col(str(k)).alias(f"c{k}") for k in range(1 << len(columns))])


def ensemble_weights(predictions: DataFrame, models: list[str], target: str, ridge: float = 0.0) -> DataFrame:
    """(model, weight): the least-squares weights. All rows make the normal equations in one aggregate; as many unknowns as models are solved."""
    p = len(models)
    sums = predictions.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"g{i}_{j}") for i, a in enumerate(models) for j, b in enumerate(models) if i <= j], *[F.sum(F.col(a) * F.col(target)).alias(f"y{i}") for i, a in enumerate(models)], F.count(F.lit(1)).alias("n")).first()
    gram = np.array([[sums[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(p)] for i in range(p)])
    n = max(sums.n, 1)
    weights = np.linalg.lstsq(gram / n + ridge * np.eye(p), np.array([sums[f"y{i}"] or 0.0 for i in range(p)]) / n, rcond=None)[0]
    return predictions.sparkSession.createDataFrame([(m, float(w)) for m, w in zip(models, weights)], "model string, weight double")


def model_correlation(predictions: DataFrame, models: list[str]) -> DataFrame:
    """(a, b, r): correlation of every pair of models, in one aggregate."""
    wide = predictions.agg(*[F.corr(a, b).alias(f"{i}_{j}") for i, a in enumerate(models) for j, b in enumerate(models)])
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{i}_{j}").alias("r")) for i, a in enumerate(models) for j, b in enumerate(models)]
    return wide.select(F.inline(F.array(*cells)))


def map_by_quantiles(rows: DataFrame, value: str, table: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with ``mapped``: the value moved along matched quantiles (by, q, source_q, target_q), linear in between,
    clipped to the targets; as it is where all source quantiles are equal. The table has a row a quantile and group."""
    knots = table.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("q", "source_q", "target_q"))).alias("k"))
    joined = rows.join(knots, by)
    x, k = F.col(value), F.col("k")
    at = F.greatest(F.lit(1), F.least(F.size(k) - 1, F.size(F.filter(k, lambda s: s["source_q"] <= x))))
    a, b = F.get(k, at - 1), F.get(k, at)
    step = F.when(b["source_q"] > a["source_q"], (x - a["source_q"]) / (b["source_q"] - a["source_q"])).otherwise(0.0)
    line = a["target_q"] + F.greatest(F.lit(0.0), F.least(F.lit(1.0), step)) * (b["target_q"] - a["target_q"])
    first, last = F.get(k, F.lit(0)), F.element_at(k, -1)
    mapped = F.when(first["source_q"] == last["source_q"], x).when(x <= first["source_q"], first["target_q"]).when(x >= last["source_q"], last["target_q"]).otherwise(line)
    return joined.withColumn("mapped", mapped).drop("k")


class Registry:
    """Named functions, to which users add their own: readers (session, path to rows), transforms and hooks (column to column)."""

    def __init__(self, kind: str):
        self.kind, self.known = kind, {}

    def add(self, name: str, function: Callable, **settings) -> None:
        self.known[name] = (function, settings)

    def declare(self, name: str, place: str, **settings) -> None:
        """A function by its place, ``package.module:function``; the module is imported when it is first asked for."""
        self.known[name] = (place, settings)

    def get(self, name: str) -> Callable:
        if name not in self.known:
            raise KeyError(f"no {self.kind} named {name}; there are {sorted(self.known)}")
        found, settings = self.known[name]
        if isinstance(found, str):
            module, _, function = found.partition(":")
            found = getattr(importlib.import_module(module), function)
            self.known[name] = (found, settings)
        return partial(found, **settings) if settings else found

    def apply(self, rows: DataFrame, variable: str, value: str) -> DataFrame:
        """``rows`` with ``value`` changed by the function of the row's variable; unknown variables keep theirs."""
        out = F.col(value)
        for name in self.known:
            out = F.when(F.col(variable) == name, self.get(name)(F.col(value))).otherwise(out)
        return rows.withColumn(value, out)


#: Readers by product, transforms and per-variable hooks.
READERS, HOOKS = Registry("reader"), Registry("hook")
for _name, _place in {"containers": "containers:read_containers", "points": "containers:read_points", "rasters": "tables:read_rasters", "statistics": "tables:read_statistics", "wide": "tables:read_wide", "strokes": "tables:read_strokes_archive", "stroke_feed": "tables:read_strokes_feed", "patch_index": "tables:read_patch_index", "sequences": "tables:read_sequences", "bundle": "bundles:read_patches", "members": "archives:members"}.items():
    READERS.declare(_name, f"gridloom.sources.{_place}")


def sample_inputs(frames: DataFrame, references: DataFrame, roles: dict[str, str], past: int, future: int) -> DataFrame:
    """(t, variable, step, v): what a sample at ``t`` reads of each variable by its role: ``past`` steps up to t, ``future`` steps
    after it, or ``static`` ones without a time, the same for all. ``frames``: (t, variable, v), t null for static ones."""
    steps = {"past": list(range(1 - past, 1)), "future": list(range(1, future + 1))}
    parts = []
    for role, offsets in steps.items():
        names = [v for v, r in roles.items() if r == role]
        if names:
            wanted = references.select("t", F.explode(F.array(*map(F.lit, offsets))).alias("step")).withColumn("at", F.col("t") + F.col("step"))
            mine = frames.where(F.col("variable").isin(names)).withColumnRenamed("t", "at")
            parts.append(wanted.join(mine, "at").select("t", "variable", "step", "v"))
    names = [v for v, r in roles.items() if r == "static"]
    if names:  # one value a static variable, so that the pivoted row is as narrow as the list of names
        still = frames.where(F.col("variable").isin(names) & F.col("t").isNull()).groupBy("variable").agg(F.max("v").alias("v"))
        values = still.agg(F.map_from_entries(F.collect_list(F.struct("variable", "v")))).scalar()
        parts.append(references.select("t", F.explode(values).alias("variable", "v")).select("t", "variable", F.lit(0).alias("step"), "v"))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out
