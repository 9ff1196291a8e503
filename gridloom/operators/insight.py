"""A report of each frame in one row: intensities, coverage, gradients, texture, hotspots, shape of the active area.

A frame is one raster and so one group: its lines come together in a task, as numbers. Minima and maxima of windows are taken
from two blocks, so that they cost the same for every radius; discs are joined from such windows of rows. What needs
labels (systems, density clusters) comes from operators that spread a frame over many tasks, and is joined by frame.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import clusters, grid

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Deviation of the smoothing of the texture, in pixels, and the deviations at which it is cut off.
SIGMA, CUT = 2.0, 4.0
_NUMBERS = ["mean", "max", "min", "std", "light", "moderate", "heavy", "extreme", "gradient_max", "gradient_mean", "direction_std", "texture_mean", "texture_max", "smoothness", "strongest", "compactness", "connectivity", "fragmentation"]
_COUNTS = ["pixels", "active", "light_area", "moderate_area", "heavy_area", "extreme_area", "steep_area", "rough_area", "hotspots"]


def running(rows: np.ndarray, radius: int, take: np.ufunc, outside: float) -> np.ndarray:
    """``take`` (np.minimum or np.maximum) over 2 radius + 1 neighbours along the last axis, by two blocks; what lies outside doesn't count."""
    if radius == 0:
        return rows
    w, n = 2 * radius + 1, rows.shape[-1]
    size = -(-(n + 2 * radius) // w) * w
    padded = np.full((*rows.shape[:-1], size), outside)
    padded[..., radius : radius + n] = rows
    blocks = padded.reshape(*rows.shape[:-1], size // w, w)
    ahead = take.accumulate(blocks, axis=-1).reshape(padded.shape)
    back = take.accumulate(blocks[..., ::-1], axis=-1)[..., ::-1].reshape(padded.shape)
    return take(back[..., :n], ahead[..., w - 1 : w - 1 + n])


def over_square(data: np.ndarray, radius: int, take: np.ufunc, outside: float) -> np.ndarray:
    return running(running(data, radius, take, outside).T, radius, take, outside).T


def over_disc(data: np.ndarray, radius: int, take: np.ufunc, outside: float) -> np.ndarray:
    """The same over a disc: rows by the width that the disc has there."""
    out = np.full(data.shape, outside)
    for dy in range(min(radius, len(data) - 1) + 1):
        row = running(data, int(np.sqrt(radius * radius - dy * dy)), take, outside)
        part = len(data) - dy
        out[:part] = take(out[:part], row[dy:])
        out[dy:] = take(out[dy:], row[:part])
    return out


def smoothed(data: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """A Gaussian mean, rows and columns in turn; the border's values go on outside."""
    reach = int(CUT * sigma + 0.5)
    weight = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight /= weight.sum()
    for _ in range(2):
        wide = np.pad(data, ((0, 0), (reach, reach)), mode="edge")
        data = sum(w * wide[:, k : k + data.shape[1]] for k, w in enumerate(weight)).T
    return data


def report(data: np.ndarray, active_over: float, radius: int, hot_radius: int) -> dict[str, float | int | None]:
    """The figures of a frame of at least 2 x 2 pixels; null where nothing is active."""
    active = data > active_over
    n = int(active.sum())
    out: dict[str, float | int | None] = {"mean": data.mean(), "max": data.max(), "min": data.min(), "std": data.std(), "pixels": data.size, "active": n}
    classes = ("light", "moderate", "heavy", "extreme")
    if n:
        cuts = np.percentile(data[active], [33, 66, 90, 99])
        low = np.concatenate([[active_over], cuts[:3]])
        high = np.concatenate([cuts[:3], [np.inf]])
        out |= dict(zip(classes, cuts.tolist())) | {f"{c}_area": int(((data > a) & (data <= b)).sum()) for c, a, b in zip(classes, low, high)}
    else:
        out |= {c: None for c in classes} | {f"{c}_area": 0 for c in classes}
    gy, gx = np.gradient(data)
    steep = np.sqrt(gx * gx + gy * gy)
    out |= {"gradient_max": steep.max(), "gradient_mean": steep.mean(), "steep_area": int((steep > np.percentile(steep, 95)).sum()), "direction_std": np.arctan2(gy, gx).std()}
    texture = np.round(np.abs(data - smoothed(data)), 9)
    out |= {"texture_mean": texture.mean(), "texture_max": texture.max(), "rough_area": int((texture > np.percentile(texture, 90)).sum()), "smoothness": 1 - texture.std() / (data.std() + 1e-10)}
    hot = (over_square(data, hot_radius, np.maximum, -np.inf) == data) & (data > np.percentile(data[active], 80)) if n else np.zeros(data.shape, bool)
    out |= {"hotspots": int(hot.sum()), "strongest": data[hot].max() if hot.any() else None}
    if n:
        mask = active.astype(float)
        opened = over_disc(over_disc(mask, radius, np.minimum, 1.0), radius, np.maximum, 0.0).sum()
        closed = over_disc(over_disc(mask, radius, np.maximum, 0.0), radius, np.minimum, 1.0).sum()
        out |= {"compactness": opened / n, "connectivity": closed / n, "fragmentation": 1 - opened / (closed + 1e-10)}
    else:
        out |= {"compactness": 0.0, "connectivity": 0.0, "fragmentation": 0.0}
    return out


def frame_figures(lines: DataFrame, active_over: float, radius: int = 3, hot_radius: int = 2, key: str = "frame") -> DataFrame:
    """(key, _NUMBERS, _COUNTS) for frames as lines (key, line, values); NaN and null count as 0, lines must be equally long."""

    def run(key_of: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("line")
        values = table.column("values").combine_chunks()
        data = np.nan_to_num(values.flatten().to_numpy(zero_copy_only=False).astype(float)).reshape(len(values), -1)
        found = report(data, active_over, radius, hot_radius)
        columns = [pa.array([None if found[c] is None else round(float(found[c]), 6)], pa.float64()) for c in _NUMBERS] + [pa.array([found[c]], pa.int64()) for c in _COUNTS]
        return pa.Table.from_arrays([pa.array([key_of[0].as_py()], table.schema.field(key).type), *columns], [key, *_NUMBERS, *_COUNTS])

    schema = f"`{key}` {lines.schema[key].dataType.simpleString()}, " + ", ".join([f"`{c}` double" for c in _NUMBERS] + [f"`{c}` long" for c in _COUNTS])
    return lines.select(key, "line", "values").groupBy(key).applyInArrow(run, schema)


def frame_insight(pixels: DataFrame, lines: DataFrame, active_over: float, strong_over: float | None = None, radius: int = 3, eps: float = 5, min_points: int = 10) -> DataFrame:
    """A row for each frame: the figures, the systems (connected regions) of the strong pixels, and their density clusters.

    ``pixels``: (frame, i, j, v), sparse; ``lines``: the same frames, dense. Cluster columns are null in frames with under min_points strong pixels.
    """
    over = active_over if strong_over is None else strong_over
    strong = pixels.where((F.col("v") > over) & ~F.isnan("v"))
    areas = grid.region_table(grid.connected_regions(strong))
    systems = areas.groupBy("frame").agg(F.count(F.lit(1)).alias("systems"), F.max("area").alias("largest_system"), F.round(F.avg("area"), 6).alias("mean_system"))
    labels = clusters.density_clusters(pixels, over, eps, min_points)
    dense = labels.groupBy("frame").agg(F.countDistinct("label").alias("clusters"), F.count_if(F.col("label").isNull()).alias("noise"), F.count(F.lit(1)).alias("strong")).where(F.col("strong") >= min_points)
    out = frame_figures(lines, active_over, radius).join(systems, "frame", "left").join(dense.drop("strong"), "frame", "left")
    share = F.round(100 * F.col("active") / F.col("pixels"), 6)
    return out.withColumns({"coverage": share, "systems": F.coalesce("systems", F.lit(0).cast("long")), "largest_system": F.coalesce("largest_system", F.lit(0).cast("long")), "mean_system": F.coalesce("mean_system", F.lit(0.0))})
