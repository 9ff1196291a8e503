"""Grids in space: affine projection, axes, warping, parallax relocation, upscaling, spaced sampling."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.geodesy import line_of_sight, sighted, viewing_zenith
from gridloom.operators.grid import bilinear_sample


def to_pixel(x: Column, y: Column, x0: float, y0: float, size: float) -> Column:
    """(i, j) of projected coordinates: rows count down from y0, columns up from x0."""
    return F.struct(((y0 - y) / size).alias("i"), ((x - x0) / size).alias("j"))


def from_pixel(i: Column, j: Column, x0: float, y0: float, size: float) -> Column:
    return F.struct((x0 + j * size).alias("x"), (y0 - i * size).alias("y"))


def axis(k: Column, first: float, last: float, n: int) -> Column:
    """Coordinate ``k`` of a regular axis of n points from first to last."""
    return first + k * (last - first) / (n - 1)


def coordinate_pairs(cells: DataFrame, rows: DataFrame, columns: DataFrame, height: int, width: int) -> DataFrame:
    """Cells (.., i, j) with (lat, lon) of the axes rows (i, lat) and columns (j, lon); indexes are clipped to the grid."""
    clip = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.col(c))).cast("long")
    clipped = cells.withColumns({"ci": clip("i", height), "cj": clip("j", width)})
    return clipped.join(rows.withColumnRenamed("i", "ci"), "ci").join(columns.withColumnRenamed("j", "cj"), "cj").drop("ci", "cj")


def warp(pixels: DataFrame, motion: DataFrame, height: int, width: int) -> DataFrame:
    """(frame, i, j, v): pixels moved by ``motion`` (frame, i, j, u, w): the value at (i - u, j - w), clipped to the grid."""
    at = lambda c, m, n: F.greatest(F.lit(0.0), F.least(F.lit(n - 1 - 1e-9), F.col(c) - F.col(m)))
    points = motion.select(F.struct("frame", "i", "j").alias("id"), "frame", at("i", "u", height).alias("y"), at("j", "w", width).alias("x"))
    return bilinear_sample(pixels, points).select("id.frame", "id.i", "id.j", "v")


def relocate(moved: DataFrame, radius: int, sigma: float) -> DataFrame:
    """(frame, i, j, si, sj): where each target pixel's value comes from, as the Gaussian-weighted mean of the source
    places of the points that land near it. ``moved``: (frame, i, j, y, x), source pixels and their corrected places; one without a place lands nowhere."""
    cells = [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1)]
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in cells])
    near = moved.withColumns({"y0": F.floor(F.col("y") + 0.5), "x0": F.floor(F.col("x") + 0.5)}).withColumn("o", F.explode(around))
    near = near.select("frame", "i", "j", "y", "x", (F.col("y0") + F.col("o.a")).alias("ti"), (F.col("x0") + F.col("o.b")).alias("tj"))
    weight = F.exp(-(F.pow(F.col("ti") - F.col("y"), 2) + F.pow(F.col("tj") - F.col("x"), 2)) / (2 * sigma * sigma))
    sums = near.withColumn("w", weight).groupBy("frame", F.col("ti").alias("i"), F.col("tj").alias("j")).agg(F.sum("w").alias("w"), F.sum(F.col("w") * near.i).alias("wi"), F.sum(F.col("w") * near.j).alias("wj")).where("w IS NOT NULL")
    return sums.select("frame", "i", "j", (F.col("wi") / F.col("w")).alias("si"), (F.col("wj") / F.col("w")).alias("sj"))


def visible_patches(patches: DataFrame, corners: list[tuple[Column, Column]], satellite: Column, limit: float = 75.0) -> DataFrame:
    """Patches whose corners (lon, lat) are all seen at a zenith angle below ``limit`` degrees."""
    seen = [viewing_zenith(lon, lat, satellite) < limit for lon, lat in corners]
    return patches.where(reduce(lambda a, b: a & b, seen))


def corrected_points(points: DataFrame, heights: DataFrame, satellite: Column, x0: float, y0: float, size: float) -> DataFrame:
    """(id, lon, lat) of points (id, frame, lon, lat) shifted by the cloud height there: bilinear from the four pixels (frame, i, j, v in
    kilometres) of a grid of ``size`` degrees around; null where one of them is missing or the satellite has set."""
    at = points.withColumn("p", to_pixel(F.col("lon"), F.col("lat"), x0, y0, size)).select("id", "frame", F.col("p.i").alias("y"), F.col("p.j").alias("x"))
    sampled = bilinear_sample(heights, at).withColumnRenamed("v", "height")
    moved = points.join(sampled, "id", "left").withColumn("s", F.when(F.col("height").isNotNull(), line_of_sight(F.col("lon"), F.col("lat"), F.col("height"), satellite)))
    return moved.select("id", F.col("s.lon").alias("lon"), F.col("s.lat").alias("lat"))


def corrected_pixels(heights: DataFrame, satellite: Column, x0: float, y0: float, size: float) -> DataFrame:
    """(frame, i, j, y, x): where the cloud top seen in each pixel (frame, i, j, v in kilometres) stands in the grid, for ``relocate``;
    null where it is not seen."""
    at = from_pixel(F.col("i"), F.col("j"), x0, y0, size)
    back = to_pixel(F.col("top_lon"), F.col("top_lat"), x0, y0, size)
    return sighted(heights.select("frame", "i", "j", "v"), at["x"], at["y"], F.col("v"), satellite).select("frame", "i", "j", back["i"].alias("y"), back["j"].alias("x"))


def upscale(patches: DataFrame, keys: list[str], size: int, factor: int = 4) -> DataFrame:
    """(keys, i, j, v) at ``factor`` times the resolution: source k / factor, the last row and column held."""
    edge = lambda c, o: F.least(F.floor(F.col(c) / factor) + o, F.lit(size - 1))
    # Each source pixel takes part in the targets of its own cell and of those before it.
    spread = F.sequence(F.greatest(F.lit(0).cast("long"), factor * (F.col("k") - 1) + 1), factor * F.col("k") + factor - 1)
    part = patches.withColumn("k", F.col("i").cast("long")).withColumn("ti", F.explode(spread)).withColumn("k", F.col("j").cast("long")).withColumn("tj", F.explode(spread))
    share = lambda t, c: F.when(edge(t, 0) == F.col(c), 1 - (F.col(t) / factor - F.floor(F.col(t) / factor))).otherwise(0.0) + F.when(edge(t, 1) == F.col(c), F.col(t) / factor - F.floor(F.col(t) / factor)).otherwise(0.0)
    return part.groupBy(*keys, F.col("ti").alias("i"), F.col("tj").alias("j")).agg(F.sum(share("ti", "i") * share("tj", "j") * F.col("v")).alias("v"))
