"""Density clusters of pixels, with labels.

A hit is a core if min_samples hits lie within eps of it, itself included. Cores within eps of each other are one
cluster; another hit within eps of a core is at the border and goes to the cluster of its nearest core; all else is noise.

The grid is cut into cells so small that all pixels of a cell are within eps of each other: cores of a cell always belong
together, so that the graph whose components are the clusters has cells as nodes, not pixels, and no pairs of pixels are
formed. A cell is one row with its hits as the bits of a long; neighbours are counted by bit masks of the disc.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.graph import components
from gridloom.operators.shared import stored

#: Columns that a frame may have at most: a pixel's number is i * WIDTH + j.
WIDTH = 1 << 20


class Cells:
    """Geometry for one eps: side of a cell, offsets of the cells in reach, and for each offset and pixel the mask of near pixels."""

    def __init__(self, eps: float):
        self.eps2 = eps * eps
        self.side = side = min(7, math.floor(eps / math.sqrt(2)) + 1)
        reach = (side - 1 + math.floor(eps)) // side
        self.offsets = [(a, b) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)]
        self.pixels = [(p, q) for p in range(side) for q in range(side)]
        near = lambda o, p: sum(1 << k for k, q in enumerate(self.pixels) if (o[0] * side + q[0] - p[0]) ** 2 + (o[1] * side + q[1] - p[1]) ** 2 <= self.eps2)
        self.masks = [[near(o, p) for p in self.pixels] for o in self.offsets]

    def mask_table(self, which: list[int]) -> Column:
        """For each chosen offset (a, b) the array of its masks."""
        return F.array(*[F.struct(F.lit(self.offsets[k][0]).alias("a"), F.lit(self.offsets[k][1]).alias("b"), F.array(*[F.lit(m).cast("long") for m in self.masks[k]]).alias("near")) for k in which])


def _bit(mask: Column, k: Column | int) -> Column:
    return F.call_function("shiftright", mask, k if isinstance(k, Column) else F.lit(k)).bitwiseAND(F.lit(1)) == 1


def core_cells(hits: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """(frame, ci, cj, hits, core): the cells that have hits, with the masks of all and of the cores; hits: (frame, i, j)."""
    g = Cells(eps)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("i") % g.side * g.side + F.col("j") % g.side).cast("int"))
    cells = hits.groupBy("frame", F.floor(F.col("i") / g.side).alias("ci"), F.floor(F.col("j") / g.side).alias("cj")).agg(F.bit_or(bit).alias("mask"))
    # A cell tells each cell in reach how many of its hits each pixel there has within eps.
    every = g.mask_table(list(range(len(g.offsets))))
    sent = cells.select("*", F.explode(every).alias("o")).select("frame", (F.col("ci") - F.col("o.a")).alias("ci"), (F.col("cj") - F.col("o.b")).alias("cj"), "mask", ((F.col("o.a") == 0) & (F.col("o.b") == 0)).alias("own"), F.col("o.near").alias("near"))
    count = lambda k: F.sum(F.bit_count(F.col("mask").bitwiseAND(F.get("near", F.lit(k))))).alias(f"n{k}")
    sums = sent.groupBy("frame", "ci", "cj").agg(F.max(F.when(F.col("own"), F.col("mask"))).alias("hits"), *map(count, range(len(g.pixels)))).where("hits IS NOT NULL")
    core = F.lit(0).cast("long")
    for k in range(len(g.pixels)):
        core = core + F.when((F.col(f"n{k}") >= min_samples) & _bit(F.col("hits"), k), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))
    return sums.select("frame", "ci", "cj", "hits", core.alias("core"))


def _spots(g: Cells, mask: Column) -> Column:
    """The pixels of a mask, as an array of their numbers in the cell."""
    return F.filter(F.sequence(F.lit(0), F.lit(len(g.pixels) - 1)), lambda k: _bit(mask, k))


def density_clusters(pixels: DataFrame, threshold: float, eps: float, min_samples: int) -> DataFrame:
    """(frame, i, j, label, core) of the pixels above the threshold: label is the number (i * WIDTH + j) of the cluster's least
    core, null for noise; of equally near cores the one with the least number decides."""
    g = Cells(eps)
    n, side = len(g.pixels), g.side
    hits = pixels.where((F.col("v") > threshold) & ~F.isnan("v")).select("frame", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"))
    cells = stored(core_cells(hits, eps, min_samples))
    cores = cells.where("core <> 0").select("frame", "ci", "cj", "core", (F.col("ci") * WIDTH + F.col("cj")).alias("node"))
    # Cells with cores are linked if any two of their cores are near.
    half = g.mask_table([k for k, o in enumerate(g.offsets) if o > (0, 0)])
    at = cores.select("frame", F.col("node").alias("a"), F.col("core").alias("mine"), "ci", "cj", F.explode(half).alias("o")).select("frame", "a", "mine", (F.col("ci") + F.col("o.a")).alias("ci"), (F.col("cj") + F.col("o.b")).alias("cj"), F.col("o.near").alias("near"))
    touch = F.exists(F.transform("near", lambda m, k: _bit(F.col("mine"), k) & (F.col("core").bitwiseAND(m) != 0)), lambda x: x)
    links = at.join(cores, ["frame", "ci", "cj"]).where(touch).select("frame", "a", F.col("node").alias("b"))
    least = F.bit_count(F.col("core").bitwiseAND(-F.col("core")) - 1)  # the place of the lowest bit
    number = (F.col("ci") * side + F.floor(least / side)) * WIDTH + F.col("cj") * side + least % side
    named = cores.withColumn("number", number).join(components(links, ["frame"]), ["frame", "node"], "left").withColumn("component", F.coalesce("component", "node"))
    labels = named.groupBy("frame", "component").agg(F.min("number").alias("label"))
    labelled = stored(named.join(labels, ["frame", "component"]).select("frame", "ci", "cj", "core", "label"))

    place = lambda k: ((F.col("ci") * side + F.floor(F.col(k) / side)).alias("i"), (F.col("cj") * side + F.col(k) % side).alias("j"))
    inner = labelled.select("frame", "ci", "cj", "label", F.explode(_spots(g, F.col("core"))).alias("k")).select("frame", *place("k"), "label", F.lit(True).alias("core"))
    # Other hits ask the cells in reach for their nearest core.
    outer = cells.select("frame", "ci", "cj", F.explode(_spots(g, F.col("hits").bitwiseAND(F.bitwise_not("core")))).alias("k"))
    every = g.mask_table(list(range(len(g.offsets))))
    asked = outer.select("frame", *place("k"), "k", "ci", "cj", F.explode(every).alias("o")).select("frame", "i", "j", (F.col("ci") + F.col("o.a")).alias("ci"), (F.col("cj") + F.col("o.b")).alias("cj"), F.get("o.near", "k").alias("near"))

    def candidate(k: Column) -> Column:
        y, x = F.col("ci") * side + F.floor(k / side), F.col("cj") * side + k % side
        return F.struct(((y - F.col("i")) * (y - F.col("i")) + (x - F.col("j")) * (x - F.col("j"))).alias("d2"), (y * WIDTH + x).alias("number"))

    met = asked.join(labelled, ["frame", "ci", "cj"]).where(F.col("core").bitwiseAND(F.col("near")) != 0)
    nearest = met.select("frame", "i", "j", "label", F.array_min(F.transform(_spots(g, F.col("core").bitwiseAND(F.col("near"))), candidate)).alias("c"))
    border = nearest.groupBy("frame", "i", "j").agg(F.min_by("label", "c").alias("label"))
    rest = outer.select("frame", *place("k")).join(border, ["frame", "i", "j"], "left").select("frame", "i", "j", "label", F.lit(False))
    return inner.union(rest)
