"""Operators over pixels (frame, i, j, v): patch ids, pooling, masks, regions, kernels, gradients."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.graph import components
from gridloom.operators.shared import stored


def patch_id(i: Column, j: Column, size: int, columns: int) -> Column:
    """1-based row-major patch of a pixel."""
    return F.floor(i / size) * columns + F.floor(j / size) + 1


def patch_bounds(patch: Column, size: int, columns: int) -> Column:
    """Struct of first and last-plus-one row and column of a 1-based patch id."""
    i, j = F.floor((patch - 1) / columns) * size, F.pmod(patch - 1, F.lit(columns)) * size
    return F.struct(i.alias("i0"), (i + size).alias("i1"), j.alias("j0"), (j + size).alias("j1"))


def offsets(radius: int, disc: bool = True) -> Column:
    """Array of (di, dj) within a disc, or a square, of the radius, the centre included."""
    cells = [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if not disc or a * a + b * b <= radius * radius]
    return F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a, b in cells])


def scatter(hits: DataFrame, around: Column) -> DataFrame:
    """Every hit sent to its neighbours: (frame, i, j) of the neighbour and (si, sj) of the hit."""
    return hits.select("frame", F.col("i").alias("si"), F.col("j").alias("sj"), F.explode(around).alias("o")).select("frame", (F.col("si") + F.col("o.di")).alias("i"), (F.col("sj") + F.col("o.dj")).alias("j"), "si", "sj")


def area_threshold(pixels: DataFrame, threshold: float, radius: int) -> DataFrame:
    """Pixels that have a neighbour above the threshold, and how many."""
    near = scatter(pixels.where(F.col("v") > threshold), offsets(radius)).groupBy("frame", "i", "j").agg(F.count(F.lit(1)).alias("n"))
    return pixels.select("frame", "i", "j").join(near, ["frame", "i", "j"])


def density_mask(pixels: DataFrame, threshold: float, eps: int, min_samples: int) -> DataFrame:
    """Hits within eps of a core; a core has min_samples hits within eps, itself included. No labels are needed."""
    hits = pixels.where((F.col("v") > threshold) & ~F.isnan("v")).select("frame", "i", "j")
    own = (F.col("i") == F.col("si")) & (F.col("j") == F.col("sj"))
    # A hit also reaches its own pixel, so that groupings tell hits from their neighbours: joins would deal all out anew.
    counted = scatter(hits, offsets(eps)).groupBy("frame", "i", "j").agg(F.count(F.lit(1)).alias("n"), F.count_if(own).alias("copies")).where("copies > 0")
    around = F.when(F.col("n") >= min_samples, offsets(eps)).otherwise(offsets(0))
    sent = counted.select("frame", F.col("i").alias("si"), F.col("j").alias("sj"), "copies", (F.col("n") >= min_samples).alias("core"), F.explode(around).alias("o"))
    sent = sent.select("frame", (F.col("si") + F.col("o.di")).alias("i"), (F.col("sj") + F.col("o.dj")).alias("j"), "si", "sj", "copies", "core")
    reached = sent.groupBy("frame", "i", "j").agg(F.max("core").alias("near"), F.max(F.when(own, F.col("copies"))).alias("copies")).where("near AND copies > 0")
    return reached.select("frame", "i", "j", F.explode(F.array_repeat(F.lit(True), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def active_patches(mask: DataFrame, size: int, columns: int) -> DataFrame:
    return mask.select("frame", patch_id(F.col("i"), F.col("j"), size, columns).alias("patch_id")).distinct()


def connected_regions(hits: DataFrame, connectivity: int = 8, width: int = 1 << 20, max_rounds: int = 200) -> DataFrame:
    """(frame, i, j, label): the label of a region is its least pixel number i * width + j.

    Stretches of neighbouring pixels of a row are put together first, so that the graph has a node for each stretch.
    """
    number = lambda i, j: (F.col(i) * width + F.col(j)).cast("long")
    row = Window.partitionBy("frame", "i").orderBy("j")
    pixels = hits.select("frame", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).distinct()
    marked = pixels.withColumn("first", F.when(F.coalesce(F.col("j") - F.lag("j").over(row), F.lit(2)) > 1, F.col("j")))
    placed = stored(marked.withColumn("first", F.max("first").over(row.rowsBetween(Window.unboundedPreceding, 0))))
    # A stretch touches those of the next row that have a pixel below it, or beside that.
    side = 1 if connectivity == 8 else 0
    below = placed.select("frame", number("i", "first").alias("a"), (F.col("i") + 1).alias("i"), F.explode(F.array(*[F.col("j") + d for d in range(-side, side + 1)])).alias("j"))
    links = below.join(placed, ["frame", "i", "j"]).select("frame", "a", number("i", "first").alias("b"))
    found = components(links, ["frame"], max_rounds).withColumnRenamed("node", "stretch")
    named = placed.withColumn("stretch", number("i", "first")).join(found, ["frame", "stretch"], "left")
    return named.select("frame", "i", "j", F.coalesce("component", "stretch").alias("label"))


def region_table(labelled: DataFrame, min_area: int = 1, top: int | None = None) -> DataFrame:
    """Area and integer centroid of each region of min_area pixels; the ``top`` largest of each frame."""
    out = labelled.groupBy("frame", "label").agg(F.count(F.lit(1)).alias("area"), F.floor(F.avg("i")).alias("ci"), F.floor(F.avg("j")).alias("cj")).where(F.col("area") >= min_area)
    if top is None:
        return out
    rank = F.row_number().over(Window.partitionBy("frame").orderBy(F.desc("area"), "label"))
    return out.withColumn("rank", rank).where(F.col("rank") <= top)


def average_pool(pixels: DataFrame, k: int, height: int, width: int) -> DataFrame:
    """Mean of k x k blocks of what pixels there are; a remainder at the ends is cut off."""
    inside = pixels.where((F.col("i") < height // k * k) & (F.col("j") < width // k * k))
    return inside.groupBy("frame", F.floor(F.col("i") / k).alias("bi"), F.floor(F.col("j") / k).alias("bj")).agg(F.round(F.avg("v"), 6).alias("v"))


def average_pool_missing(pixels: DataFrame, k: int, missing: float) -> DataFrame:
    """Mean of the valid pixels of a block, or the missing code if under half of k * k are valid."""
    ok = F.col("v") != missing
    cells = pixels.groupBy("frame", F.floor(F.col("i") / k).alias("bi"), F.floor(F.col("j") / k).alias("bj")).agg(F.avg(F.when(ok, F.col("v"))).alias("m"), F.count_if(ok).alias("n"))
    return cells.select("frame", "bi", "bj", F.round(F.when((F.col("n") >= k * k // 2) & (F.col("n") > 0), F.col("m")).otherwise(missing), 6).alias("v"))


def mode_pool(pixels: DataFrame, k: int) -> DataFrame:
    """Most frequent value of a block; of equally frequent ones the smallest. NaN counts as 0."""
    block = pixels.select("frame", F.floor(F.col("i") / k).alias("bi"), F.floor(F.col("j") / k).alias("bj"), F.nanvl("v", F.lit(0.0)).alias("v"))
    n = block.groupBy("frame", "bi", "bj", "v").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("frame", "bi", "bj").agg(F.min(F.struct(-F.col("n"), F.col("v").alias("v"))).alias("m")).select("frame", "bi", "bj", F.col("m.v").alias("v"))


def gradient(dense: DataFrame, keys: list[str]) -> DataFrame:
    """Central differences along i and j, one-sided at the borders, for dense patches."""

    def along(axis: str, other: str) -> Column:
        w = Window.partitionBy(*keys, other).orderBy(axis)
        before, after = F.lag("v").over(w), F.lead("v").over(w)
        return F.when(before.isNull(), after - F.col("v")).when(after.isNull(), F.col("v") - before).otherwise((after - before) / 2)

    return dense.select(*keys, "i", "j", along("i", "j").alias("gi"), along("j", "i").alias("gj"))


def moving_mean(dense: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Mean over a (2 radius + 1) square where it lies inside, by a row pass and a column pass; 0 at the border."""
    width = 2 * radius + 1
    row = Window.partitionBy(*keys, "i").orderBy("j").rowsBetween(-radius, radius)
    col = Window.partitionBy(*keys, "j").orderBy("i").rowsBetween(-radius, radius)
    rows = dense.select(*keys, "i", "j", F.sum("v").over(row).alias("s"), F.count("v").over(row).alias("n"))
    both = rows.select(*keys, "i", "j", F.sum("s").over(col).alias("s"), F.sum("n").over(col).alias("n"))
    return both.select(*keys, "i", "j", F.round(F.when(F.col("n") == width * width, F.col("s") / (width * width)).otherwise(0.0), 6).alias("mean"))


def local_maxima(dense: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Pixels that are the largest of their square (the part of it that exists)."""
    row = Window.partitionBy(*keys, "i").orderBy("j").rowsBetween(-radius, radius)
    col = Window.partitionBy(*keys, "j").orderBy("i").rowsBetween(-radius, radius)
    rows = dense.select(*keys, "i", "j", "v", F.max("v").over(row).alias("m"))
    return rows.withColumn("m", F.max("m").over(col)).where("v = m").drop("m")


def fill_holes(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """Missing pixels with a valid 3 x 3 neighbour, and the mean of those that are valid."""
    near = pixels.select("frame", "v", F.col("i").alias("si"), F.col("j").alias("sj"), F.explode(offsets(1, disc=False)).alias("o"))
    near = near.select("frame", (F.col("si") + F.col("o.di")).alias("i"), (F.col("sj") + F.col("o.dj")).alias("j"), "v", "si", "sj").where((F.col("i") >= 0) & (F.col("j") >= 0) & (F.col("i") < height) & (F.col("j") < width))
    # A pixel reaches itself, which tells those that are there: a join with the pixels would deal all out anew.
    there = (F.col("i") == F.col("si")) & (F.col("j") == F.col("sj"))
    means = near.groupBy("frame", "i", "j").agg(F.round(F.avg("v"), 6).alias("v"), F.max(there).alias("there"))
    return means.where(~F.col("there")).drop("there")


def kernel_sum(hits: DataFrame, radius: int, weight) -> DataFrame:
    """Sum over hits of weight(di, dj), a Python function, at every pixel in reach of the sparse hits."""
    cells = F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj"), F.lit(float(w)).alias("w")) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if (w := weight(a, b))])
    spread = hits.select("frame", "i", "j", "v", F.explode(cells).alias("o"))
    return spread.groupBy("frame", (F.col("i") + F.col("o.di")).alias("i"), (F.col("j") + F.col("o.dj")).alias("j")).agg(F.round(F.sum(F.col("v") * F.col("o.w")), 6).alias("s"))


def zero_patches(pixels: DataFrame, nonzero: Column, size: int, columns: int) -> DataFrame:
    """Per patch the number of pixels that satisfy ``nonzero``, and whether it is a zero patch."""
    cells = pixels.groupBy("frame", patch_id(F.col("i"), F.col("j"), size, columns).alias("patch_id")).agg(F.count_if(nonzero).alias("n"))
    return cells.withColumn("is_zero", F.col("n") == 0)


def nonzero_fraction(rows: DataFrame, product: str, v: str) -> DataFrame:
    """Non-zero share by product and, as product null, over all; ratio is 1 : floor(1 / share)."""
    both = rows.select(F.explode(F.array(F.col(product), F.lit(None))).alias("product"), F.col(v).alias("v"))
    cells = both.groupBy("product").agg(F.count_if(F.col("v") != 0).alias("ones"), F.count(F.lit(1)).alias("total"))
    share = F.coalesce(F.try_divide("ones", "total"), F.lit(0.0))
    return cells.select("product", "ones", "total", F.round(share, 6).alias("fraction"), F.coalesce(F.floor(F.try_divide("total", "ones")), F.lit(0)).alias("ratio"))


def bilinear_sample(pixels: DataFrame, points: DataFrame) -> DataFrame:
    """Value of points (id, frame, y, x) from the four pixels around; null where one is absent."""
    at = points.select("id", "frame", "y", "x", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])).alias("o"))
    fy, fx = F.col("y") - F.floor("y"), F.col("x") - F.floor("x")
    w = F.when(F.col("o.a") == 1, fy).otherwise(1 - fy) * F.when(F.col("o.b") == 1, fx).otherwise(1 - fx)
    corner = at.select("id", "frame", (F.floor("y") + F.col("o.a")).alias("i"), (F.floor("x") + F.col("o.b")).alias("j"), w.alias("w"))
    got = corner.join(pixels, ["frame", "i", "j"], "left").groupBy("id").agg(F.sum(F.col("w") * F.col("v")).alias("s"), F.count("v").alias("n"))
    return got.select("id", F.round(F.when(F.col("n") == 4, F.col("s")), 6).alias("v"))


def nearest_neighbour(targets: DataFrame, sources: DataFrame, radius: float) -> DataFrame:
    """Nearest source (sid, x, y) of each target (tid, x, y) within the radius, by cells; least sid on ties.

    Every target looks into the 9 cells around its own: an equi-join, not a loop over all pairs. Only different places are paired, and
    cells are small at first: a source nearer than a cell is wide settles its target, and the rest looks into wider cells, up to the
    radius. So a dense area costs no more pairs than a sparse one. No side is broadcast, as small rows of many places would be.
    """
    d2 = F.pow(F.col("x") - F.col("sx"), 2) + F.pow(F.col("y") - F.col("sy"), 2)
    places = stored(sources.groupBy("x", "y").agg(F.min("sid").alias("sid")))
    rest, found = targets.select("x", "y").distinct(), None
    for width in (radius / 16, radius / 4, radius):
        cell = lambda c: F.floor(F.col(c) / width).cast("long")  # noqa: B023, E731
        s = places.select("sid", F.col("x").alias("sx"), F.col("y").alias("sy"), cell("x").alias("cx"), cell("y").alias("cy"))
        t = rest.select("x", "y", F.explode(offsets(1, disc=False)).alias("o")).select("x", "y", (cell("x") + F.col("o.di")).alias("cx"), (cell("y") + F.col("o.dj")).alias("cy"))
        # A margin keeps sources that are as near after rounding within the 9 cells.
        limit = radius * radius if width == radius else width * width * 0.999 - 1e-8
        pairs = t.join(s.hint("merge"), ["cx", "cy"]).withColumn("d2", F.round(d2, 9)).where(F.col("d2") <= limit)
        near = pairs.groupBy("x", "y").agg(F.min(F.struct("d2", "sid")).alias("m"))
        if width < radius:
            near = stored(near)
            rest = rest.join(near.hint("merge"), ["x", "y"], "leftanti")
        found = near if found is None else found.union(near)
    of_targets = targets.select("tid", "x", "y").join(found.hint("merge"), ["x", "y"]).groupBy("tid").agg(F.min("m").alias("m"))
    return of_targets.select("tid", F.col("m.sid").alias("sid"), F.round(F.sqrt("m.d2"), 6).alias("dist"))
