"""Statistics and quality of dense patches (patch, i, j, v)."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.draws import drawn


def r6(c: Column) -> Column:
    return F.round(c, 6)


def statistics(pixels: DataFrame) -> DataFrame:
    """Population moments, order statistics and sign counts of each patch; NaN is left out."""
    v = F.when(~F.isnan("v"), F.col("v"))
    q = lambda p: F.percentile(v, F.lit(p))
    return pixels.groupBy("patch").agg(
        r6(F.avg(v)).alias("mean"), r6(F.stddev_pop(v)).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), r6(q(0.5)).alias("median"),
        F.round(F.skewness(v), 5).alias("skew"), F.round(F.kurtosis(v), 5).alias("kurtosis"), r6(F.max(v) - F.min(v)).alias("range"), r6(q(0.25)).alias("q25"), r6(q(0.75)).alias("q75"), r6(q(0.75) - q(0.25)).alias("iqr"),
        F.count_if(v != 0).alias("nonzero"), F.count_if(v < 0).alias("negative"), F.count_if(v > 0).alias("positive"),
    )


def gradient_statistics(gradients: DataFrame) -> DataFrame:
    """Mean and deviation of the gradient's length; from (patch, gi, gj)."""
    g = F.sqrt(F.col("gi") * F.col("gi") + F.col("gj") * F.col("gj"))
    return gradients.groupBy("patch").agg(r6(F.avg(g)).alias("grad_mean"), r6(F.stddev_pop(g)).alias("grad_std"))


def histogram_entropy(pixels: DataFrame, bins: int = 50, probability: bool = False) -> DataFrame:
    """-sum h log2(h + 1e-10) over equal bins between a patch's extremes; h are densities, or shares."""
    w = Window.partitionBy("patch")
    ranged = pixels.select("patch", "v", F.min("v").over(w).alias("lo"), F.max("v").over(w).alias("hi"), F.count("v").over(w).alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    k = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor(F.try_divide(F.col("v") - F.col("lo"), width)), F.lit(bins - 1)))
    cells = ranged.groupBy("patch", "n", width.alias("width"), k.alias("k")).agg(F.count(F.lit(1)).alias("c"))
    h = F.col("c") / F.col("n") if probability else F.try_divide(F.col("c") / F.col("n"), F.col("width"))
    return cells.groupBy("patch").agg(F.round(-F.sum(h * F.log2(h + 1e-10)), 4).alias("entropy"))


def anomalies(pixels: DataFrame, limit: float = 3.0) -> DataFrame:
    """z-scores of each patch's mean and deviation among all patches, and whether either passes the limit."""
    each = pixels.groupBy("patch").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    moments = {c: (each.agg(F.avg(c)).scalar(), each.agg(F.stddev_pop(c)).scalar()) for c in ("m", "s")}
    z = {c: F.coalesce(F.try_divide(F.col(c) - mean, std), F.lit(0.0)) for c, (mean, std) in moments.items()}
    return each.select("patch", F.round(z["m"], 5).alias("z_mean"), F.round(z["s"], 5).alias("z_std"), ((F.abs(z["m"]) > limit) | (F.abs(z["s"]) > limit)).alias("anomaly"))


def grid_structure(pixels: DataFrame) -> DataFrame:
    """Rows and columns of the largest and smallest deviation, and the number of different values."""
    side = lambda a, name: pixels.groupBy("patch", a).agg(r6(F.stddev_pop("v")).alias("s")).groupBy("patch").agg(F.max(F.struct("s", -F.col(a))).alias("hi"), F.min(F.struct("s", F.col(a).alias("k"))).alias("lo")).select("patch", (-F.col("hi").getField("col2")).alias(f"max_{name}"), F.col("lo.k").alias(f"min_{name}"))
    distinct = pixels.groupBy("patch").agg(F.countDistinct("v").alias("unique"))
    return side("i", "row").join(side("j", "col"), "patch").join(distinct, "patch")


def pool_check(pixels: DataFrame, processed: DataFrame, k: int) -> DataFrame:
    """Expected k x k means against processed ones: MSE, correlation, and how many match closely."""
    expected = pixels.groupBy("patch", F.floor(F.col("i") / k).alias("bi"), F.floor(F.col("j") / k).alias("bj")).agg(F.avg("v").alias("e"))
    both = expected.join(processed.select("patch", "bi", "bj", F.col("v").alias("a")), ["patch", "bi", "bj"])
    close = F.abs(F.col("e") - F.col("a")) <= 1e-6 + 1e-5 * F.abs("a")
    return both.groupBy("patch").agg(F.round(F.avg(F.pow(F.col("e") - F.col("a"), 2)), 9).alias("mse"), F.round(F.corr("e", "a"), 5).alias("corr"), F.count_if(close).alias("close"), F.bool_and(close).alias("all_close"))


def resize(pixels: DataFrame, source: int, target: int) -> DataFrame:
    """Bilinear resize of source x source patches to target x target, corners aligned."""
    step = (source - 1) / (target - 1)
    axis = lambda o, a, b, w: pixels.sparkSession.range(target).select(F.col("id").alias(o), F.least(F.floor(F.col("id") * step + 1e-12), F.lit(source - 2)).alias(a)).select(o, F.explode(F.array(*[F.struct((F.col(a) + d).alias(b), (F.abs(1 - d - (F.col(o) * step - F.col(a)))).alias(w)) for d in (0, 1)])).alias("x")).select(o, f"x.{b}", f"x.{w}")
    rows, cols = axis("oi", "a", "i", "wi"), axis("oj", "a", "j", "wj")
    out = pixels.join(F.broadcast(rows), "i").join(F.broadcast(cols), "j")  # 2 x target rows each
    return out.groupBy("patch", F.col("oi").alias("i"), F.col("oj").alias("j")).agg(r6(F.sum(F.col("v") * F.col("wi") * F.col("wj"))).alias("v"))


def flip(pixels: DataFrame, height: int, width: int, up_down: bool = False, left_right: bool = False, transpose: bool = False) -> DataFrame:
    """Index remaps: transpose first, then flips."""
    i, j = (F.col("j"), F.col("i")) if transpose else (F.col("i"), F.col("j"))
    return pixels.select("patch", (height - 1 - i if up_down else i).alias("i"), (width - 1 - j if left_right else j).alias("j"), "v")


def augment(pixels: DataFrame, size: int, batch: int, seed: int) -> DataFrame:
    """Flips and transposes drawn once for each batch of patches from a seeded hash of the batch number."""
    h = drawn(F.concat_ws("-", F.lit(str(seed)), F.floor(F.col("patch") / batch).cast("string")), 8)
    bit = lambda k: F.floor(h / k) % 2 == 1
    i, j = F.when(bit(1), F.col("j")).otherwise(F.col("i")), F.when(bit(1), F.col("i")).otherwise(F.col("j"))
    return pixels.select("patch", F.when(bit(2), size - 1 - i).otherwise(i).alias("i"), F.when(bit(4), size - 1 - j).otherwise(j).alias("j"), "v")


def boxes(patch: Column, size: int, box: int, columns: int) -> Column:
    """All boxes of a patch as an array of (i0, i1, j0, j1), row by row."""
    i, j = F.floor((patch - 1) / columns) * size, F.pmod(patch - 1, F.lit(columns)) * size
    return F.array(*[F.struct((i + a).alias("i0"), (i + a + box).alias("i1"), (j + b).alias("j0"), (j + b + box).alias("j1")) for a in range(0, size, box) for b in range(0, size, box)])


def tile_arrays(pixels: DataFrame) -> DataFrame:
    """Pixel form to tile form: one array a patch, row by row."""
    return pixels.groupBy("patch").agg(F.array_sort(F.collect_list(F.struct("i", "j", "v"))).alias("x")).select("patch", F.transform("x", lambda s: s["v"]).alias("values"))


def pairwise_distance(pixels: DataFrame) -> DataFrame:
    """Mean squared Euclidean distance of all pairs of patches from moments, without any pair: 2 n / (n - 1) * sum of variances."""
    n = pixels.agg(F.countDistinct("patch")).scalar()
    var = pixels.groupBy("i", "j").agg(F.var_pop("v").alias("s"))
    return var.agg(F.sum("s").alias("s")).select(F.round(2 * F.col("s") * n / (n - 1), 6).alias("mean_squared_distance"))


def principal_components(vectors: DataFrame, column: str, k: int) -> DataFrame:
    """Explained-variance ratios of the leading components (component, ratio, cumulative), by MLlib on Gram matrices."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    model = PCA(k=k, inputCol="x", outputCol="y").fit(vectors.select(array_to_vector(column).alias("x")))
    ratios = model.explainedVariance.toArray().tolist()
    rows = vectors.sparkSession.createDataFrame([(c + 1, round(r, 6), round(sum(ratios[: c + 1]), 6)) for c, r in enumerate(ratios)], "component int, ratio double, cumulative double")
    return rows


def clusters(vectors: DataFrame, key: str, column: str, k: int = 10, seed: int = 42) -> DataFrame:
    """k-means labels of flattened patches, by MLlib."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = vectors.select(key, array_to_vector(column).alias("features"))
    return KMeans(k=k, seed=seed).fit(x).transform(x).select(key, F.col("prediction").alias("cluster"))
