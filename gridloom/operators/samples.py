"""Sample assembly, stitching and set-like helpers."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.draws import drawn
from gridloom.operators.ranks import numbered


def assemble(samples: DataFrame, offsets: list[int], variables: list[str], values: DataFrame) -> DataFrame:
    """Every (sample, step, variable), left-joined to values (t, patch_id, variable, v) at the full time t + step; absent ones are 0.

    ``missing`` counts what a sample lacks.
    """
    grid = samples.select("t", "patch_id", F.explode(F.array(*map(F.lit, offsets))).alias("step")).select("*", F.explode(F.array(*map(F.lit, variables))).alias("variable"))
    got = values.select(F.col("t").alias("at"), "patch_id", "variable", "v")
    rows = grid.withColumn("at", F.col("t") + F.col("step")).join(got, ["at", "patch_id", "variable"], "left")
    cells = rows.groupBy("t", "patch_id", "step").agg(F.array_sort(F.collect_list(F.struct("variable", F.coalesce("v", F.lit(0.0)).alias("v")))).alias("x"), F.count_if(F.col("v").isNull()).alias("missing"))
    return cells.select("t", "patch_id", "step", F.transform("x", lambda s: s["v"]).alias("channels"), "missing")


def patch_locations(patches: DataFrame, zeros: DataFrame) -> DataFrame:
    """(t, i, j, status, idx): patches by location, the least idx where several claim one, and zero patches where there is none."""
    real = patches.groupBy("t", "i", "j").agg(F.min("idx").alias("idx"))
    rest = zeros.select("t", "i", "j").distinct().join(real, ["t", "i", "j"], "leftanti")
    return real.select("t", "i", "j", F.lit("patch").alias("status"), "idx").union(rest.select("t", "i", "j", F.lit("zero"), F.lit(None).cast("long")))


def stitch(origins: DataFrame, locations: DataFrame, steps: int, size: int) -> DataFrame:
    """Status of every cell of steps x size x size boxes from their origins (oid, t, i, j): patch, zero or missing."""
    axis = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    cells = origins.select("oid", F.col("t").alias("t0"), F.col("i").alias("i0"), F.col("j").alias("j0"), F.explode(axis(steps)).alias("dt")).select("*", F.explode(axis(size)).alias("di")).select("*", F.explode(axis(size)).alias("dj"))
    cells = cells.select("oid", "dt", (F.col("t0") + F.col("dt")).alias("t"), (F.col("i0") + F.col("di")).alias("i"), (F.col("j0") + F.col("dj")).alias("j"))
    return cells.join(locations, ["t", "i", "j"], "left").select("oid", "dt", "i", "j", F.coalesce("status", F.lit("missing")).alias("status"), "idx")


def coverage(stitched: DataFrame) -> DataFrame:
    """Found, zero and missing cells of each box and step, and the covered share."""
    n = lambda s: F.count_if(F.col("status") == s)
    return stitched.groupBy("oid", "dt").agg(n("patch").alias("found"), n("zero").alias("zeros"), n("missing").alias("missing"), F.round((n("patch") + n("zero")) / F.count(F.lit(1)), 6).alias("coverage"))


def full_boxes(cells: DataFrame, size: int, steps: int) -> DataFrame:
    """Origins (t, i, j) of size x size boxes that are full in ``steps`` consecutive times; cells (t, i, j)."""
    near = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(size) for b in range(size)])
    full = cells.select("t", "i", "j").distinct().select("t", "i", "j", F.explode(near).alias("o")).groupBy("t", (F.col("i") - F.col("o.a")).alias("i"), (F.col("j") - F.col("o.b")).alias("j")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == size * size)
    ahead = Window.partitionBy("i", "j").orderBy("t").rangeBetween(0, steps - 1)
    return full.withColumn("k", F.count(F.lit(1)).over(ahead)).where(F.col("k") == steps).select("t", "i", "j")


def merge_first(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer merge of two sources on the common grid; the left one wins on conflict."""
    r = right.select(*keys, F.col(value).alias("_r"))
    return left.join(r, keys, "full_outer").select(*keys, F.coalesce(value, "_r").alias(value))


def composite(rows: DataFrame, keys: list[str], spec: str) -> DataFrame:
    """``a + b``, ``a - b`` or ``dot a b c d`` of variables in long form (keys, variable, v); null where one is absent."""
    parts = spec.split()
    wanted = parts[1:] if parts[0] == "dot" else [parts[0], parts[2]]
    wide = rows.where(F.col("variable").isin(wanted)).groupBy(*keys).pivot("variable", list(dict.fromkeys(wanted))).agg(F.first("v"))
    c = [F.col(w) for w in wanted]
    value = c[0] * c[1] + c[2] * c[3] if parts[0] == "dot" else c[0] + c[1] if parts[1] == "+" else c[0] - c[1]
    return wide.select(*keys, value.alias("v"))


def scene(rows: DataFrame, keys: list[str], variables: list[str]) -> DataFrame:
    """One column for each requested variable; absent ones are null."""
    return rows.groupBy(*keys).pivot("variable", variables).agg(F.first("v"))


def presence(rows: DataFrame, key: str, source: str, required: list[str]) -> DataFrame:
    """Keys with the sources that they lack; complete if none."""
    have = rows.groupBy(key).agg(F.collect_set(source).alias("have"))
    lack = F.array_sort(F.array_except(F.array(*map(F.lit, required)), "have"))
    return have.select(key, F.array_join(lack, ",").alias("lacking"), (F.size(lack) == 0).alias("complete"))


def zip_batches(left: DataFrame, right: DataFrame, order: str, group: str) -> DataFrame:
    """Rows of two sides paired by position within the group, up to the shorter; groups may have any size."""
    side = lambda rows, name: numbered(rows.select(group, order), [group], [order], "k").select(group, "k", F.col(order).alias(name))
    return side(left, "a").join(side(right, "b"), [group, "k"])


def hash_split(blocks: DataFrame, key: Column, fractions: dict[str, int]) -> DataFrame:
    """Blocks to splits by a seeded hash in thousandths; a block is never divided."""
    h, out, low = drawn(F.concat(F.lit("13-"), key.cast("string")), 1000), None, 0
    for name, part in fractions.items():
        low += part
        out = F.when(h < low, name) if out is None else out.when(h < low, name)
    return blocks.withColumn("split", out.otherwise("train"))
