"""Ranks within groups, however large: rows are range-partitioned by group and order, numbered inside the partitions, and the
counts of earlier partitions are added. Only those counts, one a partition and group, are brought together."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.shared import stored


def _placed(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(rows.repartitionByRange(parts, *by, *order).withColumn("part_", F.spark_partition_id()))


def _before(placed: DataFrame, by: list[str], amount) -> DataFrame:
    sums = placed.groupBy(*by, "part_").agg(amount.alias("sum_"))
    return sums.select(*by, "part_", (F.sum("sum_").over(Window.partitionBy(*by).orderBy("part_")) - F.col("sum_")).alias("before_"))


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with their number from 1 in each group; ``order`` should end with a key, so that no value is one partition."""
    placed = _placed(rows, by, order)
    inside = Window.partitionBy(*by, "part_").orderBy(*order)
    joined = placed.join(_before(placed, by, F.count(F.lit(1))), [*by, "part_"])
    return joined.withColumn(name, F.col("before_") + F.row_number().over(inside)).drop("part_", "before_")


def running_counts(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, n, upto): how often each value is there, and how many rows have it or less."""
    placed = _placed(rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n")), by, [value])
    inside = Window.partitionBy(*by, "part_").orderBy(value)
    joined = placed.join(_before(placed, by, F.sum("n")), [*by, "part_"])
    return joined.select(*by, value, "n", (F.col("before_") + F.sum("n").over(inside)).alias("upto"))


def quantiles(rows: DataFrame, by: list[str], value: str, n: int) -> DataFrame:
    """(by, q, value) for q = 0 .. n: exact quantiles q / n of the values that aren't null, linear between neighbours. No group's
    values are gathered: each different value tells which quantiles it is beside."""
    counts = running_counts(rows.where(F.col(value).isNotNull()), by, value)
    counts = stored(counts)
    total = counts.groupBy(*by).agg(F.max("upto").alias("total_"))
    at = lambda q: F.lit(1.0) * q * (F.col("total_") - 1) / n
    holds = lambda p: (p >= F.col("upto") - F.col("n")) & (p < F.col("upto"))
    beside = F.filter(F.sequence(F.lit(0), F.lit(n)), lambda q: holds(F.floor(at(q))) | holds(F.ceil(at(q))))
    met = counts.join(total, by).withColumn("q", F.explode(beside))
    ends = met.groupBy(*by, "q", "total_").agg(F.max(F.when(holds(F.floor(at(F.col("q")))), F.col(value))).alias("low_"), F.max(F.when(holds(F.ceil(at(F.col("q")))), F.col(value))).alias("high_"))
    share = at(F.col("q")) - F.floor(at(F.col("q")))
    return ends.select(*by, "q", (F.col("low_") + (F.col("high_") - F.col("low_")) * share).alias(value))


def running_totals(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """``rows`` with ``n_`` and ``sum_``, of the values that aren't null up to each row of its group."""
    placed = _placed(rows, by, order)
    parts = placed.groupBy(*by, "part_").agg(F.count(value).alias("m_"), F.coalesce(F.sum(value), F.lit(0.0)).alias("t_"))
    earlier = Window.partitionBy(*by).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select(*by, "part_", F.coalesce(F.sum("m_").over(earlier), F.lit(0)).alias("m_"), F.coalesce(F.sum("t_").over(earlier), F.lit(0.0)).alias("t_"))
    inside = Window.partitionBy(*by, "part_").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = placed.join(before, [*by, "part_"])
    total = F.col("t_") + F.coalesce(F.sum(value).over(inside), F.lit(0.0))
    return joined.withColumns({"n_": F.col("m_") + F.count(value).over(inside), "sum_": total}).drop("part_", "m_", "t_")


def neighbour_steps(rows: DataFrame, by: list[str], order: list[str], step: Column, value: str) -> DataFrame:
    """(by, n, total): rows, and the sum of ``step`` over neighbours in the order of each group; in ``step``, ``value`` is the row's
    and ``was_`` its forerunner's. Forerunners across two partitions come from the partitions' ends alone."""
    placed = _placed(rows, by, order)
    inside = Window.partitionBy(*by, "part_").orderBy(*order)
    steps = placed.withColumn("was_", F.lag(value).over(inside))
    sums = steps.groupBy(*by, "part_").agg(F.count(F.lit(1)).alias("n"), F.sum(step).alias("total"), F.min_by(value, F.struct(*order)).alias(value), F.max_by(value, F.struct(*order)).alias("last_"))
    ends = sums.withColumn("was_", F.lag("last_").over(Window.partitionBy(*by).orderBy("part_")))
    return ends.withColumn("border_", step).groupBy(*by).agg(F.sum("n").alias("n"), (F.coalesce(F.sum("total"), F.lit(0)) + F.coalesce(F.sum("border_"), F.lit(0))).alias("total"))
