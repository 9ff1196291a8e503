"""Mean and deviation of the distances of all pairs of vectors.

The plain mean has no shortcut by moments: all pairs are looked at, so that the work is quadratic in the number of vectors. Vectors are
dealt to blocks; a task gets two blocks, takes the distances between them by matrix products of a part of each, and gives back sums only.
Each vector is moved once for each block that it meets. There are at most GROUPS blocks as long as a task can hold two of them, so
that what is moved grows with the vectors and not with their square.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Vectors of one side of a matrix product; blocks, and vectors of a block, at most. More vectors than GROUPS * HELD take more blocks.
BLOCK, GROUPS, HELD = 2048, 16, 100_000


def block_sums(x: np.ndarray, y: np.ndarray | None, block: int) -> tuple[int, float, float]:
    """The same as ``pair_sums`` for sides of any length, by parts of ``block`` vectors."""
    n, s, q = 0, [], []
    for k in range(0, len(x), block):
        part = x[k : k + block]
        for other in [None, *range(k + block, len(x), block)] if y is None else range(0, len(y), block):
            found = pair_sums(part, None if other is None else (x if y is None else y)[other : other + block])
            n, s, q = n + found[0], [*s, found[1]], [*q, found[2]]
    return n, math.fsum(s), math.fsum(q)


def pair_sums(x: np.ndarray, y: np.ndarray | None) -> tuple[int, float, float]:
    """Number, sum and sum of squares of the distances within x, or between x and y. Both are shifted to one origin first, which keeps digits."""
    origin = x.mean(axis=0)
    a = x - origin
    b = a if y is None else y - origin
    squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T)
    squares = np.maximum(squares, 0)
    if y is None:
        squares = squares[np.triu_indices(len(a), 1)]
    return squares.size, float(np.sqrt(squares).sum()), float(squares.sum())


def distance_statistics(vectors: DataFrame, key: str, column: str, block: int = BLOCK) -> DataFrame:
    """One row: pairs, mean and standard deviation (population) of the Euclidean distances of all pairs of rows; a null vector takes part in
    none, rows that repeat count each. Under two vectors mean and deviation are null."""
    kind = vectors.schema[column].dataType.simpleString()
    x = F.col(column) if kind == "array<float>" else F.col(column).cast("array<double>")
    rows = vectors.where(F.col(column).isNotNull()).select(F.xxhash64(key).alias("h"), x.alias("x"))
    number = rows.count()
    blocks = max(1, min(-(-number // block), max(GROUPS, -(-number // HELD))))
    # The rows of block k are in the pairs (0, k) .. (k, k) .. (k, last).
    own = F.pmod(F.col("h"), F.lit(blocks)).cast("int")
    meets = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    sent = rows.withColumn("own", own).withColumn("other", meets).select("own", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "x")

    def look(table: pa.Table) -> pa.Table:
        a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
        own = table.column("own").to_numpy()
        column = table.column("x").combine_chunks()
        x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
        first, second = x[own == a], x[own == b]
        found = (0, 0.0, 0.0) if not (len(first) and len(second)) else block_sums(first, None if a == b else second, block)
        return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(found, (pa.int64(), pa.float64(), pa.float64()))], ["n", "s", "q"])

    sums = sent.groupBy("a", "b").applyInArrow(look, "n long, s double, q double").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.try_divide("s", "n")
    return sums.select(F.col("n").alias("pairs"), F.round(mean, 6).alias("mean"), F.when(F.col("n") > 0, F.round(F.sqrt(F.greatest(F.try_divide("q", "n") - mean * mean, F.lit(0.0))), 6)).alias("std"))
