"""Connected components of many graphs at once."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.shared import dealt, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Links of a graph that is settled within one task.
TOGETHER = 200_000


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links (a, b), and for each the least node that it reaches."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    least = np.arange(len(nodes))
    while True:
        x, y = least[a], least[b]
        if (x == y).all():
            return nodes, nodes[least]
        low = np.minimum(x, y)
        np.minimum.at(least, x, low)
        np.minimum.at(least, y, low)
        while not np.array_equal(after := least[least], least):
            least = after


def components(links: DataFrame, by: list[str], max_rounds: int = 200, together: int = TOGETHER) -> DataFrame:
    """(by, node, component) of the nodes that have a link; component is the least node. ``links``: (by, a, b), longs, undirected.

    A graph of at most ``together`` links is settled in one task. Of larger ones, rounds tie the greater neighbours of a node to its least one and then the lesser ones to the least, which flattens
    trees in a number of rounds that grows with the logarithm of the longest path. No node's neighbours are gathered. Every round
    is written to the shared folder and read again.
    """
    pair = lambda a, b: [*by, F.col(a).alias("a"), F.col(b).alias("b")]
    links = stored(links.where("a <> b").select(*by, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if by and together:
        names = [*by, "node", "component"]

        def at_once(key: tuple, table: pa.Table) -> pa.Table:
            found = least_reached(table.column("a").to_numpy(), table.column("b").to_numpy())
            same = [pa.repeat(k, len(found[0])) for k in key]
            return pa.Table.from_arrays([*same, *map(pa.array, found)], names)

        schema = ", ".join([f"`{c}` {links.schema[c].dataType.simpleString()}" for c in by] + ["node long", "component long"])
        large = links.groupBy(*by).count().where(F.col("count") > together).select(*by)
        if large.isEmpty():
            return dealt(links, links.count(), *by).groupBy(*by).applyInArrow(at_once, schema)
        large = stored(large)
        small = links.join(large, by, "leftanti").select(*links.columns).groupBy(*by).applyInArrow(at_once, schema)
        return small.union(components(links.join(large, by, "leftsemi").select(*links.columns), by, max_rounds, 0))
    for _ in range(max_rounds):
        both = links.union(links.select(*pair("b", "a")))
        least = both.groupBy(*by, "a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, [*by, "a"]).where("b > a").select(*pair("b", "m")).distinct()
        tied = large.join(large.groupBy(*by, "a").agg(F.min("b").alias("m")), [*by, "a"])
        after = stored(tied.where("b <> m").select(*pair("b", "m")).union(tied.select(*pair("a", "m"))).distinct())
        same = [x.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*by, "a", "b").cast("decimal(38,0)")).alias("s")).first() for x in (links, after)]
        links = after
        if same[0] == same[1]:
            return links.select(*by, F.col("a").alias("node"), F.col("b").alias("component")).union(links.select(*by, "b", "b").distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
