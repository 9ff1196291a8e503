"""Sharding by a Feistel permutation over global row numbers (native).

Every row gets a number 0 .. n-1 that depends on the rows alone; a keyed Feistel network over a
grid of a x b >= n cells, with cycle walking, permutes the numbers; the permuted number gives
shard (modulo) and slot (quotient). Anyone who knows n and the key can compute the place of a row.
The law is ``rows``: counts of shards are at most one apart and slots are gapless from 0.

Defined results: a null text has size 8 and the CRC of no bytes (0); rows with equal doc_id and
text get different numbers; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import cut_lineage

#: Cells into which rows are hashed for numbering; their counts are all that is broadcast.
CELLS = 8192
#: Copies of a row that come out of one task in a stretch.
CHUNK = 1 << 16
ROUNDS = 4
#: Steps of a walk. Outside cells are at most a ~ sqrt(n), so a longer walk has a chance under n ** -32; one that ends outside raises.
WALK = 64


def feistel(x: Column, a: int, b: int, seed: int) -> Column:
    """A permutation of 0 .. a*b-1: rounds that add keyed hashes of one half to the other half."""
    left, right = F.floor(x / F.lit(b)).cast("long"), x % F.lit(b)
    state = F.struct(left.alias("l"), right.alias("r"))
    keys = F.array(*[F.lit(seed * 1000 + k) for k in range(ROUNDS)])

    def one(s: Column, key: Column) -> Column:
        new_left = F.pmod(s["l"] + F.pmod(F.xxhash64(s["r"], key), F.lit(a)), F.lit(a))
        new_right = F.pmod(s["r"] + F.pmod(F.xxhash64(new_left, key), F.lit(b)), F.lit(b))
        return F.struct(new_left.alias("l"), new_right.alias("r"))

    return F.aggregate(keys, state, one, lambda s: s["l"] * F.lit(b) + s["r"])


def permuted(x: Column, n: int, seed: int) -> Column:
    """A permutation of 0 .. n-1: results of n or more are permuted again until they fall below n."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))
    once = feistel(x, a, b, seed)
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once, lambda y, _: F.when(y < n, y).otherwise(feistel(y, a, b, seed)))
    return F.when(once < n, once).when(walk < n, walk).otherwise(F.raise_error(F.lit("a cycle walk did not come back inside; choose another seed")))


def number_rows(rows: DataFrame, keys: list[str], cells: int = CELLS) -> DataFrame:
    """``rows`` with ``row_number`` 0 .. n-1, by hashed cell and then by keys.

    Equal rows are counted together before the shuffle, so that no key makes a task heavy.
    """
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).withColumn("cell", F.pmod(F.xxhash64(*keys), F.lit(cells)))
    counted = cut_lineage(counted)
    per_cell = counted.groupBy("cell").agg(F.sum("copies").alias("in_cell"))
    offsets = per_cell.select("cell", (F.sum("in_cell").over(Window.orderBy("cell")) - F.col("in_cell")).alias("before"))
    inside = Window.partitionBy("cell").orderBy(*keys)
    placed = counted.withColumn("start", F.sum("copies").over(inside) - F.col("copies")).join(F.broadcast(offsets), "cell")
    # The copies of a row come out in stretches of at most CHUNK; those of a row with more are dealt to many tasks first.
    first = placed.select(*keys, "copies", (F.col("before") + F.col("start")).alias("at"))
    few = first.where(F.col("copies") <= CHUNK).select(*keys, "at", F.col("copies").alias("n"))
    many = first.where(F.col("copies") > CHUNK).select(*keys, "at", "copies", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / CHUNK))).alias("c"))
    many = many.repartition("at", "c").select(*keys, (F.col("at") + F.col("c") * CHUNK).alias("at"), F.least(F.lit(CHUNK).cast("long"), F.col("copies") - F.col("c") * CHUNK).alias("n"))
    return few.union(many).select(*keys, F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)).alias("row_number"))


def shard(documents: DataFrame, shards: int = 24, seed: int = 7) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``documents``."""
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b"").cast("binary"))
    sized = documents.select("doc_id", (F.octet_length(body).cast("long") + 8).alias("size"), F.crc32(body).alias("text_crc32"))
    numbered = cut_lineage(number_rows(sized, ["doc_id", "size", "text_crc32"]))
    place = numbered.withColumn("place", permuted(F.col("row_number"), numbered.count(), seed))
    return place.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("place") % shards).cast("int").alias("shard"), F.floor(F.col("place") / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = None  # DuckDB has neither CRC-32 nor XXH64; tests recompute the permutation in Python
