"""What several operators share: the shared folder, narrow checkpoints, hashing and components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space that separates words: blank and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
#: Spark's setting by which shuffle files go when the query that made them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting of the rows in a message to Python.
MESSAGES = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session (tests) may go without the setting; it gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared folder; meant for narrow tables that are read again."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


@contextmanager
def setting(spark: SparkSession, key: str, value: object) -> Iterator[None]:
    """A setting of the session for what is run within."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(value))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stored(df: DataFrame, message_rows: int | None = None) -> DataFrame:
    """``df`` written to the shared folder as compressed Parquet and read again; for wider tables.

    What was shuffled for the write isn't needed once it is complete, so Spark removes it then. ``message_rows``: rows that Spark
    hands to Python in a message; a message of 10,000 long texts takes much memory on both sides.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    with setting(spark, CLEANUP, "true"), setting(spark, MESSAGES, message_rows) if message_rows else nullcontext():
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_columns(documents: DataFrame, columns: list[str], more: str) -> T.StructType:
    """The schema of some columns of ``documents``, whatever their names and types, and of more columns, as DDL."""
    return T.StructType([T.StructField(c, documents.schema[c].dataType) for c in columns] + T.StructType.fromDDL(more).fields)


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case, nothing else. ``lower`` is the same on pure ASCII and much faster there."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


_MIX = np.random.default_rng(20_240_601).integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_R = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_R_INV = np.uint64(pow(int(_R), -1, 2**64))
_powers: list[np.ndarray] = []
#: Bytes of text whose prefix sums are taken together.
PIECE_BYTES = 1 << 15


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of R and of its inverse, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((_R, _R_INV)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            np.multiply.accumulate(table, out=table)
            _powers[k : k + 1] = [table]
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of a hash depends on all of its input."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of ``data`` and the byte position at which each begins.

    A word's hash is a polynomial over per-byte random values, taken from prefix sums, so that
    all words of a block are hashed together. It depends on the word alone, not on its place.
    """
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = np.zeros(len(raw) + 2, bool)
    np.greater(raw - np.uint8(9), 4, out=inside[1:-1])  # not U+0009 to U+000D: smaller bytes wrap around
    inside[1:-1] &= raw != 32
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    sums = np.empty(len(start), np.uint64)
    edges = np.searchsorted(start, np.arange(0, len(raw) + PIECE_BYTES, PIECE_BYTES))
    for low, high in zip(edges[:-1], edges[1:]):  # whole words, some that stay in a processor's cache
        if low < high:
            first, last = start[low], end[high - 1]
            power, inverse = _power_tables(last - first + 1)
            upto = np.empty(last - first + 1, np.uint64)
            upto[0] = 0
            np.cumsum(_MIX.take(raw[first:last]) * power[: last - first], out=upto[1:])
            sums[low:high] = (upto[end[low:high] - first] - upto[start[low:high] - first]) * inverse[start[low:high] - first]
    return mixed(sums + (end - start).astype(np.uint64)), start


def _places(keys: list[np.ndarray], size: int) -> np.ndarray:
    h = np.zeros(len(keys[0]), np.uint64)
    for key in keys:
        h = mixed(h * _R + key.astype(np.int64).view(np.uint64))
    return h % np.uint64(size)


class SharedFilter:
    """What tasks ask a KeyFilter; only an array is broadcast, so that executors need no class of this package."""

    def __init__(self, bits, size: int):
        self.bits, self.size = bits, size

    def has(self, *keys: np.ndarray) -> np.ndarray:
        bits, at = self.bits.value, _places(list(keys), self.size)
        return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


class KeyFilter:
    """A Bloom filter with one hash over long key columns: no key of ``rows`` is missed, few others pass.

    Its size follows the number of rows up to MOST_BITS; that many bits go to the driver and the tasks.
    Beyond, more other keys pass, which costs shuffling and changes no result.
    """

    LEAST_BITS, MOST_BITS, BITS_A_KEY = 1 << 15, 1 << 26, 16

    def __init__(self, rows: DataFrame, keys: list[str]):
        keyed = rows.select(*keys)
        self._context = rows.sparkSession.sparkContext
        self.size = size = min(self.MOST_BITS, max(self.LEAST_BITS, 1 << (self.BITS_A_KEY * keyed.count()).bit_length()))
        self.bits = np.zeros(size // 8, np.uint8)

        def run(batches):
            for batch in batches:
                at = _places([batch.column(c).to_numpy(zero_copy_only=False) for c in keys], size)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(at).astype(np.int64) + 1)], ["at"])

        places = keyed.mapInArrow(run, "at long").select(F.bitmap_bucket_number("at").alias("bucket"), F.bitmap_bit_position("at").alias("bit"))
        for row in places.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():  # at most MOST_BITS in all
            self.bits[(row.bucket - 1) * 4096 : row.bucket * 4096] = np.frombuffer(row.bits, np.uint8)

    def shared(self) -> SharedFilter:
        """The filter for tasks, its bits as a broadcast variable."""
        return SharedFilter(self._context.broadcast(self.bits), self.size)


def may_hold(rows: DataFrame, mark: str, marks: DataFrame) -> DataFrame:
    """``rows`` with ``hit``: whether their long ``mark`` may be the ``mark`` of a row of ``marks``; none of those is missed, few others pass.

    A Bloom filter with one hash, native: its bits come as at most MOST_BITS / 32768 rows of 4 KB, which are broadcast. Beyond
    some ten million marks more others pass, which costs shuffling and changes no result.
    """
    size = min(KeyFilter.MOST_BITS, max(KeyFilter.LEAST_BITS, 1 << (KeyFilter.BITS_A_KEY * marks.count()).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(size)) + 1
    told = marks.select(F.bitmap_bucket_number(place("mark")).alias("bucket_"), F.bitmap_bit_position(place("mark")).alias("bit_"))
    bits = told.groupBy("bucket_").agg(F.bitmap_construct_agg("bit_").alias("bits_"))
    at = rows.withColumns({"bucket_": F.bitmap_bucket_number(place(mark)), "bit_": F.bitmap_bit_position(place(mark))}).join(F.broadcast(bits), "bucket_", "left")
    byte = F.conv(F.hex(F.substring("bits_", (F.floor(F.col("bit_") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, (F.col("bit_") % 8).cast("int")) == 1
    return at.withColumn("hit", F.coalesce(hit, F.lit(False))).drop("bucket_", "bit_", "bits_")


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """Connected components of an undirected graph: (node, component), component the least node.

    ``edges`` has long columns ``a`` and ``b``. Rounds alternate two steps of rewiring: every node
    ties its greater neighbours to its least one, then its lesser neighbours to the least. Trees
    flatten in a number of rounds that grows with the logarithm of the longest path, and no node's
    neighbours are gathered: both steps are a partial aggregate, a join and a distinct. Each round is
    written to the shared folder and read back, so that neither lineage nor Spark's size estimates build up.
    """
    links = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(max_rounds):
        # Greater neighbours of every node are tied to the least of it and its neighbours.
        both = links.union(links.select("b", "a"))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("node")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Of the lesser neighbours the least becomes the centre of the others and of the node.
        low = large.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        tied = large.join(low, F.col("a") == F.col("node"))
        small = tied.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(tied.select("a", F.col("m").alias("b"))).distinct()
        after = stored(small)
        same = [x.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first() for x in (links, after)]
        if same[0] == same[1]:
            return after.select(F.col("a").alias("node"), F.col("b").alias("component")).union(after.select("b", "b").distinct())
        links = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
