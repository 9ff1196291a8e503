"""SimHash near-dedup with multi-index hashing.

Fingerprints are 64-bit majorities over XXH64 of 3-word shingles. Two fingerprints at distance 3 or
less are at distance 1 or less in one of two 32-bit segments. Of two segments that differ in one
bit, one has a 1 there; so each fingerprint probes the table with its segment and with each of its
1 bits cleared, and every close pair meets. Full distances are verified in the join. Only distinct
fingerprints are joined; copies follow by membership.

In a group of many fingerprints that share a segment, all are first compared with the least one; those
linked to it need no comparison among themselves, since components don't change by it.

Defined results: null, empty and blank texts have fingerprint zero and are linked like others;
fewer than 3 words make one shingle; very long texts are read whole, their hashes counted in blocks; null doc_ids take part and count only where no other id is in a
component (component_id null then); repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import components, cut_lineage, with_columns

SHINGLE = 3
SEED = 42
DISTANCE = 3
#: Shingle hashes that are unpacked to bits at once.
_BLOCK = 1 << 16


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of a text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words)))
    if len(words) <= width:
        starts, stops = [0], [len(joined)]
    else:
        starts, stops = [0, *ends[:-width].tolist()], (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, stops)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), _BLOCK):
        ones += np.unpackbits(h[k : k + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(documents: DataFrame, carry: list[str] = ()) -> DataFrame:
    """(doc_id, the columns in ``carry``, fp), fp as a signed long."""
    kept = ["doc_id", *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py()) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(fp)], [*kept, "fp"])

    return documents.select(*kept, "text").mapInArrow(run, with_columns(documents, kept, "fp long"))


def _segments(fps: DataFrame) -> DataFrame:
    """Two rows for each fingerprint: segment number and its 32 bits."""
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    return fps.select("*", F.posexplode(F.array(low, high)).alias("seg", "key"))


def close_pairs(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) between distinct fingerprints of ``fps`` (fp) that give the components of all
    links at ``distance`` (at most 3) or less."""
    if not 0 <= distance <= 3:
        raise ValueError("two segments with balls of radius 1 find distances up to 3")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    table = cut_lineage(_segments(fps.select("fp").distinct()))
    # Equal segments: with the least fingerprint of the group first.
    least = table.groupBy("seg", "key").agg(F.min("fp").alias("least"), F.count(F.lit(1)).alias("members")).where("members > 1")
    grouped = cut_lineage(table.join(least, ["seg", "key"]).select("seg", "key", F.col("fp").alias("a"), F.col("least").alias("b")).withColumn("linked", near))
    stars = grouped.where("linked AND a <> b").select("a", "b")
    # What isn't linked to the least one meets the whole group.
    loose = grouped.where("NOT linked").select("seg", "key", "a")
    within = loose.join(grouped.select("seg", "key", F.col("a").alias("b")), ["seg", "key"]).where(near & (F.col("a") != F.col("b"))).select("a", "b")
    # Segments that differ in one bit.
    bits = F.filter(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)), lambda m: F.col("key").bitwiseAND(m) != 0)
    probes = table.select("seg", F.col("fp").alias("a"), F.explode(F.transform(bits, lambda m: F.col("key").bitwiseXOR(m))).alias("key"))
    across = probes.join(table.withColumnRenamed("fp", "b"), ["seg", "key"]).where(near).select("a", "b")
    return stars.union(within).union(across)


def near_duplicates(documents: DataFrame, distance: int = DISTANCE, carry: list[str] = ()) -> DataFrame:
    """(doc_id, the columns in ``carry``, fingerprint, component_id, component) for every row of ``documents``.

    component tells components apart also where no id is known: it is the least fingerprint, as a signed long.
    """
    marked = cut_lineage(fingerprints(documents, carry))
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    group = components(close_pairs(distinct, distance))
    named = distinct.join(group, distinct.fp == group.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = cut_lineage(named)
    first = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_fp = named.join(first, "component").select("fp", "component_id", "component")
    return marked.join(of_fp, "fp").select("doc_id", *carry, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "component")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("component")


SQL = None  # DuckDB has no XXH64; tests compare with all pairs
