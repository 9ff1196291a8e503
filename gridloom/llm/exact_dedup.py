"""Exact dedup by a heavy-hitter split (native).

A Misra-Gries summary names the digests that may be frequent; their exact counts and winners are
few and are broadcast, so copies of frequent texts are settled where they are read. All other
digests take an ordinary shuffle. Whole texts are digested; only digests and ids are moved.

Defined results: a null text counts as empty; equal means identical after lower-casing A-Z only;
the largest doc_id of a group stays (null is smallest); rows that repeat both doc_id and text are
one document and get the same decision; an empty table gives no rows; further columns of the
input, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import LOWER, UPPER, ascii_lower, cut_lineage


def heavy_candidates(digests: DataFrame, tracked: int, most: int) -> DataFrame:
    """At most ``most`` digests, with every one that has over rows / tracked rows among them.

    Misra-Gries summaries of single tasks are merged in two steps, so that no task gathers them all.
    """
    first = digests.groupBy((F.spark_partition_id() % 64).alias("part")).agg(F.expr(f"approx_top_k_accumulate(digest, {tracked})").alias("state"))
    # Grouped by a constant: an ungrouped aggregate also merges the null state of empty partitions, which fails.
    return first.groupBy(F.col("part") < 0).agg(F.expr(f"approx_top_k_combine(state, {tracked})").alias("state")).select(F.explode(F.expr(f"approx_top_k_estimate(state, {most})")).alias("x")).select(F.col("x.item").alias("digest"))


def exact_dedup(documents: DataFrame, tracked: int = 4096, most: int = 1024, heavy_share: float = 1e-4) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``documents``.

    tracked: counters of the summary; most: digests that may be broadcast; heavy_share: share of
    all rows from which a verified digest counts as heavy. They steer the work, not the result: with more than ``most``
    heavy digests the others take the ordinary way.
    """
    signed = cut_lineage(documents.select("doc_id", F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256).alias("digest")))
    candidates = heavy_candidates(signed, tracked, most)
    least = signed.count() * heavy_share
    winners = signed.join(F.broadcast(candidates), "digest", "leftsemi").groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where(F.col("group_size") >= max(2, least))
    winners = cut_lineage(winners)
    settled = signed.join(F.broadcast(winners), "digest")
    rest = signed.join(F.broadcast(winners.select("digest")), "digest", "leftanti")
    same = Window.partitionBy("digest")
    rest = rest.select("digest", "doc_id", F.max("doc_id").over(same).alias("keep_id"), F.count(F.lit(1)).over(same).alias("group_size"))
    return settled.select(rest.columns).union(rest).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS s FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, s AS text_sha256
FROM d WINDOW w AS (PARTITION BY s)
"""
