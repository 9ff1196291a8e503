"""The corpus pipeline: language, quality, repeated lines, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and gets what the stage before it kept; run() applies them to
``documents``. All but the last return the columns of their input, in its order, further ones included. With
stages written and read again between them, results are the same as in one run.

In all stages: an empty table gives no rows; the names and types of further columns don't matter (map columns excepted, which
Spark can't hash); a row is a document, also where
its doc_id is null or repeated, unless a stage says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import langid, line_dedup, packing, quality, simhash
from gridloom.llm.common import cut_lineage, may_hold

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _plain(docs: DataFrame) -> DataFrame:
    """The columns of documents under their names, all others under names made of their places, so that none can clash."""
    return docs.toDF(*[c if c in COLUMNS and c not in docs.columns[:k] else f"column_{k}" for k, c in enumerate(docs.columns)])


def _boxed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all further columns in one, by their places; the last of them is never null or absent."""
    rest = [F.col(c).alias(f"c{k}") for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*rest, F.lit(0).alias("end")).alias("rest"))


def _unboxed(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col(c) if c in ("doc_id", "text") else F.col("rest")[f"c{k}"].alias(c) for k, c in enumerate(columns)])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language and those whose two best languages are too close.

    A null, empty or letterless text has no language and goes; a null lang only isn't learned from; repeated rows share
    one decision; long texts are read whole; ties go to the language that sorts first, and are rejected.
    """
    plain = _plain(docs)
    training = plain.where(~langid.held_out()).select("doc_id", "text", "lang")
    return _unboxed(langid.identify(_boxed(plain), training, carry=["text", "rest"]).where("accepted"), plain.columns).toDF(*docs.columns)


def apply_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or the likelihood ratio.

    A null, empty or short text fails the base rules and goes; labels of unknown or null ids are harmless; repeated rows
    count each time and share one decision; a score on the threshold stays.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    plain = _plain(docs)
    return _unboxed(quality.quality(_boxed(plain), labels, carry=["rest"]).where("kept"), plain.columns).toDF(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that resemble an earlier line; every document stays, and n_chars follows a changed text.

    Null and empty texts come back as they are; a text whose lines all go is empty; rows that repeat doc_id
    and text are one document, rows that share an id only keep their own lines; of equal lines the earliest stays.
    """
    plain = _plain(docs)
    out = line_dedup.dedup_lines(plain)
    new = F.when(F.size("removed") > 0, F.length("text").cast(plain.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", new).select(*plain.columns).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked fingerprints one row stays: that with the smallest id (nulls last), then the smallest hash
    of all its columns; of rows that repeat all columns one. Null and blank texts are one component like any other."""
    plain = _plain(docs)
    keyed = _boxed(plain).withColumn("mark", F.xxhash64("doc_id", "text", "rest"))
    found = cut_lineage(simhash.near_duplicates(keyed, carry=["mark"]).select("doc_id", "mark", "component"))
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "mark")
    rows = found.groupBy("component", "doc_id", "mark").agg(F.count(F.lit(1)).alias("copies"))
    stays = rows.groupBy("component").agg(F.min_by(F.struct("doc_id", "mark"), rank).alias("stay"))
    stay = F.col("doc_id").eqNullSafe(F.col("stay.doc_id")) & (F.col("mark") == F.col("stay.mark"))
    # Rows that go and rows that are there more than once; all others stay where they are, so that few texts are moved.
    asked = cut_lineage(rows.join(stays, "component").select(F.col("doc_id").alias("asked_id"), F.col("mark").alias("asked_mark"), stay.alias("stays"), "copies").where("NOT stays OR copies > 1"))
    marked = may_hold(keyed, "mark", asked.select(F.col("asked_mark").alias("mark")))
    met = marked.where("hit").join(asked, F.col("doc_id").eqNullSafe(F.col("asked_id")) & (F.col("mark") == F.col("asked_mark")), "left")
    columns = ["doc_id", "text", "rest"]
    once = marked.where("NOT hit").select(*columns).union(met.where("stays IS NULL").select(*columns))
    return _unboxed(once.union(met.where("stays").select(*columns).dropDuplicates()), plain.columns).toDF(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences; a null or empty text is its end token alone, long texts are cut
    into pieces, repeated rows and rows without an id are packed each."""
    return packing.pack(_plain(docs), special=True)


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # tokenization and compression aren't SQL; tests/llm/test_pipeline.py has a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut_lineage(docs)
    return docs
