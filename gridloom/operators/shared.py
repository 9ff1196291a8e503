"""The folder that driver and executors share, and tables written there to cut lineage."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a part of a table that is dealt out by keys, about.
PART_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session (tests) may go without it and gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def dealt(rows: DataFrame, number: int, *keys: str) -> DataFrame:
    """``rows``, ``number`` of them, dealt by ``keys`` into parts of about PART_ROWS rows. Adaptive execution would join parts until they
    have a size on disk, and rows of small numbers are so short there that a task's memory would grow with the table. Groupings by
    these keys and more need no further shuffle."""
    parts = max(-(-number // PART_ROWS), rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(parts, *keys)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once and read again: short lineage, and sizes that Spark knows instead of estimates that build up."""
    path = new_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
