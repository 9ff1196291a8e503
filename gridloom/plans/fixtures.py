"""Views of the given tables as the data model: activity, pixels, patches, predictions, strokes, runs.

Every fixture is derived by Spark from a whole table. ``SQL_*`` are the same definitions for the oracle.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.shared import dealt

SECONDS = "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def patch_active(spark, sf_dir, minutes=60, patches=18):
    """(slot, patch_id): which patches are active in a time step."""
    events = table(spark, sf_dir, "events")
    return events.select(F.floor(F.expr(SECONDS) / (60 * minutes)).alias("slot"), (F.col("user_id") % patches + 1).alias("patch_id")).distinct()


def pixels(spark, sf_dir):
    """(frame, i, j, v): sparse pixels of 96 x 192 frames; a frame for every 4,000 order keys, so that their number follows the table.

    Frames are dealt out whole, several to a task, so that what goes by frame and pixel afterwards stays where it is. The count reads footers only.
    """
    rows = table(spark, sf_dir, "lineitem")
    cells = rows.select(F.floor(F.col("l_orderkey") / 4000).alias("frame"), (F.col("l_partkey") % 96).alias("i"), ((F.col("l_suppkey") * 7 + F.col("l_orderkey")) % 192).alias("j"), F.col("l_quantity").cast("double").alias("v"))
    return dealt(cells, rows.count(), "frame").groupBy("frame", "i", "j").agg(F.max("v").alias("v"))


def patch8(spark, sf_dir):
    """(patch, i, j, v): 64 numbers of a vector as an 8 x 8 patch."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("patch"), F.posexplode("embedding").alias("pos", "v")).select("patch", F.floor(F.col("pos") / 8).alias("i"), (F.col("pos") % 8).cast("long").alias("j"), F.col("v").cast("double").alias("v"))


def predictions(spark, sf_dir):
    """(id, lead, y_true, y_pred) with leads 1..3."""
    rows = table(spark, sf_dir, "events")
    return rows.select(F.col("event_id").alias("id"), (F.col("event_id") % 3 + 1).cast("int").alias("lead"), F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("y_true"), F.least(F.col("value").cast("double") / 100, F.lit(1.0)).alias("y_pred"))


def classes(spark, sf_dir):
    """(lead, t, p): true and predicted rain class 0..4 by cuts at 10, 20, 30, 40."""
    rows = table(spark, sf_dir, "lineitem")
    cut = lambda x: F.when(x < 10, 0).when(x < 20, 1).when(x < 30, 2).when(x < 40, 3).otherwise(4)
    return rows.select((F.col("l_linenumber") % 3 + 1).cast("int").alias("lead"), cut(F.col("l_quantity").cast("double")).alias("t"), cut(F.col("l_extendedprice").cast("double") / 2000).alias("p"))


def strokes(spark, sf_dir):
    """(id, s, lon, lat, current, intra, i, j); s counts seconds."""
    rows = table(spark, sf_dir, "events")
    return rows.select(
        F.col("event_id").alias("id"), F.expr(SECONDS).alias("s"), (20 + (F.col("user_id") % 100) / 10.0).alias("lon"), (43.5 + (F.col("event_id") % 50) / 10.0).alias("lat"),
        F.when(F.col("event_id") % 2 == 0, F.col("value").cast("double")).otherwise(-F.col("value").cast("double")).alias("current"),
        F.when(F.col("event_type").isin("click", "view"), "IC").otherwise("CG").alias("intra"), (F.col("event_id") % 50).alias("i"), (F.col("user_id") % 100).alias("j"),
    )


def runs(spark, sf_dir):
    """(run_id, start_day, end_day): forecast runs and the days that they cover, as day numbers."""
    rows = table(spark, sf_dir, "orders")
    day = F.unix_date(F.col("o_orderdate").cast("date"))
    return rows.select(F.col("o_orderkey").alias("run_id"), day.alias("start_day"), (day + 1 + F.col("o_orderkey") % 30).cast("int").alias("end_day"))


def valid_days(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.unix_date(F.col("l_shipdate").cast("date")).alias("day")).distinct()


def sql_active(minutes=60, patches=18):
    return f"active AS (SELECT DISTINCT CAST(floor(epoch(ts) / {60 * minutes}) AS BIGINT) AS slot, user_id % {patches} + 1 AS patch_id FROM events)"


SQL_PIXELS = "pixels AS (SELECT l_orderkey // 4000 AS frame, l_partkey % 96 AS i, (l_suppkey * 7 + l_orderkey) % 192 AS j, max(CAST(l_quantity AS DOUBLE)) AS v FROM lineitem GROUP BY ALL)"
SQL_PATCH8 = "patch8 AS (SELECT vec_id AS patch, (pos - 1) // 8 AS i, (pos - 1) % 8 AS j, CAST(embedding[pos] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS pos))"
SQL_PREDICTIONS = "predictions AS (SELECT event_id AS id, CAST(event_id % 3 + 1 AS INT) AS lead, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y_true, least(CAST(value AS DOUBLE) / 100, 1.0) AS y_pred FROM events)"
_CUT = "CASE WHEN {0} < 10 THEN 0 WHEN {0} < 20 THEN 1 WHEN {0} < 30 THEN 2 WHEN {0} < 40 THEN 3 ELSE 4 END"
SQL_CLASSES = f"classes AS (SELECT CAST(l_linenumber % 3 + 1 AS INT) AS lead, {_CUT.format('CAST(l_quantity AS DOUBLE)')} AS t, {_CUT.format('(CAST(l_extendedprice AS DOUBLE) / 2000)')} AS p FROM lineitem)"
SQL_STROKES = "strokes AS (SELECT event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS s, 20 + (user_id % 100) / 10.0 AS lon, 43.5 + (event_id % 50) / 10.0 AS lat, CASE WHEN event_id % 2 = 0 THEN CAST(value AS DOUBLE) ELSE -CAST(value AS DOUBLE) END AS current, CASE WHEN event_type IN ('click', 'view') THEN 'IC' ELSE 'CG' END AS intra, event_id % 50 AS i, user_id % 100 AS j FROM events)"
SQL_RUNS = "runs AS (SELECT o_orderkey AS run_id, CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS start_day, CAST(o_orderdate AS DATE) - DATE '1970-01-01' + 1 + o_orderkey % 30 AS end_day FROM orders), days AS (SELECT DISTINCT CAST(l_shipdate AS DATE) - DATE '1970-01-01' AS day FROM lineitem)"
