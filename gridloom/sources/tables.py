"""Sources: raster files, index and sequence files, stroke feeds; explicit schemas throughout."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def npy_decoder(content: bytes) -> dict[str, np.ndarray]:
    """A .npy file as one variable ``data``."""
    return {"data": np.load(io.BytesIO(content), allow_pickle=False)}


def read_rasters(spark: SparkSession, path: str, pattern: str = "*.npy", candidates: tuple[str, ...] = ("data", "datamap"), decoder: Callable[[bytes], dict[str, np.ndarray]] = npy_decoder, tile: int = 256) -> DataFrame:
    """Files to tiles: (path, tile_id, h, w, values). The variable is the first candidate that a file has, else its first one.

    Decoding is per file in parallel; masked values become 0, leading dimensions of 1 are dropped. A file that can't be
    decoded gives one row with ``error``.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "tile_id", "h", "w", "values", "error"]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float32()), pa.string()]
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows = []
                try:
                    variables = decoder(content.as_py())
                    key = next((c for c in candidates if c in variables), next(iter(variables)))
                    data = np.squeeze(np.ma.filled(variables[key], 0)).astype(np.float32)
                    columns = -(-data.shape[1] // tile)
                    for i in range(0, data.shape[0], tile):
                        for j in range(0, data.shape[1], tile):
                            part = data[i : i + tile, j : j + tile]
                            rows.append((file, i // tile * columns + j // tile + 1, *part.shape, part.ravel().tolist(), None))
                except Exception as wrong:  # a row, not a failed job
                    rows = [(file, None, None, None, None, f"{type(wrong).__name__}: {wrong}"[:300])]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return files.mapInArrow(run, "path string, tile_id int, h int, w int, values array<float>, error string")


def tile_pixels(tiles: DataFrame, columns: int, tile: int = 256) -> DataFrame:
    """Tile form to pixel form: (path, i, j, v)."""
    rows = tiles.where("error IS NULL").select("path", "tile_id", "w", F.posexplode("values").alias("k", "v"))
    i0, j0 = F.floor((F.col("tile_id") - 1) / columns) * tile, (F.col("tile_id") - 1) % columns * tile
    return rows.select("path", (i0 + F.floor(F.col("k") / F.col("w"))).alias("i"), (j0 + F.col("k") % F.col("w")).alias("j"), "v")


def read_patch_index(spark: SparkSession, path: str, patches: int = 18) -> DataFrame:
    """Wide 0/1 index files to (iso_timestamp, patch_id) of active patches."""
    columns = [f"patch_{k}" for k in range(1, patches + 1)]
    wide = spark.read.csv(path, header=True, schema="date string, time_utc string, iso_timestamp string, " + ", ".join(f"{c} int" for c in columns))
    return wide.unpivot(["iso_timestamp"], columns, "patch", "v").where("v = 1").select("iso_timestamp", F.regexp_extract("patch", r"(\d+)$", 1).cast("int").alias("patch_id"))


def read_sequences(spark: SparkSession, path: str, offsets: list[str]) -> DataFrame:
    """Sequence files with list cells as arrays."""
    names = ["patch_numbers", *offsets]
    raw = spark.read.csv(path, header=True, schema="date string, reference_utc string, start_utc string, end_utc string, " + ", ".join(f"`{c}` string" for c in names) + ", n_qualifying int, n_total_active int", escape='"')
    return raw.withColumns({c: F.from_json(F.col(f"`{c}`"), "array<int>") for c in names})


def read_strokes_archive(spark: SparkSession, path: str) -> DataFrame:
    """Pipe-separated stroke archives."""
    names = ["date", "lon", "lat", "current", "nS", "mode", "intra", "Ax", "Ki2", "Exc", "Incl", "Arc", "d1", "d2", "d3", "d4", "d5"]
    raw = spark.read.csv(path, sep="|", schema=", ".join(f"`{c}` string" for c in names))
    date = F.regexp_replace(F.trim("date"), r"\s*UTC$", "")
    return raw.select(F.try_to_timestamp(date, F.lit("dd.MM.yyyy HH:mm:ss[.SSSSSS][.SSS][.S]")).alias("ts"), *[F.trim(c).cast("double").alias(c) for c in ("lon", "lat", "current")], F.trim("intra").alias("intra"))


def read_strokes_feed(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """White-space separated live feed; also as a stream."""
    text = (spark.readStream if stream else spark.read).text(path)
    p = F.split(F.trim("value"), r"\s+")
    return text.where(F.size(p) >= 5).select(F.try_to_timestamp(p[2], F.lit("yyyyMMddHHmmss")).alias("ts"), p[0].cast("double").alias("lat"), p[1].cast("double").alias("lon"), p[3].alias("intra"), p[4].cast("double").alias("current"))


def read_scores(spark: SparkSession, path: str, prefix: str, index: int = 0) -> DataFrame:
    """(coalition, score) of files ``eval-<prefix>-<coalition>.csv``: the number in line ``index``; ``null`` stands for the empty coalition."""
    files = spark.read.option("pathGlobFilter", f"eval-{prefix}-*.csv").option("recursiveFileLookup", "true").text(path, wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_name"), rf"^eval-{prefix}-(.*)\.csv$", 1)
    return files.select(F.when(name == "null", "").otherwise(name).alias("coalition"), F.get(F.split("value", "\n"), F.lit(index)).cast("double").alias("score"))


def discover(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(folder, file, path) of the files below ``path``; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path")
    parts = F.split("path", "/")
    return files.select(F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("file"), "path")


def files_before(catalog: DataFrame, times: DataFrame, interval: int) -> DataFrame:
    """Files (file, s) of [t - interval, t) for each t of ``times``: joined on equal buckets of ``interval`` seconds, two for each time."""
    buckets = times.select("t").distinct().withColumn("bucket", F.explode(F.array(F.floor(F.col("t") / interval), F.floor(F.col("t") / interval) - 1)))
    near = catalog.withColumn("bucket", F.floor(F.col("s") / interval)).join(buckets, "bucket")
    return near.where((F.col("s") >= F.col("t") - interval) & (F.col("s") < F.col("t"))).select("t", "file", "s")


def on_time_grid(frames: DataFrame, start: int, end: int, step: int, columns: list[str]) -> DataFrame:
    """Frames (t, ..) at the times start, start + step .. before end; null where there is none."""
    spark = frames.sparkSession
    return spark.range(start, end, step).select(F.col("id").alias("t")).join(frames.select("t", *columns), "t", "left")


def read_patches(spark: SparkSession, path: str, variable: str, dates: list[str] | None = None) -> DataFrame:
    """Patches of a variable from a store partitioned by variable and date; other partitions aren't read."""
    rows = spark.read.parquet(path).where(F.col("variable") == variable)
    return rows if dates is None else rows.where(F.col("date").cast("string").isin(dates))


def read_statistics(spark: SparkSession, path: str) -> DataFrame:
    """Stored patch statistics, a row a patch; columns and filters reach the scan."""
    return spark.read.parquet(path)


def read_wide(spark: SparkSession, path: str, keys: list[str], variables: list[str]) -> DataFrame:
    """A store by variable as a column for each; only the partitions of ``variables`` are read, null where one has no value."""
    rows = spark.read.parquet(path).where(F.col("variable").isin(variables))
    return rows.groupBy(*keys).pivot("variable", variables).agg(F.first("value"))
