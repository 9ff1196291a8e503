"""Sinks: index files, sequence files, partitioned stores, idempotent caches."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def wide_index(active: DataFrame, patches: int = 18) -> DataFrame:
    """(ts_text, patch_id) to one row a time with 0/1 columns patch_1 .. patch_n; only times with activity."""
    wide = active.groupBy("ts_text").pivot("patch_id", list(range(1, patches + 1))).agg(F.max(F.lit(1))).na.fill(0)
    return wide.select("ts_text", *[F.col(str(k)).alias(f"patch_{k}") for k in range(1, patches + 1)])


def write_index_csv(active: DataFrame, path: str, patches: int = 18) -> None:
    wide_index(active, patches).write.mode("overwrite").csv(path, header=True)


def index_json(active: DataFrame) -> DataFrame:
    """One JSON object a time: {"ts": .., "patches": [..]}; rows, so that no time span has to fit in one."""
    lists = active.groupBy("ts_text").agg(F.array_sort(F.collect_set("patch_id")).alias("patches"))
    return lists.select(F.to_json(F.struct(F.col("ts_text").alias("ts"), "patches")).alias("value"))


def write_index_json(active: DataFrame, path: str) -> None:
    index_json(active).write.mode("overwrite").text(path)


def write_partitioned(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Parquet by partition columns; partitions that come again are replaced, the others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def append_new(rows: DataFrame, existing: DataFrame | None, path: str, keys: list[str]) -> DataFrame:
    """Append only rows whose keys aren't there yet; returns counts of new and skipped rows by the first key."""
    marked = rows if existing is None else rows.join(existing.select(*keys).distinct().withColumn("there", F.lit(True)), keys, "left")
    marked = marked if existing is not None else marked.withColumn("there", F.lit(None).cast("boolean"))
    marked.where("there IS NULL").drop("there").write.mode("append").parquet(path)
    return marked.groupBy(keys[0]).agg(F.count_if(F.col("there").isNull()).alias("new"), F.count_if(F.col("there").isNotNull()).alias("skipped"))


def sequence_rows(step_positions: DataFrame, past: int, future: int, step_minutes: int) -> DataFrame:
    """One row a reference with list cells idx_t-.. to idx_t+..; (slot, patch_id, step, pos) in."""
    name = lambda k: f"idx_t{'' if k < 0 else '+' if k else ''}{k * step_minutes}" if k else "idx_t0"
    lists = step_positions.groupBy("slot", "step").agg(F.array_sort(F.collect_list(F.struct("patch_id", "pos"))).alias("x")).select("slot", "step", F.to_json(F.transform("x", lambda s: s["pos"])).alias("cell"))
    wide = lists.groupBy("slot").pivot("step", list(range(-past, future + 1))).agg(F.first("cell"))
    patches = step_positions.groupBy("slot").agg(F.to_json(F.array_sort(F.collect_set("patch_id"))).alias("patch_numbers"))
    return patches.join(wide, "slot").select("slot", "patch_numbers", *[F.col(str(k)).alias(name(k)) for k in range(-past, future + 1)])


def write_named_files(rows: DataFrame, path: str) -> DataFrame:
    """A file for each row (name, content), with the name given, written where the row is; returns (name, bytes) of what was written.

    A file goes to a temporary name first and is renamed when complete, so that a repeated task does no harm.
    """
    import uuid

    import pyarrow as pa

    def run(batches):
        from pyarrow import fs

        disk, top = fs.FileSystem.from_uri(path)
        for batch in batches:
            names, contents = batch.column("name").to_pylist(), batch.column("content").to_pylist()
            for name, content in zip(names, contents):
                target = f"{top}/{name}"
                disk.create_dir(target.rsplit("/", 1)[0], recursive=True)
                part = f"{target.rsplit('/', 1)[0]}/_{uuid.uuid4().hex}.tmp"
                with disk.open_output_stream(part, compression=None) as out:
                    out.write(content.encode())
                disk.move(part, target)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([len(c.encode()) for c in contents], pa.int64())], ["name", "bytes"])

    written = rows.select("name", "content").mapInArrow(run, "name string, bytes long")
    written.write.mode("overwrite").parquet(f"{path}/_written")
    return rows.sparkSession.read.schema("name string, bytes long").parquet(f"{path}/_written")


def write_training_store(samples: DataFrame, path: str, split: str = "split") -> None:
    """Samples by split, and beside them one line of JSON with number, columns and types of each split."""
    write_partitioned(samples, f"{path}/samples", [split])
    kinds = F.map_from_arrays(F.array(*[F.lit(c) for c, _ in samples.dtypes if c != split]), F.array(*[F.lit(t) for c, t in samples.dtypes if c != split]))
    found = samples.sparkSession.read.parquet(f"{path}/samples").groupBy(split).agg(F.count(F.lit(1)).alias("n"))
    found.select(F.to_json(F.struct(F.col(split).alias("split"), "n", kinds.alias("columns"))).alias("value")).write.mode("overwrite").text(f"{path}/metadata")


def write_report(rows: DataFrame, path: str, keys: list[str]) -> None:
    """A JSON object for each group of keys, with the further columns as lists in their order."""
    rest = [c for c in rows.columns if c not in keys]
    lists = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("rows"))
    lists.select(F.to_json(F.struct(*keys, *[F.col("rows")[c].alias(c) for c in rest])).alias("value")).write.mode("overwrite").text(path)


def write_bundle(classified: DataFrame, path: str, is_zero: str = "is_zero") -> None:
    """Patches with content and the places of empty ones, apart."""
    classified.where(~F.col(is_zero)).drop(is_zero).write.mode("overwrite").parquet(f"{path}/patches")
    classified.where(F.col(is_zero)).select("frame", "patch_id").write.mode("overwrite").parquet(f"{path}/zero_patches")


def consolidate_days(store: DataFrame, path: str, day: str = "date", file: str = "file") -> DataFrame:
    """All days of each variable in one place, with where it comes from: (variable, days, files, total), counted from what was written."""
    store.write.mode("overwrite").partitionBy("variable").parquet(path)
    return store.sparkSession.read.parquet(path).groupBy("variable").agg(F.countDistinct(day).alias("days"), F.countDistinct(file).alias("files"), F.count(F.lit(1)).alias("total"))


def stitch_json(stitched: DataFrame) -> DataFrame:
    """(oid, dt, value): a JSON object for each box and step, with found and zero cells counted and the missing ones listed in order."""
    n = lambda s: F.count_if(F.col("status") == s)
    lists = stitched.groupBy("oid", "dt").agg(n("patch").alias("found"), n("zero").alias("zeros"), F.array_sort(F.collect_list(F.when(F.col("status") == "missing", F.struct("i", "j")))).alias("missing"))
    return lists.select("oid", "dt", F.to_json(F.struct("found", "zeros", "missing")).alias("value"))


def append_variables(rows: DataFrame, path: str, keys: list[str], variables: list[str]) -> None:
    """New variables beside those of a store, one partition each; what is there isn't rewritten, a variable that comes again is replaced."""
    long = rows.select(*keys, F.explode(F.map_from_arrays(F.array(*map(F.lit, variables)), F.array(*variables))).alias("variable", "value"))
    write_partitioned(long.where("value IS NOT NULL"), path, ["variable"])
