"""Stores with a commit log: numbered manifests, readers that see one version, appends that skip what is there.

A version is a manifest ``_log/<number>.json`` that names the folders of data which belong to it. A writer writes its rows
to a new folder first and then creates the next manifest, which succeeds only if nobody has created that number (the file
system must be able to create a file unless it exists, as HDFS and local disks are). Otherwise it looks at what the other
writers have added, takes out rows whose keys they have, and tries the next number. A job that ends between writing and
committing leaves a folder that no manifest names.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(Exception):
    """Other writers were faster, as often as a writer was willing to try."""


@dataclass(frozen=True)
class Added:
    """What an append did: the version that holds its rows (or the latest, if there was nothing new), and the counts by the first key."""

    version: int
    counts: DataFrame


class Versions:
    """A store below ``path``, whose rows have ``keys`` that tell them apart."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str]):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, keys
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._files = self._hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _name(self, number: int):
        return self._hadoop.Path(f"{self.path}/_log/{number:012d}.json")

    def latest(self) -> int:
        """The newest version; 0 before the first."""
        log = self._hadoop.Path(f"{self.path}/_log")
        if not self._files.exists(log):
            return 0
        return max((int(f.getPath().getName()[:-5]) for f in self._files.listStatus(log) if f.getPath().getName().endswith(".json")), default=0)

    def folders(self, version: int) -> list[str]:
        """The folders of a version, oldest first."""
        if version == 0:
            return []
        stream = self._files.open(self._name(version))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())["folders"]
        finally:
            stream.close()

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{f}" for f in folders])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of one version, whatever is committed meanwhile."""
        return self._read(self.folders(self.latest() if version is None else version))

    def _commit(self, number: int, folders: list[str]) -> bool:
        """Creates the manifest of a version, unless it is there. Its content appears as a whole: it is written under another name first."""
        part = self._hadoop.Path(f"{self.path}/_log/_{uuid.uuid4().hex}")
        out = self._files.create(part, False)
        out.write(bytearray(json.dumps({"folders": folders}).encode()))
        out.close()
        context = self._hadoop.FileContext.getFileContext(self._files.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(part, self._name(number), none)  # fails where the target exists
            return True
        except Exception as wrong:
            self._files.delete(part, False)
            if "FileAlreadyExists" in str(wrong) or "already exists" in str(wrong):
                return False
            raise

    def _missing(self, rows: DataFrame, there: DataFrame) -> DataFrame:
        same = [rows[k].eqNullSafe(there[k]) for k in self.keys]
        return rows.join(there.select(*self.keys), same, "leftanti")

    def append(self, rows: DataFrame, tries: int = 10) -> Added:
        """Adds the rows whose keys the store doesn't have; of rows that share their keys one is taken."""
        rows = rows.select(*self.schema.names)
        seen = self.latest()
        folders, own = self.folders(seen), None
        offered = rows.groupBy(self.keys[0]).agg(F.countDistinct(F.struct(*self.keys)).alias("offered"))
        source, since = rows.dropDuplicates(self.keys), folders
        for _ in range(tries):
            fresh = self._missing(source, self._read(since))
            own = uuid.uuid4().hex
            fresh.write.parquet(f"{self.path}/data/{own}")
            source = self._read([own])
            if source.isEmpty():
                return Added(seen, self._counts(offered, source))
            if self._commit(seen + 1, [*folders, own]):
                return Added(seen + 1, self._counts(offered, source))
            # Someone else was first: only what was added since is looked at.
            seen = self.latest()
            newer = self.folders(seen)
            folders, since = newer, [f for f in newer if f not in set(folders)]
        raise Conflict(f"{tries} tries to append to {self.path}")

    def _counts(self, offered: DataFrame, fresh: DataFrame) -> DataFrame:
        key = self.keys[0]
        new = fresh.groupBy(F.col(key).alias("key_")).agg(F.count(F.lit(1)).alias("new"))
        both = offered.join(new, F.col(key).eqNullSafe(F.col("key_")), "left")
        return both.select(key, F.coalesce("new", F.lit(0).cast("long")).alias("new"), (F.col("offered") - F.coalesce("new", F.lit(0))).alias("skipped"))
