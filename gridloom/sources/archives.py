"""Folders of files and zip archives as one table of members, members read in parallel, and readers for times and ranges.

An archive's list of members stands at its end, so that a task reads only that of a file; each member is then a row of its own,
dealt to any task, which reads and unpacks just the bytes of that member.
"""

from __future__ import annotations

import struct
import sys
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MEMBERS = "path string, member string, start long, packed long, size long, method int, crc long, error string"
_KINDS = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
#: Fixed values of the format: length of a member's own header, and where its name's and extra field's lengths stand in it.
HEADER, LENGTHS = 30, 26


def _opened(path: str):
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    disk, name = fs.FileSystem.from_uri(f"file:///{rest.lstrip('/')}" if scheme == "file" else path)
    return disk.open_input_file(name)


class _Seekable:
    """An open file that says so when a place before its begin is asked for, as ``zipfile`` expects of short archives."""

    def __init__(self, file):
        self.file, self.read, self.tell = file, file.read, file.tell

    def seekable(self) -> bool:
        return True

    def seek(self, at: int, whence: int = 0) -> int:
        at += (0, self.file.tell(), self.file.size())[whence]
        if at < 0:
            raise OSError("before the begin of the file")
        return self.file.seek(at)


def members(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """MEMBERS below ``path``: of zip archives their members, other files as one member with a null name of themselves. An
    archive that can't be read is one row with ``error``. Contents aren't read here."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length")
    own = files.where(~F.lower("path").endswith(".zip"))
    plain = own.select("path", F.lit(None).cast("string").alias("member"), F.lit(0).cast("long").alias("start"), F.col("length").alias("packed"), F.col("length").alias("size"), F.lit(0).alias("method"), F.lit(None).cast("long").alias("crc"), F.lit(None).cast("string").alias("error"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("path").to_pylist():
                try:
                    with _opened(name) as file, zipfile.ZipFile(_Seekable(file)) as archive:
                        rows = [(name, m.filename, m.header_offset, m.compress_size, m.file_size, m.compress_type, m.CRC, None) for m in archive.infolist() if not m.is_dir()]
                except Exception as wrong:  # a row, not a failed job
                    rows = [(name, None, None, None, None, None, None, f"{type(wrong).__name__}: {wrong}"[:300])]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], [c.split()[0] for c in MEMBERS.split(", ")])

    return plain.union(files.where(F.lower("path").endswith(".zip")).select("path").mapInArrow(run, MEMBERS))


def read_members(found: DataFrame, carry: list[str] = (), parts: int | None = None) -> DataFrame:
    """(path, member, the columns in ``carry``, content, error) of the members in ``found``, dealt out anew so that the members of one large archive
    are read by many tasks. A member that is damaged, or packed by a method other than deflate, has an ``error`` and no content."""
    keys = ["path", "member", "start", "packed", "size", "method", "crc", "error"]
    spread = found.select(*keys, *carry).repartition(*([parts] if parts else []), "path", "member")

    def content(path: str, member: str | None, start: int, packed: int, size: int, method: int, crc: int | None) -> bytes:
        with _opened(path) as file:
            if member is not None:
                file.seek(start)
                head = file.read(HEADER)
                if head[:4] != b"PK\x03\x04":
                    raise ValueError("no member begins here")
                start += HEADER + sum(struct.unpack("<HH", head[LENGTHS : LENGTHS + 4]))
            file.seek(start)
            data = file.read(packed)
        if method not in (0, 8):
            raise ValueError(f"packing method {method}")
        data = zlib.decompress(data, -15) if method == 8 else data
        if len(data) != size or (crc is not None and zlib.crc32(data) != crc):
            raise ValueError("the content does not have the size and checksum that the archive says")
        return data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in keys}
            for k in range(batch.num_rows):
                row = [columns[c][k] for c in keys]
                data, wrong = None, row[-1]
                if wrong is None:
                    try:
                        data = content(*row[:-1])
                    except Exception as e:  # a row, not a failed job
                        wrong = f"{type(e).__name__}: {e}"[:300]
                one = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([one.column("path"), one.column("member"), *(one.column(c) for c in carry), pa.array([data], pa.binary()), pa.array([wrong], pa.string())], ["path", "member", *carry, "content", "error"])

    schema = spread.select("path", "member", *carry).schema.add("content", "binary").add("error", "string")
    return spread.mapInArrow(run, schema)


def write_archives(rows: DataFrame, path: str) -> DataFrame:
    """A zip archive for each ``name`` of (name, member, content), written by the task that has all its members, under a temporary
    name until it is complete; returns (name, members, bytes). An archive is written member by member, not held in memory."""
    placed = rows.select("name", "member", F.col("content").cast("binary").alias("content")).repartition("name").sortWithinPartitions("name", "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        disk, top = fs.FileSystem.from_uri(path)
        done, current, sink, archive, part, count = [], None, None, None, None, 0

        def finish() -> None:
            if current is None:
                return
            archive.close(), sink.close()
            disk.move(part, f"{top}/{current}")
            done.append((current, count, disk.get_file_info(f"{top}/{current}").size))

        for batch in batches:
            for name, member, data in zip(*(batch.column(c).to_pylist() for c in ("name", "member", "content"))):
                if name != current:
                    finish()
                    current, count = name, 0
                    folder = f"{top}/{name}".rsplit("/", 1)[0]
                    disk.create_dir(folder, recursive=True)
                    part = f"{folder}/_{uuid.uuid4().hex}.tmp"
                    sink = disk.open_output_stream(part, compression=None)
                    archive = zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED)
                archive.writestr(member, data)
                count += 1
        finish()
        columns = list(zip(*done)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64()))], ["name", "members", "bytes"])

    placed.mapInArrow(run, "name string, members long, bytes long").write.mode("overwrite").parquet(f"{path}/_written")
    return rows.sparkSession.read.parquet(f"{path}/_written")


def requested(spark: SparkSession, when: int | list[int] | tuple[int, int], interval: int = 300, inclusive: bool = False) -> DataFrame:
    """The times (t) that a reader is asked for: one, a list of them, or a range (first, end) at an interval, its end left out
    unless ``inclusive``. Times are epoch seconds."""
    if isinstance(when, tuple):
        return spark.range(when[0], when[1] + (1 if inclusive else 0), interval).select(F.col("id").alias("t"))
    times = when if isinstance(when, list) else [when]
    return spark.createDataFrame([(t,) for t in dict.fromkeys(times)], "t long")


def members_for_times(found: DataFrame, second: Column, times: DataFrame, interval: int) -> DataFrame:
    """The members (t, s and the columns of ``found``) whose time lies in [t - interval, t), for each asked t: joined by buckets of an interval."""
    dated = found.withColumn("s", second).where("s IS NOT NULL").withColumn("bucket", F.floor(F.col("s") / interval))
    near = times.select("t").distinct().withColumn("bucket", F.explode(F.array(F.floor(F.col("t") / interval), F.floor(F.col("t") / interval) - 1)))
    return dated.join(near, "bucket").where((F.col("s") >= F.col("t") - interval) & (F.col("s") < F.col("t"))).drop("bucket")
