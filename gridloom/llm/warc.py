"""WARC: a deterministic sharded writer, and a reader.

Records are put in the order of page_id. A running sum of payload sizes over that order cuts it into
shards, so that shards depend on the rows alone and not on how Spark happened to split them. Each
task writes its shards record by record as gzip members, rolls files by their compressed size,
regenerates headers and digests, writes under temporary names and renames what is complete. The
manifest, written last by Spark's committer, is the commit: readers read only files it names,
so that leftovers of lost tasks are harmless.

Of records with equal payloads of at least ``REVISIT_BYTES`` bytes, that with the smallest page_id is
the response; the others are revisit records that refer to it.

Defined results: null html is an empty payload; a null url is written as ``urn:none``; rows with equal
page_id and payload come next to each other and the later ones revisit the first; a null page_id comes
first; an empty table makes an empty manifest; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import cut_lineage, shared_dir

REVISIT_BYTES = 100
#: Payload bytes of a shard, and the least number of shards, for parallel writing of small tables.
SHARD_BYTES, MIN_SHARDS = 512 << 20, 64
#: Compressed bytes after which a file is closed and the next begun.
ROLL_BYTES = 64 << 20
#: What headers add to a payload, in the sums that cut shards.
OVERHEAD = 512
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_FIRST = -(2**63)


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record as a gzip member, the same bytes for the same arguments."""
    block = _HTTP if revisit else _HTTP + payload
    head = [
        "WARC/1.0",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._') if url else 'urn:none'}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {'' if refers_to is None else refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(head).encode() + block + b"\r\n\r\n", 6, mtime=0)


def shard_starts(narrow: DataFrame, shard_bytes: int, min_shards: int) -> np.ndarray:
    """The first page_id of every shard after the first; one number a shard goes to the driver."""
    parts = max(8, int(narrow.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = narrow.select(F.coalesce("page_id", F.lit(_FIRST)).alias("page_id"), (F.col("n") + OVERHEAD).alias("cost"))
    ordered = cut_lineage(ordered.groupBy("page_id").agg(F.sum("cost").alias("cost")).repartitionByRange(parts, "page_id").sortWithinPartitions("page_id").withColumn("part", F.spark_partition_id()))
    sums = {r.part: r.cost for r in ordered.groupBy("part").agg(F.sum("cost").alias("cost")).collect()}
    total = sum(sums.values())
    each = max(1, min(shard_bytes, -(-total // min_shards)))
    before = dict(zip(sorted(sums), np.cumsum([0, *(sums[k] for k in sorted(sums))]).tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if done is None:
                done = before[batch.column("part")[0].as_py()]
            ends = done + np.cumsum(batch.column("cost").to_numpy())
            begins = np.concatenate([[done], ends[:-1]])
            new = (ends - 1) // each > (begins - 1) // each if done else np.concatenate([[False], (ends[1:] - 1) // each > (begins[1:] - 1) // each])
            done = int(ends[-1])
            yield pa.RecordBatch.from_arrays([batch.column("page_id").filter(pa.array(new))], ["page_id"])

    return np.array(sorted(r.page_id for r in ordered.mapInArrow(run, "page_id long").collect()), np.int64)


def write(pages: DataFrame, path: str, shard_bytes: int = SHARD_BYTES, min_shards: int = MIN_SHARDS, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write the archives below ``path`` and return the manifest: name, shard, seq, bytes, records, sha256."""
    spark = pages.sparkSession
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", body.alias("html"), F.sha2(body, 256).alias("digest"))
    narrow = cut_lineage(rows.select("page_id", "digest", F.octet_length("html").cast("long").alias("n")))
    first = narrow.where(F.col("n") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    revisits = narrow.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).select("page_id", "digest", "first").distinct()
    starts = shard_starts(narrow, shard_bytes, min_shards)

    @F.pandas_udf("int")
    def shard_of(page_id: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(starts, page_id.to_numpy(), side="right").astype(np.int32))

    both = rows.select("page_id", "digest", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("first"), "url", "html").union(
        revisits.select("page_id", "digest", F.lit(0), "first", F.lit(None).cast("string"), F.lit(None).cast("string"))
    )
    both = both.withColumn("shard", shard_of(F.coalesce("page_id", F.lit(_FIRST))))
    parts = max(1, min(len(starts) + 1, 4096))
    both = both.repartitionById(parts, F.floor(F.col("shard").cast("long") * parts / (len(starts) + 1)).cast("int")).sortWithinPartitions("shard", "page_id", "digest", "kind", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        disk, top = fs.FileSystem.from_uri(path)
        disk.create_dir(f"{top}/data", recursive=True)
        tag, out, sink, current = uuid.uuid4().hex, [], None, {}
        before, refers, revisit = None, None, False

        def close() -> None:
            nonlocal sink
            if sink is not None:
                sink.close()
                disk.move(current["tmp"], f"{top}/data/{current['name']}")
                out.append((current["name"], current["shard"], current["seq"], current["bytes"], current["records"], current["hash"].hexdigest()))
                sink = None

        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "digest", "kind", "first", "url", "html", "shard"))):
                page_id, digest, kind, first_id, url, html, shard = (x.as_py() for x in row)
                key = (page_id, digest)
                if not kind:
                    before, refers, revisit = key, first_id, True
                    continue
                payload = html.encode()
                if key != before:
                    refers, revisit = None, False
                data = record(page_id, url, payload, digest, refers, revisit)
                if not revisit and len(payload) >= REVISIT_BYTES:
                    refers, revisit = page_id, True  # for repeated rows
                before = key
                if sink is not None and (current["shard"] != shard or current["bytes"] >= roll_bytes):
                    close()
                if sink is None:
                    seq = current["seq"] + 1 if current.get("shard") == shard else 0
                    current = {"shard": shard, "seq": seq, "name": f"part-{shard:07d}-{seq:05d}.warc.gz", "bytes": 0, "records": 0, "hash": hashlib.sha256()}
                    current["tmp"] = f"{top}/data/_{tag}-{current['name']}.tmp"
                    sink = disk.open_output_stream(current["tmp"])
                sink.write(data)
                current["hash"].update(data)
                current["bytes"] += len(data)
                current["records"] += 1
        close()
        columns = list(zip(*out)) or [()] * 6
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["name", "shard", "seq", "bytes", "records", "sha256"])

    both.mapInArrow(run, "name string, shard int, seq int, bytes long, records long, sha256 string").write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def members(source, step: int = 1 << 16) -> Iterator[bytes]:
    """The gzip members of an open file, decompressed one by one."""
    rest = source.read(step)
    while rest:
        unzip, got = zlib.decompressobj(31), []
        while not unzip.eof:
            if not rest and not (rest := source.read(step)):
                raise ValueError("a WARC file ends within a record")
            got.append(unzip.decompress(rest))
            rest = unzip.unused_data
        yield b"".join(got)
        rest = rest or source.read(step)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record; raises where a digest doesn't match."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    if "sha256:" + hashlib.sha256(block).hexdigest() != headers["WARC-Block-Digest"]:
        raise ValueError(f"block digest of {headers['WARC-Record-ID']}")
    payload = block.partition(b"\r\n\r\n")[2]
    if headers["WARC-Type"] == "response" and "sha256:" + hashlib.sha256(payload).hexdigest() != headers["WARC-Payload-Digest"]:
        raise ValueError(f"payload digest of {headers['WARC-Record-ID']}")
    return headers, payload


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records of the files that the manifest names: page_id, url, payload_bytes, payload_digest, record_type,
    refers_to and the payload (empty for revisits)."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    names = spark.read.parquet(f"{path}/manifest").select("name")
    files = names.repartition(max(1, min(4096, names.count())))  # names only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [f.split()[0] for f in schema.split(", ")])

        from pyarrow import fs

        disk, top = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows, held = [], 0
                with disk.open_input_stream(f"{top}/data/{name}", compression=None) as source:
                    for data in members(source):
                        head, payload = parse(data)
                        number = lambda k, head=head: int(head[k]) if head.get(k) else None
                        rows.append((number("X-Page-Id"), head["WARC-Target-URI"], int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha256:"), head["WARC-Type"], number("X-Refers-To-Page-Id"), payload if with_payload else None))
                        held += len(payload)
                        if len(rows) >= 2000 or held > 16 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return files.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = os.path.join(shared_dir(spark), f"warc-{uuid.uuid4().hex}")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read(spark, path, with_payload=False).drop("url", "payload")


SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS s FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY s) AS m, row_number() OVER (PARTITION BY s ORDER BY page_id NULLS LAST) AS k FROM p)
SELECT page_id, n AS payload_bytes, s AS payload_digest,
  CASE WHEN n >= {REVISIT_BYTES} AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {REVISIT_BYTES} AND k > 1 THEN m END AS refers_to
FROM q
"""
