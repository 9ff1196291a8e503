"""Language-model scores by stupid backoff, computed relationally.

Count tables of 1-, 2- and 3-grams are partitioned by hash; the n-grams of documents are looked up
in them by a join, and log scores are summed per document. To keep the shuffle small, n-grams travel
as sorted blocks: a block of documents sends each of its distinct n-grams once, with its count
there, to the n-gram's partition, and gets the corpus count back. That is also the combine before
the shuffle, so a frequent n-gram has one entry a block.

A document is scored against all other rows: its own occurrences are taken off every count. A
word's score is c(abc)/c(ab) if c(abc) > 0, else ALPHA * c(bc)/c(b), else ALPHA**2 * c(c)/n, else
ALPHA**3 / n for a word that no other row has; at the start of a document the longest context there is counts as unpenalised.

Defined results: words are split at blanks and U+0009 to U+000D after lower-casing A-Z; a text without words has
n_words 0, lm_sum 0 and a null mean; repeated rows are different rows, and so know each other's
n-grams; a single row in a table sees an empty corpus; other columns are ignored. The input must
come in the same order when it is read again, as tables do; otherwise the job fails, without a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import mixed, word_hashes

ALPHA = 0.4
ORDER = 3
#: Bytes of text that make a block, and bytes of text for which the count tables get a partition.
BLOCK_BYTES, TEXT_BYTES = 6 << 20, 8 << 20
_STEP = np.uint64(0xD6E8FEB86659FD93)


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """The row of each word; for every order the hashes of n-grams and the positions where they end."""
    coded = [(t or "").encode().lower() for t in texts]
    h, start = word_hashes(b"\n".join(coded))
    row = np.searchsorted(np.cumsum([len(c) + 1 for c in coded]), start, side="right") if coded else np.zeros(0, np.int64)
    hashes, at = [h], [np.arange(len(h))]
    for order in range(2, ORDER + 1):
        end = at[-1][1:][row[at[-1][1:] - order + 1] == row[at[-1][1:]]] if len(at[-1]) else at[-1]
        shorter = np.zeros(len(h), np.uint64)
        shorter[at[-1]] = hashes[-1]
        hashes.append(mixed(shorter[end - 1] * _STEP + h[end] + np.uint64(order)))
        at.append(end)
    return row, hashes, at


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list[str | None]]]:
    """Number, ids and texts of blocks of about BLOCK_BYTES, numbered within all partitions."""
    ids, texts, size, number = [], [], 0, TaskContext.get().partitionId() << 32
    for batch in batches:
        for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            ids.append(key), texts.append(text)
            size += len(text or "") + 1
            if size >= BLOCK_BYTES:
                yield number, ids, texts
                ids, texts, size, number = [], [], 0, number + 1
    if ids:
        yield number, ids, texts


def packed(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as differences by byte planes, compressed."""
    steps = np.diff(values, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def squeezed(counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def spread(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.int64)


def seal(texts: list[str | None]) -> int:
    """Tells whether a block holds the same texts when it is read again."""
    import zlib

    crc = 0
    for t in texts:
        crc = zlib.crc32((t or "").encode() + b"\0", crc)
    return crc


def block_scores(texts: list[str | None], totals: list[np.ndarray], n_corpus: int) -> dict[str, np.ndarray]:
    """Sums per row of a block; totals: corpus counts of the block's distinct n-grams, in sorted order."""
    row, hashes, at = ngrams(texts)
    n, rows = len(row), len(texts)
    count = np.zeros((ORDER, n))
    for order, (h, end) in enumerate(zip(hashes, at)):
        if len(h):
            _, place = np.unique(h, return_inverse=True)
            _, own, times = np.unique(row[end] * (place.max() + 1) + place, return_inverse=True, return_counts=True)
            count[order, end] = totals[order][place] - times[own]
    words = np.bincount(row, minlength=rows)
    rest = np.maximum(n_corpus - words, 1)[row] if n else np.zeros(0)
    first = np.concatenate([[0], np.cumsum(words)])[row] if n else np.zeros(0, np.int64)
    context = np.minimum(np.arange(n) - first, ORDER - 1)  # words before, as far as they count
    score, used = np.log(1 / rest) + np.log(ALPHA), np.full(n, -1)
    for order in range(ORDER):
        seen = (count[order] > 0) & (context >= order)
        below = rest if order == 0 else np.concatenate([[1.0], count[order - 1, :-1]])
        score[seen] = np.log(count[order, seen] / below[seen])
        used[seen] = order
    score += (context - np.maximum(used, 0)) * np.log(ALPHA)
    out = {"n_words": words, "lm_sum": np.bincount(row, score, minlength=rows)}
    for order, name in enumerate(("n_unseen", "n_unigram", "n_bigram", "n_trigram")):
        out[name] = np.bincount(row[used == order - 1], minlength=rows)
    return out


def score(documents: DataFrame) -> DataFrame:
    """n_words, lm_sum, lm_mean and how many words each order scored, for every row of ``documents``."""
    texts = documents.select("doc_id", "text")
    counted = texts.agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.size(F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))).alias("words")).first()
    n_corpus = int(counted.words or 0)
    bits = max(6, int(counted.bytes or 0).bit_length() - TEXT_BYTES.bit_length() + 1)
    parts = 1 << bits

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, block in blocks(batches):
            mark = seal(block)
            for order, h in enumerate(ngrams(block)[1]):
                keys, counts = np.unique(h, return_counts=True)
                edges = np.searchsorted(keys >> np.uint64(64 - bits), np.arange(parts + 1))
                full = np.flatnonzero(np.diff(edges))
                if len(full):
                    parts_of = [(packed(keys[edges[p] : edges[p + 1]]), squeezed(counts[edges[p] : edges[p + 1]])) for p in full]
                    k = len(full)
                    yield pa.RecordBatch.from_arrays([pa.array([number] * k), pa.array([mark] * k), pa.array([order] * k, pa.int32()), pa.array(full.astype(np.int32)), pa.array([x for x, _ in parts_of]), pa.array([x for _, x in parts_of])], ["block", "seal", "ord", "part", "keys", "counts"])

    def count(table: pa.Table) -> pa.Table:
        keys = [unpacked(x.as_py()) for x in table.column("keys")]
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(place, np.concatenate([spread(x.as_py()) for x in table.column("counts")])).astype(np.int64)[place]
        edges = np.cumsum([0, *map(len, keys)])
        found = pa.array([squeezed(totals[a:b]) for a, b in zip(edges[:-1], edges[1:])], pa.binary())
        return pa.table([table.column(c) for c in ("block", "seal", "ord", "part")] + [found], names=["block", "seal", "ord", "part", "totals"])

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, block in blocks(batches):
            sink = pa.BufferOutputStream()
            held = pa.table([pa.array(ids, documents_id), pa.array(block, pa.string())], names=["doc_id", "text"])
            with pa.ipc.new_stream(sink, held.schema) as stream:
                stream.write_table(held)
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([zstandard.ZstdCompressor(level=9).compress(sink.getvalue().to_pybytes())])], ["block", "held"])

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        parts_out = []
        for blob in left.column("held"):
            held = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob.as_py())).read_all()
            block = held.column("text").to_pylist()
            if right.num_rows and set(right.column("seal").to_pylist()) != {seal(block)}:
                raise RuntimeError("documents came in another order when they were read again")
            rows = sorted(zip(right.column("ord").to_pylist(), right.column("part").to_pylist(), range(right.num_rows)))
            totals = [np.concatenate([np.zeros(0, np.int64), *(spread(right.column("totals")[k].as_py()) for o, _, k in rows if o == order)]) for order in range(ORDER)]
            sums = block_scores(block, totals, n_corpus)
            parts_out.append(pa.table([held.column("doc_id"), *(pa.array(sums[c].astype(np.float64 if c == "lm_sum" else np.int64)) for c in names)], names=["doc_id", *names]))
        return pa.concat_tables(parts_out) if parts_out else empty

    from pyspark.sql.pandas.types import to_arrow_type

    kind = documents.schema["doc_id"].dataType
    documents_id = to_arrow_type(kind)
    names = ["n_words", "lm_sum", "n_unseen", "n_unigram", "n_bigram", "n_trigram"]
    empty = pa.table([pa.array([], documents_id), *(pa.array([], pa.float64() if c == "lm_sum" else pa.int64()) for c in names)], names=["doc_id", *names])
    sent = texts.mapInArrow(send, "block long, seal long, ord int, part int, keys binary, counts binary")
    replies = sent.groupBy("ord", "part").applyInArrow(count, "block long, seal long, ord int, part int, totals binary")
    held = texts.mapInArrow(hold, "block long, held binary")
    scored = held.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(add_up, f"doc_id {kind.simpleString()}, n_words long, lm_sum double, n_unseen long, n_unigram long, n_bigram long, n_trigram long")
    return scored.select("doc_id", "n_words", "lm_sum", F.when(F.col("n_words") > 0, F.col("lm_sum") / F.col("n_words")).alias("lm_mean"), *names[2:])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumns({"lm_sum": F.round("lm_sum", 3), "lm_mean": F.round("lm_mean", 6)})


SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\x0c\r]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, i, ws[i] AS c, CASE WHEN i > 1 THEN ws[i-1] END AS b, CASE WHEN i > 2 THEN ws[i-2] END AS a FROM w, unnest(range(1, len(ws) + 1)) AS t(i)),
o1 AS (SELECT doc_id, c, count(*) AS n FROM p GROUP BY ALL), t1 AS (SELECT c, sum(n) AS n FROM o1 GROUP BY ALL),
o2 AS (SELECT doc_id, b, c, count(*) AS n FROM p WHERE i > 1 GROUP BY ALL), t2 AS (SELECT b, c, sum(n) AS n FROM o2 GROUP BY ALL),
o3 AS (SELECT doc_id, a, b, c, count(*) AS n FROM p WHERE i > 2 GROUP BY ALL), t3 AS (SELECT a, b, c, sum(n) AS n FROM o3 GROUP BY ALL),
l AS (SELECT doc_id, len(ws) AS n_words, greatest((SELECT sum(len(ws)) FROM w) - len(ws), 1) AS rest FROM w),
k AS (SELECT p.doc_id, p.i, l.rest, t1.n - o1.n AS c1, t2.n - o2.n AS c2, t3.n - o3.n AS c3, lag(t1.n - o1.n) OVER d AS d1, lag(t2.n - o2.n) OVER d AS d2
  FROM p JOIN l USING (doc_id) JOIN o1 ON o1.doc_id = p.doc_id AND o1.c = p.c JOIN t1 ON t1.c = p.c
  LEFT JOIN o2 ON o2.doc_id = p.doc_id AND o2.b = p.b AND o2.c = p.c LEFT JOIN t2 ON t2.b = p.b AND t2.c = p.c
  LEFT JOIN o3 ON o3.doc_id = p.doc_id AND o3.a = p.a AND o3.b = p.b AND o3.c = p.c LEFT JOIN t3 ON t3.a = p.a AND t3.b = p.b AND t3.c = p.c
  WINDOW d AS (PARTITION BY p.doc_id ORDER BY p.i)),
s AS (SELECT doc_id, CASE WHEN c3 > 0 THEN 3 WHEN c2 > 0 THEN 2 WHEN c1 > 0 THEN 1 ELSE 0 END AS used, least(i - 1, 2) AS context, c1, c2, c3, d1, d2, rest FROM k),
v AS (SELECT doc_id, used, ln(CASE used WHEN 3 THEN c3 / d2 WHEN 2 THEN c2 / d1 WHEN 1 THEN c1 / rest ELSE 0.4 / rest END) + (context - greatest(used - 1, 0)) * ln(0.4) AS x FROM s)
SELECT l.doc_id, any_value(l.n_words) AS n_words, round(coalesce(sum(x), 0), 3) AS lm_sum, round(sum(x) / nullif(any_value(l.n_words), 0), 6) AS lm_mean,
  count(*) FILTER (used = 0) AS n_unseen, count(*) FILTER (used = 1) AS n_unigram, count(*) FILTER (used = 2) AS n_bigram, count(*) FILTER (used = 3) AS n_trigram
FROM l LEFT JOIN v USING (doc_id) GROUP BY l.doc_id
"""
