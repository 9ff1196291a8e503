"""Packing by cutting-stock column generation.

Documents are tokenized once, where they are read; what is longer than a sequence is cut into full
sequences and a rest. Lengths are counted in units of ``UNIT`` tokens, which makes a histogram of
at most 256 classes. On that histogram alone the driver solves the cutting-stock problem: the
linear program over patterns is improved by columns that a knapsack dynamic program prices, the
optimum is rounded down, and what is left over goes best-fit into further patterns. The pieces of a
class are ranked by distributed counting, and a piece's rank says which pattern, sequence and place
it takes.

Defined results: a null text is empty and has its end token alone; rows are packed each, also
repeated ones; a very long text is encoded as a whole and cut, also one of white space alone; an empty table gives no rows;
null doc_ids are packed like others; other columns are ignored. The counts that are broadcast are at most CLASSES x MOST_SPREAD rows.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import cut_lineage, with_columns

LENGTH, UNIT, END = 2048, 8, 1
CLASSES = LENGTH // UNIT
#: The special token that byte_bpe_50k.json finds in texts.
SPECIAL = {"<|endoftext|>": 50256}
#: Groups in which a class is ranked, so that a frequent length doesn't fill one task: at least, at most, and pieces for each.
SPREAD, MOST_SPREAD, SPREAD_PIECES = 64, 4096, 100_000
#: A linear program is left when its bound shows that at most this share can still be gained.
GAP = 2e-3


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str, special: bool = False):
    """The ids of byte_bpe_50k.json: the same vocabulary and pattern, in the faster of the two libraries.

    special: equal to tokenizers as it is, where a special string in a text is its own id; otherwise equal to
    tokenizers with encode_special_tokens (special strings in a text are ordinary text).
    """
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL if special else {})


def plain_encoder(special: bool = False):
    """The same ids by the other library, which reads runs of white space of any length."""
    import public_tokenizers
    import tokenizers

    code = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    code.encode_special_tokens = not special
    return code


def pieces_of(documents: DataFrame, path: str | None = None, length: int = LENGTH, special: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, salt), one row a piece."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, plain = encoder(path, special), None
        for batch in batches:
            at, start, size, crc, total = [], [], [], [], []
            for k, text in enumerate(batch.column("text")):
                try:
                    ids = np.frombuffer(code.encode_to_numpy(text.as_py() or "", allowed_special="all"), np.uint32)
                except ValueError:  # a run of white space that its pattern matcher has no stack for
                    plain = plain or plain_encoder(special)
                    ids = np.array(plain.encode(text.as_py(), add_special_tokens=False).ids, np.uint32)
                ids = np.append(ids, np.uint32(END)).astype("<u4")
                for s in range(0, len(ids), length):
                    part = ids[s : s + length]
                    at.append(k), start.append(s), size.append(len(part)), crc.append(zlib.crc32(part.tobytes())), total.append(len(ids))
            columns = [batch.column("doc_id").take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, size, crc, total))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return documents.select("doc_id", "text").mapInArrow(run, with_columns(documents, ["doc_id"], "start long, length long, ids_crc32 long, doc_tokens long"))


def best_pattern(value: np.ndarray, most: np.ndarray | None = None) -> np.ndarray:
    """The unbounded knapsack over classes 1 .. n with capacity n, by dynamic programming; value[c-1] each.

    most: how many of a class there are at all; only classes that have some take part.
    """
    n = len(value)
    weigh = np.where(most > 0, value, -1.0) if most is not None else value
    best, took = np.zeros(n + 1), np.zeros(n + 1, np.int64)
    for w in range(1, n + 1):
        gain = best[w - 1 :: -1][:w] + weigh[:w]  # class c leaves w - c
        c = int(np.argmax(gain))
        if gain[c] > best[w - 1] + 1e-12:
            best[w], took[w] = gain[c], c + 1
        else:
            best[w] = best[w - 1]
    out, w = np.zeros(n, np.int64), n
    while w > 0:
        if took[w]:
            out[took[w] - 1] += 1
            w -= took[w]
        else:
            w -= 1
    return out


def _times(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """a @ x without BLAS, whose threads fight for cores with a busy driver."""
    return np.einsum("ij,j->i", a, x)


def _inverse(a: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row pivots, likewise without BLAS."""
    n = len(a)
    both = np.hstack([a, np.eye(n)])
    for k in range(n):
        p = k + int(np.argmax(np.abs(both[k:, k])))
        both[[k, p]] = both[[p, k]]
        both[k] /= both[k, k]
        factor = both[:, k].copy()
        factor[k] = 0
        both -= factor[:, None] * both[k]
    return both[:, n:]


def cutting_stock(demand: np.ndarray, gap: float = GAP, max_columns: int = 6000) -> list[tuple[np.ndarray, int]]:
    """Patterns with counts whose slots are exactly the demanded numbers of classes 1 .. n, capacity n.

    Bounded by the number of classes: a basis of n columns, whatever the number of documents.
    """
    n = len(demand)
    have = np.flatnonzero(demand)
    if not len(have):
        return []
    basis = np.zeros((len(have), len(have)))
    for k, c in enumerate(have):
        basis[k, k] = n // (c + 1)
    columns = [np.eye(n, dtype=np.int64)[c] * (n // (c + 1)) for c in have]
    inverse, need = _inverse(basis), demand[have].astype(float)
    x = _times(inverse, need)
    floor, earlier = float((demand * np.arange(1, n + 1)).sum() / n), np.inf
    for step in range(max_columns):
        if step % 300 == 0:  # near the bound that any packing has, or at a standstill
            if x.sum() <= floor * (1 + gap) or x.sum() > earlier * (1 - gap):
                break
            earlier = x.sum()
        prices = inverse.sum(axis=0)  # every column costs one sequence
        value = np.zeros(n)
        value[have] = prices
        column = best_pattern(value, demand)
        worth = float((column * value).sum())
        if worth <= 1 + gap:  # prices / worth are feasible for the dual, so the bound is total / worth
            break
        direction = _times(inverse, column[have].astype(float))
        ok = direction > 1e-9
        ratio = np.where(ok, x / np.where(ok, direction, 1), np.inf)
        leave = int(np.argmin(ratio))
        columns[leave] = column
        basis[:, leave] = column[have]
        if step % 200 == 199:
            inverse = _inverse(basis)
        else:
            pivot = inverse[leave] / direction[leave]
            inverse = inverse - direction[:, None] * pivot
            inverse[leave] = pivot
        x = np.maximum(_times(inverse, need), 0)
    left, out = demand.copy(), []
    for column, count in sorted(zip(columns, np.floor(x + 1e-9).astype(np.int64)), key=lambda p: -p[1]):
        used = column > 0
        count = int(min(count, (left[used] // column[used]).min())) if used.any() else 0
        if count > 0:
            out.append((column, count))
            left = left - column * count
    while left.any():  # first-fit decreasing over what rounding left, repeated as often as it fits
        column, room = np.zeros(n, np.int64), n
        for c in range(n, 0, -1):
            if c <= room and left[c - 1]:
                column[c - 1] = min(left[c - 1], room // c)
                room -= c * column[c - 1]
        used = column > 0
        count = int((left[used] // column[used]).min())
        out.append((column, count))
        left = left - column * count
    return out


def slots(patterns: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """For every class and pattern: class, first rank, rank after the last, first sequence, slots of that
    class in a sequence, place of the class in the pattern."""
    out, rank, sequence = [], {}, 0
    for column, count in patterns:
        for place, c in enumerate(np.flatnonzero(column)[::-1] + 1):
            each = int(column[c - 1])
            first = rank.get(int(c), 0)
            rank[int(c)] = first + each * count
            out.append((int(c), first, rank[int(c)], sequence, each, place))
        sequence += count
    return out


def pack(documents: DataFrame, path: str | None = None, special: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row a piece."""
    spark = documents.sparkSession
    keys = ["doc_id", "start", "ids_crc32", "doc_tokens", "length"]
    pieces = pieces_of(documents, path, special=special).withColumn("class", F.ceil(F.col("length") / UNIT).cast("int"))
    pieces = cut_lineage(pieces)
    spread = min(MOST_SPREAD, max(SPREAD, pieces.count() // SPREAD_PIECES))
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(spread)).cast("int"))
    counts = pieces.groupBy("class", "part").count()
    before = cut_lineage(counts.select("class", "part", (F.sum("count").over(Window.partitionBy("class").orderBy("part")) - F.col("count")).alias("before"), "count"))
    demand = np.zeros(CLASSES, np.int64)
    for row in before.groupBy("class").agg(F.sum("count").alias("n")).collect():  # at most CLASSES rows
        demand[row["class"] - 1] = row.n
    plan = slots(cutting_stock(demand))
    inside = Window.partitionBy("class", "part").orderBy(*keys)
    ranked = pieces.join(F.broadcast(before.drop("count")), ["class", "part"]).withColumn("rank", F.col("before") + F.row_number().over(inside) - 1)
    firsts: dict[int, list[tuple]] = {}
    for c, first, _, sequence, each, place in plan:
        firsts.setdefault(c, []).append((first, sequence, each, place))
    tables = {c: np.array(sorted(rows), np.int64) for c, rows in firsts.items()}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, rank = batch.column("class").to_numpy(), batch.column("rank").to_numpy()
            sequence, place = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for c in np.unique(kind):
                mine, table = kind == c, tables[int(c)]
                row = table[np.searchsorted(table[:, 0], rank[mine], side="right") - 1]
                inner = rank[mine] - row[:, 0]
                sequence[mine] = row[:, 1] + inner // row[:, 2]
                place[mine] = row[:, 3] * LENGTH + inner % row[:, 2]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), pa.array(sequence), pa.array(place)], [*keys, "sequence_id", "place"])

    placed = ranked.select(*keys, "class", "rank").mapInArrow(assign, with_columns(pieces, keys, "sequence_id long, place long")) if plan else spark.createDataFrame([], pieces.select(*keys).schema.add("sequence_id", "long").add("place", "long"))
    earlier = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", (F.sum("length").over(earlier) - F.col("length")).alias("offset"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), special=True)


SQL = None  # tokenization isn't SQL; tests check exact reassembly and the padding
