"""Line dedup by an exact set-similarity join.

A line is the set of its words. Words are put in one global order, rare ones first; two lines of
Jaccard similarity t or more then share a word among their first n - ceil(t * n) + 1. A row for each of
those prefix words goes to the list of its word; in a list, length, position and a 128-bit parity
bitmap of the sets bound the overlap and discard pairs; the words of what is left are compared exactly.
A line goes if an earlier line (by doc_id, then line number) is similar, whether or not that one goes too.

Equal sets are settled by grouping, with a combine before the shuffle, on 128 bits of sums over 64-bit
hashes of their words. In a list every line takes its first earlier line that passes the filters
(PARTNERS); most repeated lines are settled by the earliest of them, so a family of near copies does not
meet in all pairs. Lines that had more partners and stay unsettled meet all of them in a second pass.
Rows of lists are dealt by buckets of lists, many in a message, so that Spark moves bytes and not rows. The
lists of very frequent words are cut by size class, so that only sizes that can match share a list.

Defined results: every line with a word takes part unless ``min_words`` asks for more different
words; lines without words are never removed and remove none; null and empty texts come back as they
are; a text whose lines all go is empty. Rows are told apart by doc_id and text: rows that repeat both are one document
and get the same result, rows that share an id only (null ids too) keep their own lines, the lesser text hash being
the earlier one; null doc_ids come last. doc_id must be an integer. Further columns come back in their order,
whatever their names, but for ``removed``, which is replaced. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import MESSAGES, KeyFilter, mixed, setting, stored, word_hashes

THRESHOLD = (4, 5)
#: Words whose frequency is told apart in the order; all others are rare. Share of a block's lines (of 40 words) from which a word may be one.
FREQUENT, FREQUENT_SHARE = 1 << 15, 5e-4
#: Bins of words that are counted together at first, a power of two.
BINS = 1 << 20
#: Lines from which the list of a frequent word is cut by size class.
HOT_LINES = 20_000
#: Rows up to which lists are compared many at once, rows that are packed together and that a bucket of lists holds, about, and pairs of rows that are compared together.
SHORT, ROWS, PAIRS = 1024, 1 << 17, 1 << 22
#: Buckets of lists at least, and bits of a list's number. Lists that share a number are one: more pairs to check, none lost.
BUCKETS, LIST_BITS = 512, np.uint64(2**48 - 1)
#: Earlier lines that a line meets first in a word's list; the rest follow if these don't settle it.
PARTNERS = 1
#: Bytes of text that are hashed together, rows of texts that are Python's at a time, and that Spark hands to Python in a message.
BLOCK_BYTES, PIECE_ROWS, MESSAGE_ROWS = 4 << 20, 256, 1024
#: Buckets of equal sets at least.
SET_BUCKETS = 64
_LAST = 2**63 - 1
_KEY = ["doc", "mark", "line"]
_LINES = "doc long, mark long, line int, id1 long, id2 long, n int, copy boolean, sig1 long, sig2 long, lists binary, places binary"
#: A row of a set, and of a list.
_SET = np.dtype([("id1", "<i8"), ("id2", "<i8"), ("n", "<i4"), ("doc", "<i8"), ("mark", "<i8"), ("line", "<i4")])
_POSTING = np.dtype([("list", "<i8"), ("doc", "<i8"), ("mark", "<i8"), ("line", "<i4"), ("n", "<i4"), ("pos", "<i4"), ("marked", "?"), ("sig1", "<u8"), ("sig2", "<u8")])


def _keyed(documents: DataFrame) -> DataFrame:
    """(doc, mark, text): what tells rows apart, and their text."""
    return documents.where("text <> ''").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64("text").alias("mark"), "text")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches``, few at a time, so that only their texts become Python's."""
    for batch in batches:
        for low in range(0, batch.num_rows, PIECE_ROWS):
            yield batch.slice(low, PIECE_ROWS)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    docs, marks, texts, size = [], [], [], 0
    for batch in _pieces(batches):
        for doc, mark, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "mark", "text"))):
            docs.append(doc), marks.append(mark), texts.append(text)
            size += len(text)
            if size >= BLOCK_BYTES:
                yield np.array(docs, np.int64), np.array(marks, np.int64), texts
                docs, marks, texts, size = [], [], [], 0
    if texts:
        yield np.array(docs, np.int64), np.array(marks, np.int64), texts


def tokens(texts: list[str], frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, hash) of the different words of the lines of all texts, by line, then rank, then hash.

    ``frequent``: hashes, sorted, with ranks in a second column; all others rank before them. Lines are numbered through the texts.
    """
    data = "\n".join(texts).encode()
    h, start = word_hashes(data)
    ends = np.searchsorted(start, np.flatnonzero(np.frombuffer(data, np.uint8) == 10))
    line = np.repeat(np.arange(len(ends) + 1), np.diff(ends, prepend=0, append=len(start)))
    # One number holds most of the hash and the place; where two words share it, the hash alone decides.
    low = np.uint64((1 << len(h).bit_length()) - 1)
    order = (np.sort(h & ~low | np.arange(len(h), dtype=np.uint64)) & low).astype(np.int64)
    key = h[order]
    if (key[1:] < key[:-1]).any():
        order = np.argsort(h)
        key = h[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    words = key[new]
    ranked = np.zeros(0, np.int64)
    if len(frequent) and len(words):
        at = np.minimum(np.searchsorted(words, frequent[:, 0]), len(words) - 1)
        here = np.flatnonzero(words[at] == frequent[:, 0])
        ranked = at[here[np.argsort(frequent[here, 1], kind="stable")]]
    rare = np.ones(len(words), bool)
    rare[ranked] = False
    placed = np.concatenate([np.flatnonzero(rare), ranked])
    place = np.empty(len(words), np.uint64)
    place[placed] = np.arange(len(words), dtype=np.uint64)
    both = np.sort(line[order].astype(np.uint64) << np.uint64(32) | place[np.cumsum(new) - 1])
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    both = both[new]
    return (both >> np.uint64(32)).astype(np.int64), words[placed][(both & np.uint64(0xFFFFFFFF)).astype(np.int64)]


def frequent_tokens(documents: DataFrame) -> np.ndarray:
    """(hash, rank, count) of at most FREQUENT words, by hash; a word that is frequent anywhere is among the candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, texts in _blocks(batches):
            h = word_hashes("\n".join(texts).encode())[0]
            least = max(2, FREQUENT_SHARE * len(h) / 40)
            # Words are counted one by one only in bins that reach the least count together.
            bins = (h & np.uint64(BINS - 1)).astype(np.int64)
            counted = pa.array(h[(np.bincount(bins, minlength=BINS) >= least)[bins]].view(np.int64)).value_counts()
            words, count = (counted.field(c).to_numpy() for c in ("values", "counts"))
            often = count >= least
            yield pa.RecordBatch.from_arrays([pa.array(words[often]), pa.array(count[often])], ["word", "lines"])

    counted = _keyed(documents).mapInArrow(run, "word long, lines long").groupBy("word").agg(F.sum("lines").alias("lines")).orderBy(F.desc("lines"), "word").limit(FREQUENT)
    with setting(documents.sparkSession, MESSAGES, MESSAGE_ROWS):
        found = counted.collect()
    ranked = np.array([(r.word % 2**64, FREQUENT - k, r.lines) for k, r in enumerate(found)], np.uint64).reshape(-1, 3)
    return ranked[np.argsort(ranked[:, 0])]


def line_sets(documents: DataFrame, frequent: np.ndarray, threshold: tuple[int, int], min_words: int) -> DataFrame:
    """One row a line with min_words different words: identity of its set, size, whether the block has an earlier line of the set, bitmap and prefix.

    The prefix, as the numbers of its lists and its places, is empty where no other set can be similar, or where the block has an earlier line of the same set.
    """
    up, down = threshold
    hot = frequent[frequent[:, 2] >= HOT_LINES, 0]

    def lists(key: np.ndarray, n: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, list and position; a hot word's list is that of a size class, and lines also visit the
        next class, as guests (position below zero)."""
        is_hot = np.isin(key, hot)
        grade = np.floor(np.log(n) / math.log(down / up) + 1e-9).astype(np.uint64) if up < down else n.astype(np.uint64)
        own = np.where(is_hot, mixed(key + mixed(grade + np.uint64(1))), key)
        guest = np.flatnonzero(is_hot) if up < down else np.zeros(0, np.int64)
        row = np.concatenate([np.arange(len(key)), guest])
        return row, np.concatenate([own, mixed(key[guest] + mixed(grade[guest] + np.uint64(2)))]), np.concatenate([pos, -1 - pos[guest]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, marks, texts in _blocks(batches):
            line, key = tokens(texts, frequent)
            if not len(line):
                continue
            first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
            n = np.diff(np.append(first, len(line)))
            h = mixed(key)
            id1, id2 = np.add.reduceat(h, first), np.add.reduceat(mixed(h + np.uint64(1)), first)
            bit = np.uint64(1) << (h & np.uint64(63))
            half = h & np.uint64(64) != 0
            sigs = [np.bitwise_xor.reduceat(np.where(side, bit, np.uint64(0)), first) for side in (half, ~half)]
            before = np.cumsum([0, *(t.count("\n") + 1 for t in texts)])
            of = np.searchsorted(before, line[first], side="right") - 1
            doc, mark, number = docs[of], marks[of], line[first] - before[of]
            keep = n >= min_words
            # Of equal sets only the block's earliest is listed, and only if another size or set may match.
            order = np.lexsort((number, mark, doc))
            first_of, same = np.unique(id1[order], return_index=True, return_inverse=True)[1:]
            of_set = np.empty(len(n), np.int64)
            of_set[order] = order[first_of[same]]
            equal = (id2 == id2[of_set]) & (n == n[of_set])
            copy = equal & ((doc != doc[of_set]) | (mark != mark[of_set]) | (number != number[of_set]))
            listed = ~equal | (of_set == np.arange(len(n)))
            listed &= keep & ((up * (n + 1) <= down * n) | (up * n <= down * (n - 1)))
            take = np.where(listed, n - -(-up * n // down) + 1, 0)
            inner = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
            owner = np.repeat(np.arange(len(n)), take)
            row, where, pos = lists(key[first[owner] + inner], n[owner], inner)
            where &= LIST_BITS
            by_line = np.argsort(owner[row], kind="stable")
            sizes = np.bincount(owner[row], minlength=len(n))[keep]
            ends = np.concatenate([[0], np.cumsum(sizes)])
            blobs = [pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((ends * x.itemsize).astype(np.int32)), pa.py_buffer(x)]) for x in (where[by_line], pos[by_line].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[keep]), pa.array(mark[keep]), pa.array(number[keep].astype(np.int32)), *(pa.array(x[keep].view(np.int64)) for x in (id1, id2)), pa.array(n[keep].astype(np.int32)), pa.array(copy[keep]), *(pa.array(x[keep].view(np.int64)) for x in sigs), *blobs],
                [*_KEY, "id1", "id2", "n", "copy", "sig1", "sig2", "lists", "places"],
            )

    return _keyed(documents).mapInArrow(run, _LINES)


def _packed(bucket: np.ndarray, buckets: int, rows: list[np.ndarray]) -> pa.RecordBatch:
    """(bucket, data): the rows of each bucket as bytes, all first ones, then all second ones, so that what is alike is side by side."""
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
    bucket = bucket[order]
    # Columns are turned one by one, and buckets are copied as stretches.
    planes = np.concatenate([np.ascontiguousarray(x[order]).view(np.uint8).reshape(len(order), -1).T for x in rows])
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    data = np.empty(planes.size, np.uint8)
    for low, high in zip((edges[:-1] * len(planes)).tolist(), (edges[1:] * len(planes)).tolist()):
        data[low:high].reshape(len(planes), -1)[:] = planes[:, low // len(planes) : high // len(planes)]
    packed = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * len(planes)).astype(np.int32)), pa.py_buffer(data)])
    return pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]].astype(np.int32)), packed], ["bucket", "data"])


def _unpacked(data: list[bytes], kind: np.dtype) -> list[np.ndarray]:
    """The columns of ``kind`` from the bytes of a bucket."""
    planes = np.concatenate([np.frombuffer(x, np.uint8).reshape(kind.itemsize, -1) for x in data], axis=1)
    return [np.ascontiguousarray(planes[at : at + of.itemsize].T).view(of)[:, 0] for of, at in (kind.fields[c][:2] for c in kind.names)]


def _by_bucket(packed: DataFrame, work: Callable[[list[bytes]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``work`` makes of the data of each bucket; buckets are streamed in order, one is in memory at a time, as numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for bucket, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "data"))):
                if held and bucket != now:
                    yield from work(held)
                    held = []
                now = bucket
                held.append(data)
        if held:
            yield from work(held)

    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def _copies(sets: DataFrame) -> DataFrame:
    """(doc, mark, line) of the lines that have an earlier line of the same set. Those of a block are known; of each block's first ones the rest are told by buckets."""
    buckets = max(SET_BUCKETS, 4 * sets.count() // ROWS)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def packed() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held)
            rows = [whole.column(c).to_numpy() for c in _SET.names]
            return _packed((rows[0].view(np.uint64) % np.uint64(buckets)).astype(np.int64), buckets, rows)

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= ROWS:
                yield packed()
                held.clear()
        if sum(b.num_rows for b in held):
            yield packed()

    def later(data: list[bytes]) -> Iterator[pa.RecordBatch]:
        rows = _unpacked(data, _SET)
        order = np.lexsort(rows[::-1])
        rows = [x[order] for x in rows]
        change = [np.concatenate([[True], x[1:] != x[:-1]]) for x in rows]
        new = np.logical_or.reduce(change[:3])
        # Repeated rows of the input are the same line, not one after the other.
        start = np.flatnonzero(new)[np.cumsum(new) - 1]
        rest = np.logical_or.reduce([x != x[start] for x in rows[3:]])
        if rest.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[rest]) for x in rows[3:]], _KEY)

    first = sets.where("NOT copy").select(*_SET.names).mapInArrow(pack, "bucket int, data binary")
    return sets.where("copy").select(*_KEY).union(_by_bucket(first, later, "doc long, mark long, line int"))


def _postings(sets: DataFrame, lines: KeyFilter | None = None, lists: KeyFilter | None = None) -> DataFrame:
    """A row for each list of each line; with filters only those of ``lists``, the lines in ``lines`` marked.

    The rows of a bucket of lists travel together. Buckets follow the number of lines.
    """
    lines, lists = (x and x.shared() for x in (lines, lists))
    buckets = max(BUCKETS, 10 * sets.count() // ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def packed() -> pa.RecordBatch:
            rows = [np.concatenate(x) for x in zip(*held)]
            return _packed(rows[0] % buckets, buckets, rows)

        for batch in batches:
            cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in (*_KEY, "n", "sig1", "sig2")}
            cols["marked"] = lines.has(*(cols[c] for c in _KEY)) if lines else np.zeros(batch.num_rows, bool)
            blobs = batch.column("lists").to_pylist()
            key, pos = np.frombuffer(b"".join(blobs), np.int64), np.frombuffer(b"".join(batch.column("places").to_pylist()), np.int32)
            of = np.repeat(np.arange(len(blobs)), [len(b) // 8 for b in blobs])
            keep = np.flatnonzero(lists.has(key)) if lists else np.arange(len(key))
            for low in range(0, len(keep), ROWS):
                some = keep[low : low + ROWS]
                cols |= {"list": key, "pos": pos}
                held.append([cols[c][some if c in ("list", "pos") else of[some]] for c in _POSTING.names])
                if sum(len(x[0]) for x in held) >= ROWS:
                    yield packed()
                    held.clear()
        if sum(len(x[0]) for x in held):
            yield packed()

    return sets.where("octet_length(lists) > 0").drop("id1", "id2", "copy").mapInArrow(run, "bucket int, data binary")


def _near(rows: list[np.ndarray], p, q, threshold: tuple[int, int]) -> np.ndarray:
    """Which pairs of rows (n, pos, sig1, sig2) pass the length, position and bitmap filters; not two guests."""
    up, down = threshold
    n, pos, sig1, sig2 = rows
    a, b = n[p], n[q]
    need = (up * (a + b) + (up + down - 1)) // (up + down)
    ok = np.bitwise_count(sig1[p] ^ sig1[q]).astype(np.int16) + np.bitwise_count(sig2[p] ^ sig2[q]) <= a + b - 2 * need
    ok &= np.maximum(a, b) * up <= np.minimum(a, b) * down
    x, y = pos[p], pos[q]
    ok &= np.minimum(a - np.where(x < 0, -1 - x, x), b - np.where(y < 0, -1 - y, y)) >= need
    return ok & ((x >= 0) | (y >= 0))


def _order_of(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The order by two columns of numbers from 0, then place: of one number that holds all three where they fit."""
    place = len(first).bit_length()
    low = place + int(second.max(initial=0)).bit_length()
    if low + int(first.max(initial=0)).bit_length() > 64:
        return np.lexsort((second, first))
    both = np.sort(first.astype(np.uint64) << np.uint64(low) | second.astype(np.uint64) << np.uint64(place) | np.arange(len(first), dtype=np.uint64))
    return (both & np.uint64((1 << place) - 1)).astype(np.int64)


def _in_short_lists(rows: list[np.ndarray], run: np.ndarray, asked: np.ndarray, most: int, threshold: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (earlier, later) of the rows of many lists at once, ``run`` the number of each row's list:
    the first ``most`` of each later row that is ``asked``, and whether that row has further ones.

    By list and size, a row meets those after it as long as the sizes can match; the cheapest filters come first.
    """
    up, down = threshold
    order = _order_of(run, rows[0])
    n, pos, sig1, sig2 = (x[order].astype(np.int64) if k < 2 else x[order] for k, x in enumerate(rows))
    run, guest = run[order], pos < 0
    room, least, limit = (n - np.where(guest, -1 - pos, pos)) * (up + down), n * up, n * down
    found, step, alive = [np.zeros(0, np.int64)], 1, np.arange(len(run))
    while len(alive := alive[: np.searchsorted(alive, len(run) - step)]):
        fits = (run[alive + step] == run[alive]) & (least[alive + step] <= limit[alive])
        alive = alive[fits]
        p = alive[np.minimum(room[alive], room[alive + step]) >= least[alive] + least[alive + step]]
        q = p + step
        both = n[p] + n[q]
        apart = np.bitwise_count(sig1[p] ^ sig1[q]).astype(np.int64) + np.bitwise_count(sig2[p] ^ sig2[q])
        ok = (apart <= both - 2 * ((up * both + (up + down - 1)) // (up + down))) & ~(guest[p] & guest[q])
        p, q = order[p[ok]], order[q[ok]]
        p, q = np.minimum(p, q), np.maximum(p, q)
        found.append((q << 32 | p)[asked[q]])
        step += 1
    both = np.sort(np.concatenate(found))
    q = both >> 32
    new = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else q
    size = np.diff(np.append(new, len(q)))
    keep = np.arange(len(q)) - np.repeat(new, size) < most
    return (both & 0xFFFFFFFF)[keep], q[keep], np.repeat(size > most, size)[keep]


def _in_long_list(rows: list[np.ndarray], asked: np.ndarray, most: int, threshold: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for the rows of one list, in tiles; a row that has more than ``most`` is not looked at further."""
    size = len(rows[0])
    first, second, more = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(size, bool)
    for low in range(0, size, 512):
        mine = low + np.flatnonzero(asked[low : low + 512])
        if not len(mine):
            continue
        taken = np.zeros(len(mine), np.int64)
        for at in range(0, mine[-1] + 1, 2048):
            still = np.flatnonzero(taken <= most)
            if not len(still):
                break
            earlier = np.arange(at, min(at + 2048, mine[-1] + 1))
            ok = _near(rows, earlier[None], mine[still, None], threshold) & (earlier[None] < mine[still, None])
            rank = np.cumsum(ok, axis=1) + taken[still, None]
            q, p = np.nonzero(ok & (rank <= most))
            first.append(earlier[p]), second.append(mine[still[q]])
            taken[still] = rank[:, -1]
        more[mine] = taken > most
    q = np.concatenate(second)
    return np.concatenate(first), q, more[q]


_PAIR = [f"{s}_{c}" for s in "ab" for c in _KEY]
_PAIRS = "a_doc long, a_mark long, a_line int, b_doc long, b_mark long, b_line int"


def _candidates(postings: DataFrame, threshold: tuple[int, int], most: int, only_marked: bool = False) -> DataFrame:
    """Pairs of lines from the lists of ``postings``: for each line the first ``most`` of a list, with the list as ``more`` where it has further ones (else null).

    """

    def pairs_of(data: list[bytes]) -> Iterator[pa.RecordBatch]:
        cols = _unpacked(data, _POSTING)
        key, doc, mark, line = cols[:4]
        # Blocks are mostly in order already: two passes then do, of which the first meets long runs. The second sorts one number that holds
        # the list and the place; the lists of a bucket differ by many, so that their lowest bits can go.
        order = np.argsort(doc, kind="stable")
        bits = len(order).bit_length()
        both = np.sort((key[order].view(np.uint64) >> np.uint64(max(0, bits - 16))) << np.uint64(bits) | np.arange(len(order), dtype=np.uint64))
        order = order[(both & np.uint64((1 << bits) - 1)).astype(np.int64)]
        key_, doc_ = key[order], doc[order]
        tie = np.flatnonzero((key_[1:] == key_[:-1]) & (doc_[1:] == doc_[:-1]))
        a, b = order[tie], order[tie + 1]
        if (key_[1:] < key_[:-1]).any() or ((mark[a] > mark[b]) | ((mark[a] == mark[b]) & (line[a] > line[b]))).any():
            order = np.lexsort((line, mark, doc, key))
        cols = [c[order] for c in cols]
        new = np.ones(len(order), bool)  # repeated rows of the input are the same line
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols[:4]])
        key, doc, mark, line, n, pos, marked, sig1, sig2 = (c[new] for c in cols)
        edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        length = np.diff(edges)
        run = np.repeat(np.arange(len(length)), length)
        rows, asked = [n, pos, sig1, sig2], marked if only_marked else np.ones(len(n), bool)
        work = np.cumsum(np.where(length <= SHORT, length.astype(float) ** 2 / 2, 0))
        few = np.flatnonzero((length > 1)[run] & (length <= SHORT)[run])
        groups = [(g, True) for g in np.split(few, np.flatnonzero(np.diff(work[run[few]] // PAIRS)) + 1)]
        groups += [(np.arange(edges[k], edges[k + 1]), False) for k in np.flatnonzero(length > SHORT)]
        for mine, short in groups:
            of = [x[mine] for x in rows]
            p, q, more = _in_short_lists(of, run[mine], asked[mine], most, threshold) if short else _in_long_list(of, asked[mine], most, threshold)
            p, q = mine[p], mine[q]
            if len(q):
                yield pa.RecordBatch.from_arrays([*(pa.array(x[k]) for k in (p, q) for x in (doc, mark, line)), pa.array(key[q], mask=~more)], [*_PAIR, "more"])

    return _by_bucket(postings, pairs_of, f"{_PAIRS}, more long")


def _texts_of(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, mark, line, text) of the lines in ``wanted`` and of few others: documents are read again,
    and what two filters of keys leave of their lines, not their texts, is moved."""
    docs, lines = KeyFilter(wanted, ["doc", "mark"]).shared(), KeyFilter(wanted, _KEY).shared()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            batch = batch.filter(pa.array(docs.has(batch.column("doc").to_numpy(), batch.column("mark").to_numpy())))
            split = [t.split("\n") for t in batch.column("text").to_pylist()]
            size = [len(s) for s in split]
            key = [np.repeat(batch.column(c).to_numpy(), size) for c in ("doc", "mark")]
            number = np.concatenate([np.zeros(0, np.int64), *(np.arange(k) for k in size)])
            ok = lines.has(*key, number)
            text = pa.array([t for s in split for t in s], pa.string()).filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays([pa.array(key[0][ok]), pa.array(key[1][ok]), pa.array(number[ok].astype(np.int32)), text], [*_KEY, "text"])

    return _keyed(documents).mapInArrow(run, "doc long, mark long, line int, text string").groupBy(*_KEY).agg(F.max("text").alias("text"))


def _verified(documents: DataFrame, pairs: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The different later lines (doc, mark, line) of the pairs whose words are similar."""
    up, down = threshold
    wanted = stored(pairs.select(*[F.col(f"a_{c}").alias(c) for c in _KEY]).union(pairs.select(*[f"b_{c}" for c in _KEY])).distinct())
    texts = _texts_of(documents, wanted)  # dealt by line once, for both sides
    side = lambda s: texts.select(*[F.col(c).alias(f"{s}_{c}") for c in _KEY], F.col("text").alias(f"{s}_text"))
    both = pairs.join(side("a"), _PAIR[:3]).join(side("b"), _PAIR[3:]).select(*_PAIR[3:], "a_text", "b_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = (map(set, map(bytes.split, map(str.encode, batch.column(c).to_pylist()))) for c in ("a_text", "b_text"))  # two in memory at a time
            ok = [down * (both := len(x & y)) >= up * (len(x) + len(y) - both) for x, y in zip(*sets)]
            yield batch.select(_PAIR[3:]).filter(pa.array(ok, pa.bool_())).rename_columns(_KEY)

    return stored(both.mapInArrow(run, "doc long, mark long, line int").distinct(), MESSAGE_ROWS)


def similar_lines(documents: DataFrame, threshold: tuple[int, int] = THRESHOLD, min_words: int = 1) -> DataFrame:
    """(doc, mark, line) of every line that has an earlier similar one; doc is doc_id, or the largest
    long for null, and mark the XXH64 of the text as Spark computes it."""
    sets = stored(line_sets(documents, frequent_tokens(documents), threshold, min_words), MESSAGE_ROWS)
    # Of equal sets only the first may stay or name others: the rest are settled.
    copies = stored(_copies(sets))
    listed = stored(_candidates(_postings(sets), threshold, PARTNERS))
    later = [F.col(f"b_{c}") == F.col(c) for c in _KEY]
    early = _verified(documents, stored(listed.select(*_PAIR).distinct().join(copies, later, "leftanti")), threshold)
    # Lists that have more partners of lines still open meet once more; filters name them, so that nothing else is moved.
    opened = listed.where("more IS NOT NULL").select(*[F.col(f"b_{c}").alias(c) for c in _KEY], F.col("more").alias("list"))
    opened = stored(opened.join(early.union(copies), _KEY, "leftanti").distinct())
    if opened.isEmpty():
        return copies.union(early).distinct()
    again = _candidates(_postings(sets, KeyFilter(opened, _KEY), KeyFilter(opened, ["list"])), threshold, _LAST, only_marked=True)
    again = stored(again.select(*_PAIR).distinct().join(early, later, "leftanti"))
    late = _verified(documents, again, threshold)
    return copies.union(early).union(late).distinct()


def dedup_lines(documents: DataFrame, threshold: tuple[int, int] = THRESHOLD, min_words: int = 1) -> DataFrame:
    """``documents`` with the text without its later similar lines, and ``removed``, the line numbers that went.

    Only documents that may have lost a line are shuffled for it.
    """
    gone = stored(similar_lines(documents, threshold, min_words).groupBy("doc", "mark").agg(F.sort_array(F.collect_set("line")).alias("removed")))
    lost = KeyFilter(gone, ["doc", "mark"]).shared()

    @F.pandas_udf("boolean")
    def hit(doc, mark):
        import pandas as pd

        return pd.Series(lost.has(doc.to_numpy(), mark.to_numpy()))

    columns = [c for c in documents.columns if c != "removed"]
    rows = documents.select(F.struct(*columns).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("mark"))
    rows = rows.withColumn("hit", hit("doc", "mark"))
    rest = F.array_join(F.filter(F.split("row.text", "\n", -1), lambda _, i: ~F.array_contains("removed", i)), "\n")
    # Merged whatever the size: a small list would be broadcast, and what is moved would then jump where it no longer is.
    changed = rows.where("hit").join(gone.hint("merge"), ["doc", "mark"], "left").withColumn("text", F.when(F.col("removed").isNotNull(), rest).otherwise(F.col("row.text")))
    none = F.array().cast("array<int>")
    out = rows.where("NOT hit").select("row", F.col("row.text").alias("text"), none.alias("removed")).union(changed.select("row", "text", F.coalesce("removed", none)))
    return out.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in columns], "removed")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the numbers of the lines that went, and the digest of what stays."""
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


SQL = None  # set similarity of all lines in DuckDB is a cross join; tests compare with brute force
