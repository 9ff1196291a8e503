"""Periodic runs by grammar compression.

A run is a stretch of consecutive words whose smallest period is q, of at least max(6, 4 q) words, that no neighbouring word
extends. The word ids of a block of documents are compressed by Re-Pair: a pair of neighbouring symbols that occurs twice or
more becomes a nonterminal, frequent pairs first. A round replaces all pairs that are more frequent than the pairs they
overlap with, everywhere in the block at once; pairs never cross documents. What is left of a document is paired into a
balanced tree. Every run crosses the boundary of one node in full, the lowest that it lies in, so it is enough to
look at the boundary of each nonterminal once, at its first occurrence: a run of period q around a boundary has 2 q of its
words on one of the two sides, so that two q-grams at the boundary are equal; hashes of windows find them, and word ids are
compared to find how far they reach. Runs of nonterminals are translated to all of their places by descending the
derivations that have any, and of the intervals of a place and period the maximal ones stay.

The work is that of Re-Pair's rounds and of windows as long as the nodes, n log n at most; memory is that of a block or
of the longest document. Documents don't meet in a shuffle.

Defined results: null, empty and blank texts have no words and no runs, and collapse to an empty text; repeated rows get equal
results; a very long text is a block of its own; ties (runs of equal exponent) are for the caller, as all runs are returned, by
start and period; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import mixed

#: A run has so many words at least, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words that are compressed together, unless one document has more.
BLOCK_WORDS = 1 << 19
_B = np.uint64(0x9E3779B97F4A7C15)
_B_INV = np.uint64(pow(int(_B), -1, 2**64))


class Grammar:
    """Re-Pair's rules for the ids of a block: rule k is symbol ``words`` + k, and ``left``, ``right`` its symbols.

    ``first`` is where it first occurs in the block and ``size`` how many words it stands for (of all symbols).
    ``top`` and ``at`` are the symbols that are left and where each begins.
    """

    def __init__(self, ids: np.ndarray, borders: np.ndarray, words: int):
        self.words = words
        seq, pos = ids.astype(np.int64), np.arange(len(ids))
        # Of the pair that begins at a symbol: whether it lies in one document, and whether it may occur twice. A pair that
        # occurs once is looked at again only when one of its symbols is new.
        inside = np.ones(len(ids), bool)
        inside[borders[borders > 0] - 1] = False
        open_pair = inside.copy()
        size, left, right, first = np.ones(words, np.int64), [], [], []
        known_pairs, known_rules = np.zeros(0, np.int64), np.zeros(0, np.int64)
        draw = np.random.default_rng(1)
        while len(here := np.flatnonzero(open_pair)):
            coded = pa.array((seq[here] << 32) | seq[here + 1]).dictionary_encode()
            kind, pairs = coded.indices.to_numpy(), coded.dictionary.to_numpy()
            count = np.bincount(kind, minlength=len(pairs))
            often = count[kind] > 1
            here, kind = here[often], kind[often]
            if not len(here):
                break
            # A total order of pairs: frequency, then a drawn number, so that no text has a long ascent of equally frequent pairs.
            weight = np.zeros(len(seq) + 2, np.int64)
            weight[here + 1] = mine = ((count << 32) + draw.permutation(len(pairs)) + 1)[kind]
            best = (mine >= weight[here]) & (mine >= weight[here + 2])
            chosen, kind = here[best], kind[best]
            # Overlapping occurrences of one pair (x x x): every other, from the left.
            same = np.zeros(len(chosen), bool)
            same[1:] = (chosen[1:] == chosen[:-1] + 1) & (kind[1:] == kind[:-1])
            if same.any():
                even = (chosen - np.maximum.accumulate(np.where(same, 0, chosen))) % 2 == 0
                chosen, kind = chosen[even], kind[even]
            used = np.zeros(len(pairs), bool)
            used[kind] = True
            new = np.flatnonzero(used)
            slot = np.minimum(np.searchsorted(known_pairs, pairs[new]), max(len(known_pairs) - 1, 0))
            found = known_pairs[slot] == pairs[new] if len(known_pairs) else np.zeros(len(new), bool)
            symbol = np.zeros(len(pairs), np.int64)
            symbol[new[found]] = known_rules[slot[found]]
            fresh = new[~found]
            symbol[fresh] = len(size) + np.arange(len(fresh))
            seen = np.zeros(len(pairs), np.int64)
            seen[kind[::-1]] = pos[chosen[::-1]]  # the first place of each
            x, y = pairs[fresh] >> 32, pairs[fresh] & 0xFFFFFFFF
            left.append(x), right.append(y), first.append(seen[fresh])
            known_pairs, known_rules = np.concatenate([known_pairs, pairs[fresh]]), np.concatenate([known_rules, symbol[fresh]])
            order = np.argsort(known_pairs, kind="stable")
            known_pairs, known_rules = known_pairs[order], known_rules[order]
            size = np.concatenate([size, size[x] + size[y]])
            seq[chosen] = symbol[kind]
            open_pair[:] = False
            open_pair[here] = True
            inside[chosen] = inside[chosen + 1]
            open_pair[chosen] = inside[chosen]
            before = chosen[chosen > 0] - 1
            open_pair[before] = inside[before]
            stays = np.ones(len(seq), bool)
            stays[chosen + 1] = False
            seq, pos, inside, open_pair = seq[stays], pos[stays], inside[stays], open_pair[stays]
        none = np.zeros(0, np.int64)
        self.left, self.right, self.first = (np.concatenate([none, *x]) for x in (left, right, first))
        self.size, self.top, self.at = size, seq, pos


def _tree(at: np.ndarray, borders: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, boundary, end) of the nodes of a balanced tree over each document's symbols, which begin at ``at``."""
    begin, end = at, np.append(at[1:], n)
    parts: list[list[np.ndarray]] = [[], [], []]
    while len(begin) > 1:
        doc = np.searchsorted(borders, begin, side="right")
        start = np.concatenate([[True], doc[1:] != doc[:-1]])
        place = np.arange(len(begin)) - np.maximum.accumulate(np.where(start, np.arange(len(begin)), 0))
        joins = np.zeros(len(begin), bool)  # the left one of a pair
        joins[:-1] = (place[:-1] % 2 == 0) & ~start[1:]
        k = np.flatnonzero(joins)
        if not len(k):
            break
        for part, x in zip(parts, (begin[k], end[k], end[k + 1])):
            part.append(x)
        stays = np.ones(len(begin), bool)
        stays[k + 1] = False
        end = end.copy()
        end[k] = end[k + 1]
        begin, end = begin[stays], end[stays]
    return tuple(np.concatenate([np.zeros(0, np.int64), *p]) for p in parts)


class _Hashes:
    """Hashes of all stretches of a block, from prefix sums."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        power, self.inverse = np.full(n + 1, _B, np.uint64), np.full(n + 1, _B_INV, np.uint64)
        for table in (power, self.inverse):
            table[0] = 1
            np.multiply.accumulate(table, out=table)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed(ids.astype(np.uint64) + np.uint64(1)) * power[:n], out=self.sums[1:])

    def of(self, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return (self.sums[at + size] - self.sums[at]) * self.inverse[at]

    def all(self, size: int) -> np.ndarray:
        last = len(self.sums) - size
        return (self.sums[size:] - self.sums[:last]) * self.inverse[:last]


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading elements are equal."""
    done, step = 0, 64
    while done < len(a):
        same = a[done : done + step] == b[done : done + step]
        if not same.all():
            return done + int(np.argmin(same))
        done, step = done + step, step * 8
    return len(a)


def _reach(ids: np.ndarray, begin: int, at: int, end: int, q: int) -> tuple[int, int]:
    """The largest stretch of begin .. end around at .. at + q - 1 in which words q apart are identical."""
    ahead = _agree(ids[at : end - q], ids[at + q : end])
    back = _agree(ids[begin:at][::-1], ids[begin + q : at + q][::-1])
    return at - back, at + ahead + q


def crossing(ids: np.ndarray, begin: np.ndarray, middle: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(node, first, last + 1, period) of the stretches of LEAST_PERIODS periods or more that cross a node's boundary, largest within the node.

    Periods are tried by doubling ranges g .. 2 g - 1. A stretch that a smaller period already explains is not tried again.
    """
    out: list[tuple[int, int, int, int]] = []
    hashes = _Hashes(ids)
    # How far to the right and to the left of its boundary a node is known to have a smaller period.
    right_known, left_known = middle.copy(), middle.copy()
    g = 1
    nodes = np.flatnonzero(end - begin >= LEAST_WORDS)
    while len(nodes := nodes[(end - begin)[nodes] >= LEAST_PERIODS * g]):
        grams = hashes.all(g)
        for side in (1, -1):
            room = (end - middle if side > 0 else middle - begin)[nodes]
            mine = nodes[room >= 2 * g]
            for low in range(0, len(mine), max(1, (1 << 21) // g)):
                part = mine[low : low + max(1, (1 << 21) // g)]
                shift = np.arange(g, 2 * g)
                own = middle[part] if side > 0 else middle[part] - g
                other = own[:, None] + side * shift
                other = np.clip(other, 0, len(grams) - 1)
                row, k = np.nonzero(grams[own][:, None] == grams[other])
                q = shift[k]
                x = part[row]
                fits = (2 * q <= (end[x] - middle[x] if side > 0 else middle[x] - begin[x])) & (LEAST_PERIODS * q <= end[x] - begin[x])
                x, q = x[fits], q[fits]
                at = middle[x] if side > 0 else middle[x] - 2 * q
                full = hashes.of(at, q) == hashes.of(at + q, q)
                x, q, at = x[full], q[full], at[full]
                order = np.lexsort((q, x))
                for node, period, here in zip(x[order].tolist(), q[order].tolist(), at[order].tolist()):
                    m = int(middle[node])
                    if (m + 2 * period <= right_known[node]) if side > 0 else (m - 2 * period >= left_known[node]):
                        continue
                    first, last = _reach(ids, int(begin[node]), here, int(end[node]), period)
                    if last - first < 2 * period:
                        continue  # equal hashes of different words
                    if first <= m <= last:
                        right_known[node], left_known[node] = max(right_known[node], last), min(left_known[node], first)
                    if first < m < last and last - first >= max(LEAST_WORDS, LEAST_PERIODS * period):
                        out.append((node, first, last, period))
        g *= 2
    rows = np.array(sorted(set(out)), np.int64).reshape(-1, 4)
    return rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 3]


def _places(grammar: Grammar, has: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rule, place) of all derivation positions of the rules in ``has``: only symbols that lead to one are descended."""
    w, leads = grammar.words, np.zeros(len(grammar.size), bool)
    leads[w + has] = True
    while (more := (leads[grammar.left] | leads[grammar.right]) & ~leads[w:]).any():  # a step for each level of the rules
        leads[w:] |= more
    symbol, at = grammar.top[leads[grammar.top]], grammar.at[leads[grammar.top]]
    own = np.zeros(len(grammar.size), bool)
    own[w + has] = True
    rules, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(symbol):
        hit = own[symbol]
        rules.append(symbol[hit] - w), places.append(at[hit])
        x, y = grammar.left[symbol - w], grammar.right[symbol - w]
        symbol, at = np.concatenate([x, y]), np.concatenate([at, at + grammar.size[x]])
        on = leads[symbol]
        symbol, at = symbol[on], at[on]
    return np.concatenate(rules), np.concatenate(places)


def maximal(first: np.ndarray, last: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Rows (first, last + 1, period): intervals of one period that overlap by a period are one; of equal intervals the least period stays."""
    order = np.lexsort((-last, first, period))
    first, last, period = first[order], last[order], period[order]
    out: list[list[int]] = []
    for f, t, q in zip(first.tolist(), last.tolist(), period.tolist()):
        if out and out[-1][2] == q and f <= out[-1][1] - q:
            out[-1][1] = max(out[-1][1], t)
        else:
            out.append([f, t, q])
    least: dict[tuple[int, int], int] = {}
    for f, t, q in out:
        least[f, t] = min(q, least.get((f, t), q))
    return np.array(sorted((f, t, q) for (f, t), q in least.items()), np.int64).reshape(-1, 3)


def runs_of(documents: list[list[bytes]]) -> list[np.ndarray]:
    """For each list of words its runs as rows (start, length, period), by start and period."""
    sizes = np.array([len(d) for d in documents], np.int64)
    borders = np.cumsum(sizes)
    out = [np.zeros((0, 3), np.int64)] * len(documents)
    if sizes.max(initial=0) < LEAST_WORDS:
        return out
    coded = pa.array([w for d in documents for w in d], pa.large_binary()).dictionary_encode()
    ids, words = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
    grammar = Grammar(ids, borders, words)
    x, y = grammar.left, grammar.right
    node, first, last, period = crossing(ids, grammar.first, grammar.first + grammar.size[x], grammar.first + grammar.size[x] + grammar.size[y])
    begin, middle, end = _tree(grammar.at, borders, len(ids))
    _, first_top, last_top, period_top = crossing(ids, begin, middle, end)
    found = [np.stack([first_top, last_top, period_top], axis=1)]
    if len(node):
        rule, place = _places(grammar, np.unique(node))
        # A row for each interval of a rule and each place of the rule.
        low, high = np.searchsorted(node, rule, side="left"), np.searchsorted(node, rule, side="right")
        row = np.repeat(low, high - low) + np.arange((high - low).sum()) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
        moved = np.repeat(place - grammar.first[rule], high - low)
        found.append(np.stack([first[row] + moved, last[row] + moved, period[row]], axis=1))
    rows = np.concatenate(found)
    doc = np.searchsorted(borders, rows[:, 0], side="right")
    order = np.argsort(doc, kind="stable")
    rows, doc = rows[order], doc[order]
    edges = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]])) if len(doc) else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1], edges[1:]):
        d = int(doc[a])
        spans = maximal(rows[a:b, 0], rows[a:b, 1], rows[a:b, 2])
        base = int(borders[d] - sizes[d])
        spans = np.stack([spans[:, 0] - base, spans[:, 1] - spans[:, 0], spans[:, 2]], axis=1)
        out[d] = spans[np.lexsort((spans[:, 2], spans[:, 0]))]
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words without those that lie in a run after its first period."""
    if not len(runs):
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return [w for w, gone in zip(words, (np.cumsum(change[:-1]) > 0).tolist()) if not gone]


def periodic_runs(documents: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): the runs as structs (start, length, period), and the kept words joined by a blank."""
    kind = documents.schema["doc_id"].dataType

    def results(ids: list, docs: list[list[bytes]]) -> pa.RecordBatch:
        found = runs_of(docs)
        rows = np.concatenate([np.zeros((0, 3), np.int64), *found])
        ends = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in found])]).astype(np.int32))
        runs = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in range(3)], ["start", "length", "period"]))
        left = [b" ".join(collapsed(d, r)).decode() for d, r in zip(docs, found)]
        return pa.RecordBatch.from_arrays([pa.chunked_array(ids).combine_chunks(), pa.array([len(d) for d in docs], pa.int64()), runs, pa.array(left, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, docs, total = [], [], 0
        for batch in batches:
            at = 0
            for k, text in enumerate(batch.column("text")):
                docs.append(text.as_py().encode().split() if text.is_valid else [])
                total += len(docs[-1])
                if total >= block_words:
                    ids.append(batch.column("doc_id").slice(at, k + 1 - at))
                    yield results(ids, docs)
                    ids, docs, total, at = [], [], 0, k + 1
            if at < batch.num_rows:
                ids.append(batch.column("doc_id").slice(at))
        if docs:
            yield results(ids, docs)

    return documents.select("doc_id", "text").mapInArrow(run, f"`doc_id` {kind.simpleString()}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_repeats(documents: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the documents, by the CRC-32 of doc_id, repeat a stretch from some word on, as the query's contract says."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    chosen = documents.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("words")).withColumn("n", F.size("words"))
    a = (F.col("g") % F.col("n")).cast("int")
    p = (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    chosen = chosen.withColumn("a", F.when(F.col("n") > 0, a)).withColumn("p", p)
    new = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", F.col("a") + (i - F.col("a")) % F.col("p"))))
    return chosen.select("doc_id", F.when(F.col("n") > 0, F.array_join(new, " ")).otherwise(F.col("text")).alias("text"))


def greatest(runs: Column) -> Column:
    """The run with the greatest exact length / period; of equal ones that with the smallest start, then period."""
    more = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    return F.reduce(F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0))), F.get(runs, F.lit(0)), lambda best, r: F.when(more(r, best), r).otherwise(best))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    best = found.withColumn("best", greatest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


SQL = None  # runs aren't SQL; tests compare with all starts and periods
