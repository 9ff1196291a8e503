"""Ranked lexical search of many queries at once.

Documents are read once: terms are counted, and a document keeps its length and the frequencies of the terms that some item
asks for. From these forward lists come the statistics (documents, terms, documents that hold a term). The items are then
planned together. Terms that exactly the same items ask for are one shared set; of the sets, pairs that several items have are
joined to a node of a graph, frequent pairs first, and again pairs of nodes, until no pair is shared. A document's sum
over a node is its partial accumulator: it is made once, as the sum of its two parts, whatever number of items
needs it, and an item's score is the sum of the few nodes that are left of it. A document's accumulators lie in one row of a
block, so that no pair of document and item is shuffled: a task keeps the best of each item, and these are ranked.

Items are planned in batches by their hash, of about ``BATCH`` items and ``BATCH_BYTES`` of text, with a pass over the documents each.

Defined results: a null or blank text, or one of separators only, has no terms and is never found; an item without terms has
no rows; repeated items (id and text) are ranked once, items that share an id only each; repeated documents count and
are ranked each; null doc_ids come after others of equal score; very long texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import stored

TOP = 10
#: Items planned together and bytes of their texts, which bound the driver's plan and what is broadcast.
BATCH, BATCH_BYTES = 1024, 4 << 20
#: Numbers of a block of accumulators (documents x nodes).
CELLS = 1 << 21
#: Shared sets among which pairs are mined: those that most items have. All others are added singly.
MINED = 2048
#: Every byte below 0x80 but digits and letters separates terms; A-Z become lower case.
_TABLE = bytes(c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def plan(items: list[list[int]], n_terms: int) -> dict:
    """How the scores of items come from the terms (0 .. n_terms - 1) of a document, as plain arrays:

    ``leaf`` is the shared set of each term (-1: none); ``levels`` are arrays of (a, b) whose sums are the next nodes, after the
    sets; ``nodes`` are the nodes of the items one after another, ``used`` the items that have any and ``starts`` where theirs begin.
    """
    holders: list[list[int]] = [[] for _ in range(n_terms)]
    for k, terms in enumerate(items):
        for t in terms:
            holders[t].append(k)
    sets: dict[tuple[int, ...], int] = {}
    leaf = np.array([sets.setdefault(tuple(h), len(sets)) if h else -1 for h in holders], np.int64)
    total = len(sets)
    of_item: list[set[int]] = [set() for _ in items]
    for held, node in sets.items():
        for k in held:
            of_item[k].add(node)
    levels: list[np.ndarray] = []
    while True:
        often = Counter(chain.from_iterable(of_item))
        shared = sorted((n for n, c in often.items() if c > 1), key=lambda n: (-often[n], n))[:MINED]
        column = {n: c for c, n in enumerate(shared)}
        member = np.zeros((len(items), len(shared)), np.float32)
        for k, nodes in enumerate(of_item):
            member[k, [column[n] for n in nodes if n in column]] = 1
        together = np.triu(member.T @ member, 1)  # how many items have both of two nodes
        a, b = np.nonzero(together > 1)
        order = np.lexsort((b, a, -together[a, b]))
        busy, pairs = np.zeros(len(shared), bool), []
        for x, y in zip(a[order].tolist(), b[order].tolist()):
            if busy[x] or busy[y]:
                continue
            busy[x] = busy[y] = True
            for k in np.flatnonzero(member[:, x] * member[:, y]).tolist():
                of_item[k] -= {shared[x], shared[y]}
                of_item[k].add(total + len(pairs))
            pairs.append((shared[x], shared[y]))
        if not pairs:
            break
        levels.append(np.array(pairs, np.int64))
        total += len(pairs)
    sizes = np.array([len(nodes) for nodes in of_item], np.int64)
    used = np.flatnonzero(sizes)
    return {
        "leaf": leaf, "n_sets": len(sets), "levels": levels, "n_nodes": total, "used": used,
        "nodes": np.array([n for nodes in of_item for n in sorted(nodes)], np.int64), "starts": (np.cumsum(sizes) - sizes)[used],
    }


def item_scores(made: dict, doc: np.ndarray, term: np.ndarray, worth: np.ndarray, n_docs: int) -> np.ndarray:
    """(documents, used items) from what each term is worth in each document; whole numbers below 2 ** 53."""
    if not len(made["used"]):
        return np.zeros((n_docs, 0), np.int64)
    sets = made["n_sets"]
    leaf = made["leaf"][term]
    node = np.empty((made["n_nodes"], n_docs))
    node[:sets] = np.bincount(leaf * n_docs + doc, weights=worth, minlength=sets * n_docs).reshape(sets, n_docs)
    at = sets
    for pairs in made["levels"]:
        np.add(node[pairs[:, 0]], node[pairs[:, 1]], out=node[at : at + len(pairs)])
        at += len(pairs)
    return np.add.reduceat(node[made["nodes"]], made["starts"], axis=0).T.astype(np.int64)


def forward_lists(documents: DataFrame, vocabulary) -> DataFrame:
    """(doc_id, n, terms, counts) of every document with a term; terms and counts as bytes of 32-bit numbers.

    ``vocabulary`` is a broadcast variable with the terms, sorted; others only count in n.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: k for k, t in enumerate(vocabulary.value)}
        for batch in batches:
            n, terms, counts = [], [], []
            for text in batch.column("text"):
                words = terms_of(text.as_py())
                n.append(len(words))
                found = np.array([number[w] for w in words if w in number], np.int32)
                which, often = np.unique(found, return_counts=True)
                terms.append(which.astype("<i4").tobytes()), counts.append(often.astype("<i4").tobytes())
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())], ["doc_id", "n", "terms", "counts"])
            yield out.filter(pa.array(np.array(n, np.int64) > 0))

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, terms binary, counts binary")


def holding(lists: DataFrame) -> DataFrame:
    """(term, df): in how many documents each term is; a task adds up its own before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            found = np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), "<i4"))
            total, found = (np.pad(x, (0, max(len(total), len(found)) - len(x))) for x in (total, found))
            total = total + found
        term = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(total[term])], ["term", "df"])

    return lists.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def _best(lists: DataFrame, shared, n: int, length: int, top: int) -> DataFrame:
    """(item, doc_id, score): the ``top`` best documents of every item in each partition. ``shared``: plan and weights, broadcast."""
    kind = lists.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, w = shared.value
        items = len(made["used"])
        kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)]  # item, place, score
        ids, have = [], 0
        worst = np.zeros(items, np.int64)  # scores above it, or equal to it, may still be among the best
        step = max(1, CELLS // max(made["n_nodes"], 1))
        for whole in batches:
            for low in range(0, whole.num_rows, step):
                batch = whole.slice(low, step)
                terms, counts = batch.column("terms").to_pylist(), batch.column("counts").to_pylist()
                doc = np.repeat(np.arange(len(terms)), [len(t) // 4 for t in terms])
                term, tf = np.frombuffer(b"".join(terms), "<i4").astype(np.int64), np.frombuffer(b"".join(counts), "<i4").astype(np.int64)
                m = 10 + (90 * batch.column("n").to_numpy() * n) // length
                worth = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
                score = item_scores(made, doc, term, worth, len(terms))
                row, item = np.nonzero((score > 0) & (score >= worst))
                if not len(row):
                    continue
                ids.append(batch.column("doc_id"))
                new = [item, row + have, score[row, item]]
                have += len(terms)
                kept, ids = _reduced([np.concatenate(x) for x in zip(kept, new)], ids, top)
                have = len(ids[0])
                full = np.bincount(kept[0], minlength=items) >= top
                least = np.full(items, np.iinfo(np.int64).max)
                np.minimum.at(least, kept[0], kept[2])
                worst = np.where(full, least, 0)
        if have:
            yield pa.RecordBatch.from_arrays([pa.array(made["used"][kept[0]]), ids[0].take(pa.array(kept[1])), pa.array(kept[2])], ["item", "doc_id", "score"])

    return lists.mapInArrow(run, f"item long, doc_id {kind}, score long")


def _reduced(rows: list[np.ndarray], ids: list[pa.Array], top: int) -> tuple[list[np.ndarray], list[pa.Array]]:
    """The ``top`` of each item by score and doc_id (null last), and the ids that they need."""
    item, place, score = rows
    every = pa.chunked_array(ids).combine_chunks()
    rank = np.empty(len(every), np.int64)
    rank[pc.sort_indices(every, null_placement="at_end").to_numpy()] = np.arange(len(every))
    order = np.lexsort((rank[place], -score, item))
    item, place, score = item[order], place[order], score[order]
    start = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
    stays = np.arange(len(item)) - np.repeat(start, np.diff(np.append(start, len(item)))) < top
    needed, place = np.unique(place[stays], return_inverse=True)
    return [item[stays], place, score[stays]], [every.take(pa.array(needed))]


def search(documents: DataFrame, items: DataFrame, top: int = TOP, batch: int = BATCH, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the best documents of each item (item_id, text)."""
    spark = documents.sparkSession
    context = spark.sparkContext
    wanted = stored(items.select("item_id", "text").where("text IS NOT NULL").distinct())
    size = wanted.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    batches = max(1, -(-size.n // batch), -(-size.bytes // batch_bytes))
    own, kind = items.schema["item_id"].dataType, documents.schema["doc_id"].dataType
    out = spark.createDataFrame([], T.StructType([T.StructField("item_id", own), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", kind), T.StructField("score", T.LongType())]))
    for number in range(batches):
        chosen = wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(batches)) == number).collect()  # bounded by batch and batch_bytes
        texts = [sorted(set(terms_of(r.text))) for r in chosen]
        vocabulary = sorted(set().union(*texts))
        place = {t: k for k, t in enumerate(vocabulary)}
        lists = stored(forward_lists(documents, context.broadcast(vocabulary)))
        whole = lists.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("length")).first()
        if not whole.n:
            break
        df = np.zeros(len(vocabulary), np.int64)
        for row in holding(lists).collect():  # at most a row for each term of the batch
            df[row.term] = row.df
        weight = np.array([math.floor(1000 * math.log((2 * whole.n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        made = plan([[place[t] for t in terms] for terms in texts], len(vocabulary))
        best = _best(lists, context.broadcast((made, weight)), whole.n, whole.length, top)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        names = spark.createDataFrame([(k, r.item_id) for k, r in enumerate(chosen)], T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", own)]))
        mine = ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = mine if number == 0 else out.union(mine)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS terms FROM documents),
lengths AS (SELECT row, doc_id, len(terms)::BIGINT AS n FROM docs WHERE len(terms) > 0),
whole AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths),
asked AS (SELECT DISTINCT item_id, text, unnest(list_distinct({_TERMS})) AS term FROM benchmark),
tf AS (SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(terms) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM df, whole),
worth AS (
  SELECT row, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))) AS worth
  FROM tf JOIN weights USING (term) JOIN lengths USING (row), whole
),
scores AS (SELECT item_id, text, row, doc_id, sum(worth)::BIGINT AS score FROM asked JOIN worth USING (term) GROUP BY ALL HAVING sum(worth) > 0)
SELECT item_id, (row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM scores QUALIFY row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) <= {TOP}
"""
