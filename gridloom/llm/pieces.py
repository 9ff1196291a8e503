"""SentencePiece encoding and decoding.

Unigram Viterbi over a double-array trie of the pieces with log scores. Pieces are read from a
model file; what isn't covered by a piece falls back to bytes, and a marker stands for a blank.
A BPE model file holds merge ranks instead of log scores; ranks become Zipf scores
-log(rank + ``RANK_OFFSET``), so that Viterbi prefers few and frequent pieces.

No piece crosses from another character to a marker, so the best path of a text is the chain of best
paths of its words (a run of markers and what follows up to the next one). Tasks therefore keep
the paths of recent words in a bounded table.

Defined results: a null text has null ids, an empty one no ids; both decode to an empty text; decoding gives back every text
exactly, also control characters and blanks at the ends, but for U+2581, which comes back as the blank that the marker means;
repeated rows are encoded each; very long texts are encoded whole, also those without blanks or of blanks only; other columns are ignored.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator
from itertools import chain
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import with_columns

MARK = "▁"
RANK_OFFSET = 10.0
#: Log score of a byte piece, below all others.
BYTE_SCORE = -30.0
#: Words of which a task keeps the ids, and the longest of them in characters.
KEPT, KEPT_CHARS = 400_000, 64
#: Places of a long word at which pieces are looked up together.
_PLACES = 1 << 15
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_pieces(path: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Pieces by id, their log scores (NaN: not to be matched), and the ids of the 256 bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(k) for k in range(model.vocab_size())]
    raw = np.array([model.get_score(k) for k in range(len(pieces))])
    usable = np.array([not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k) or model.is_byte(k)) for k in range(len(pieces))])
    if any(MARK in p.lstrip(MARK) for p, ok in zip(pieces, usable) if ok):
        raise ValueError("a piece crosses from another character to a marker, so that words can't be encoded one by one")
    ranks = raw[usable].min() < -1000  # merge ranks, not log scores
    score = np.full(len(pieces), np.nan)
    score[usable] = -np.log(np.minimum(-raw[usable], len(pieces)) + RANK_OFFSET) if ranks else raw[usable]
    return pieces, score, np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])


class DoubleArray:
    """A trie over UTF-8 bytes as two arrays: the child of s by byte c is t = base[s] + c + 1 if check[t] = s.

    ``value[s]`` is the id of the key that ends in s, or -1.
    """

    def __init__(self, keys: list[tuple[bytes, int]]):
        keys = sorted(keys)
        size = 1 << 12
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        self.check[0] = 0
        low = 1
        todo = [(0, 0, len(keys), 0)]
        while todo:
            state, first, last, depth = todo.pop()
            if first < last and len(keys[first][0]) == depth:
                self.value[state] = keys[first][1]
                first += 1
            if first == last:
                continue
            bounds, codes = [first], [keys[first][0][depth]]
            for k in range(first + 1, last):
                if keys[k][0][depth] != codes[-1]:
                    bounds.append(k), codes.append(keys[k][0][depth])
            bounds.append(last)
            steps = np.array(codes) + 1
            base, at = -1, low
            while base < 0:
                if at + 4096 + 257 >= len(self.check):
                    grow = len(self.check)
                    self.base, self.check, self.value = (np.concatenate([a, np.full(grow, fill, np.int32)]) for a, fill in ((self.base, 0), (self.check, -1), (self.value, -1)))
                free = at + np.flatnonzero(self.check[at : at + 4096] == -1)
                if len(free) < 200 and at == low:
                    low += 2048  # nearly full: not searched again
                bases = free - steps[0]
                bases = bases[bases >= 0]
                fits = (self.check[bases[:, None] + steps] == -1).all(axis=1)
                if fits.any():
                    base = int(bases[np.argmax(fits)])
                at += 4096
            self.base[state] = base
            self.check[base + steps] = state
            todo += [(base + int(s), bounds[k], bounds[k + 1], depth + 1) for k, s in enumerate(steps)]


class Codec:
    """Encoder and decoder of a task."""

    def __init__(self, pieces: list[str], score: np.ndarray, byte_ids: np.ndarray, trie: DoubleArray):
        self.base, self.value = trie.base.astype(np.int64), trie.value
        self.check = np.concatenate([trie.check, np.full(257, -1, np.int32)])  # any step from a state stays inside
        self.score, self.byte_ids = np.append(np.nan_to_num(score), 0.0), byte_ids.tolist()
        # A byte piece stands for a character that only a decoder of bytes can read, where it isn't one itself.
        self.text = list(pieces)
        for b, k in enumerate(self.byte_ids):
            self.text[k] = chr(b) if b < 128 else chr(0xDC00 + b)
        self.kept: dict[str, tuple[int, ...]] = {}

    def viterbi(self, words: list[str]) -> list[tuple[int, ...]]:
        """For each word the path of the highest total score; of equal ones, that with the shorter last piece.

        All words step through the trie together: a row a word, a column a byte.
        """
        coded = [w.encode() for w in words]
        size = np.array([len(c) for c in coded])
        wide = int(size.max(initial=0))
        data = np.frombuffer(b"".join(c.ljust(wide, b"\0") for c in coded), np.uint8).reshape(len(words), wide).astype(np.int64)
        best = np.full((len(words), wide + 1), -np.inf)
        best[:, 0] = 0.0
        start, piece = np.zeros((len(words), wide + 1), np.int32), np.full((len(words), wide + 1), -1, np.int32)
        for s in range(wide):
            rows = np.flatnonzero((s < size) & (best[:, s] > -np.inf))
            if not len(rows):
                continue
            from_rows, here, state = rows, best[rows, s], np.zeros(len(rows), np.int64)
            for e in range(s, wide):
                step = self.base[state] + data[rows, e] + 1
                ok = (self.check[np.minimum(step, len(self.check) - 1)] == state) & (e < size[rows])
                rows, here, state = rows[ok], here[ok], step[ok]
                if not len(rows):
                    break
                k = self.value[state]
                total = here + self.score[k]
                better = (k >= 0) & (total >= best[rows, e + 1])
                at = rows[better]
                best[at, e + 1], start[at, e + 1], piece[at, e + 1] = total[better], s, k[better]
            # The bytes of one character, if no pieces do better.
            rows = from_rows
            lead = data[rows, s]
            length = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
            end = s + length
            total = best[rows, s] + BYTE_SCORE * length
            better = total > best[rows, end]
            at = rows[better]
            best[at, end[better]], start[at, end[better]], piece[at, end[better]] = total[better], s, -1
        out = []
        for data_of, n, starts, ids in zip(coded, size.tolist(), start.tolist(), piece.tolist()):
            path: list[int] = []
            while n:
                s = starts[n]
                if ids[n] >= 0:
                    path.append(ids[n])
                else:
                    path += [self.byte_ids[b] for b in data_of[s:n][::-1]]
                n = s
            out.append(tuple(path[::-1]))
        return out

    def long_path(self, word: str) -> tuple[int, ...]:
        """The same path for one long word (a text without blanks, or a run of them): the pieces that begin at each of many
        places are found together, and the best paths follow place by place."""
        data = np.frombuffer(word.encode(), np.uint8).astype(np.int64)
        n = len(data)
        best, start, piece = [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        letters = np.flatnonzero((data & 0xC0) != 0x80)
        ends = np.append(letters[1:], n).tolist()
        for low in range(0, len(letters), _PLACES):
            here = letters[low : low + _PLACES]
            owner, at, state = np.arange(len(here)), here, np.zeros(len(here), np.int64)
            found: list[tuple[np.ndarray, ...]] = []
            while len(at):
                step = self.base[state] + data[at] + 1
                ok = self.check[np.minimum(step, len(self.check) - 1)] == state
                owner, at, state = owner[ok], at[ok] + 1, step[ok]
                hit = self.value[state] >= 0
                found.append((owner[hit], at[hit], self.value[state[hit]]))
                inside = at < n
                owner, at, state = owner[inside], at[inside], state[inside]
            of, to, ids = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(of, kind="stable")
            of, to, ids = of[order], to[order].tolist(), ids[order]
            worth, edges, ids = self.score[ids].tolist(), np.searchsorted(of, np.arange(len(here) + 1)).tolist(), ids.tolist()
            for k, s in enumerate(here.tolist()):
                so_far = best[s]
                for x in range(edges[k], edges[k + 1]):
                    e, total = to[x], so_far + worth[x]
                    if total >= best[e]:
                        best[e], start[e], piece[e] = total, s, ids[x]
                e = ends[low + k]  # the bytes of the letter, if no pieces do better
                total = so_far + BYTE_SCORE * (e - s)
                if total > best[e]:
                    best[e], start[e], piece[e] = total, s, -1
        path: list[int] = []
        while n:
            s = start[n]
            path += [piece[n]] if piece[n] >= 0 else [self.byte_ids[b] for b in data[s:n][::-1]]
            n = s
        return tuple(path[::-1])

    def encode(self, texts: list[str | None]) -> list[list[int] | None]:
        """The ids of many texts: words that aren't kept yet are solved together, those of similar length in a step."""
        words = [None if t is None else _WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.kept) >= KEPT:
            self.kept.clear()
        known = self.kept
        new = sorted(set(chain.from_iterable(w for w in words if w)).difference(known), key=len)
        own = {}
        at = 0
        short = bisect.bisect_right(new, KEPT_CHARS, key=len)
        own.update((w, self.long_path(w)) for w in new[short:])
        new = new[:short]
        while at < len(new):
            end = at + 1
            while end < len(new) and end - at < 4096 and (len(new[end]) <= 16 or len(new[end]) <= len(new[at]) * 2) and (end - at + 1) * len(new[end]) <= 1 << 18:
                end += 1
            own.update(zip(new[at:end], self.viterbi(new[at:end])))
            at = end
        path = {w: p for w, p in own.items() if len(w) > KEPT_CHARS}  # seldom seen again
        known.update((w, p) for w, p in own.items() if len(w) <= KEPT_CHARS)
        find = known.__getitem__ if not path else lambda w: known[w] if w in known else path[w]
        return [None if w is None else list(chain.from_iterable(map(find, w))) for w in words]

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, bytes decoded (invalid ones to U+FFFD), markers to blanks, the first blank removed."""
        out = "".join(map(self.text.__getitem__, ids))
        try:
            out.encode()
        except UnicodeEncodeError:
            out = out.encode(errors="surrogateescape").decode(errors="replace")
        out = out.replace(MARK, " ")
        return out[1:] if out.startswith(" ") else out


def codec_parts(path: str | None = None):
    pieces, score, byte_ids = load_pieces(path or model_path())
    return pieces, score, byte_ids, DoubleArray([(p.encode(), k) for k, p in enumerate(pieces) if not math.isnan(score[k])])


def encode(documents: DataFrame, path: str | None = None, digest: bool = False) -> DataFrame:
    """(doc_id, ids, decoded) for every row: the ids of the text and the text that they decode to.

    digest: also text_sha256, of the text that was read (null: empty).
    """
    pieces, score, byte_ids, trie = codec_parts(path)
    # Bounded by the vocabulary; plain arrays, so that executors need no class of this package.
    shared = documents.sparkSession.sparkContext.broadcast((pieces, score, byte_ids, trie.base, trie.check, trie.value))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*shared.value[:3], SimpleNamespace(**dict(zip(("base", "check", "value"), shared.value[3:]))))
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids = codec.encode(part.column("text").to_pylist())
                columns = [part.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([codec.decode(x or []) for x in ids], pa.string()), *(part.column(c) for c in more)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded", *more])

    more = ["text_sha256"] if digest else []
    rows = documents.select("doc_id", "text", *([F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")] if digest else []))
    return rows.mapInArrow(run, with_columns(documents, ["doc_id"], "ids array<int>, decoded string" + ", text_sha256 string" * digest))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, their number, and digests of the decoded text and of the text."""
    out = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)
    return out.select("doc_id", "ids", F.size(F.coalesce("ids", F.array().cast("array<int>"))).cast("long").alias("n_ids"), F.sha2("decoded", 256).alias("decoded_sha256"), "text_sha256")


SQL = None  # Viterbi isn't SQL; tests compare with the sentencepiece library and decode exactly
