"""Operators of the subpackage against brute force, libraries and round trips, with odd inputs."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from gridloom.llm import common, exact_dedup, langid, line_dedup, lm_score, packing, pieces, quality, sharding, simhash, warc

SCHEMA = "doc_id long, text string, lang string, n long, h string, words string, removed string, token long"
SCHEMA_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(seed, n=12):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def odd_rows():
    """Nulls anywhere, empty and blank texts, ties, repeated rows, a very long text, no letters; clashing extra columns."""
    texts = [None, "", " \t\n", "One Two", "one two", "One Two", "ÉCOLE École école", "123 456!", sentence(1), sentence(1), sentence(2) + "\n" + sentence(3) + "\n" + sentence(2), sentence(4, 30_000), sentence(5) + "\n\n" + sentence(1), "x" * 5000, "a▁b 🙂 \x00\x1f end ", "<|endoftext|> is text"]
    rows = [(k * 10, t, None if k % 5 == 0 else "en", None, "h", None, "r", k) for k, t in enumerate(texts)]
    return [*rows, rows[8], (None, "no id", "en", 1, None, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


# 1


def test_pieces_agree_with_the_library(tmp_path):
    """A model file whose type is set to unigram and whose scores are ours: the library must give the same totals and mostly the same ids."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    names, score, byte_ids, trie = pieces.codec_parts()
    model = pb.ModelProto()
    with open(pieces.model_path(), "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for k, p in enumerate(model.pieces):
        if not math.isnan(score[k]):
            p.score = float(score[k])
    lib = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    codec = pieces.Codec(names, score, byte_ids, trie)
    total = lambda ids: sum(score[k] if not math.isnan(score[k]) else pieces.BYTE_SCORE for k in ids)
    for text in [sentence(k) for k in range(20)] + ["Grüße aus  Köln", "  two  blanks ", "plain 12345 text.", "den Nachbarn übersehen"]:
        ours, theirs = codec.encode([text])[0], lib.encode(text)
        assert abs(total(ours) - total(theirs)) < 1e-3
        assert codec.decode(ours) == text


def test_double_array_finds_exactly_its_keys():
    keys = sorted({w[:k].encode() for w in WORDS for k in range(1, len(w) + 1, 2)} | {"é".encode(), "éa".encode()})
    trie = pieces.DoubleArray([(k, n) for n, k in enumerate(keys)])

    def find(word):
        s = 0
        for c in word:
            t = trie.base[s] + c + 1
            if t >= len(trie.check) or trie.check[t] != s:
                return -1
            s = t
        return trie.value[s]

    assert [find(k) for k in keys] == list(range(len(keys)))
    assert find(b"zzz") == -1 and find(keys[0] + b"\xff") == -1


def test_pieces_on_odd_rows(odd, none):
    got = {r.doc_id: r for r in pieces.encode(odd).collect()}
    assert got[0].ids is None and got[0].decoded == "" and got[10].ids == []
    for i, t, *_ in odd_rows():
        if i is not None:
            assert got[i].decoded == (t or "").replace("▁", " ")
    assert pieces.encode(odd).count() == len(odd_rows()) and pieces.encode(none).count() == 0
    digests = {r.doc_id: r.text_sha256 for r in pieces.encode(odd, digest=True).collect()}
    assert digests[30] == hashlib.sha256(b"One Two").hexdigest() and digests[0] == hashlib.sha256(b"").hexdigest()


def test_words_of_all_lengths_take_the_best_path():
    """Against a plain search over all cuts, ties included, for words of ASCII, of several bytes and with uncovered characters."""
    names, score, byte_ids, trie = pieces.codec_parts()
    codec = pieces.Codec(names, score, byte_ids, trie)
    known = {p: score[k] for k, p in enumerate(names) if not math.isnan(score[k])}
    rng = np.random.default_rng(4)
    words = ["▁" + "".join(rng.choice(list("aeinrstüé🙂\x01日"), rng.integers(1, 12))) for _ in range(300)] + ["▁▁▁", "▁", "▁" + "ab" * 200]

    def best(word):
        top = [0.0] + [-math.inf] * len(word)
        for e in range(1, len(word) + 1):
            top[e] = max(top[e - 1] + pieces.BYTE_SCORE * len(word[e - 1].encode()), *(top[s] + known[word[s:e]] for s in range(max(0, e - 24), e) if word[s:e] in known), -math.inf)
        return top[-1]

    for word, ids in zip(words, codec.viterbi(words)):
        total = sum(score[k] if not math.isnan(score[k]) else pieces.BYTE_SCORE for k in ids)
        assert abs(total - best(word)) < 1e-6, word
        assert codec.decode(list(ids)) == word.replace("▁", " ")[1:]


# 2


def feistel(x, a, b, seed):
    h = lambda v, k: xxhash.xxh64_intdigest(int(k).to_bytes(4, "little"), xxhash.xxh64_intdigest(int(v).to_bytes(8, "little"), 42))
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    left, right = divmod(x, b)
    for k in range(sharding.ROUNDS):
        left = (left + signed(h(right, seed * 1000 + k)) % a) % a
        right = (right + signed(h(left, seed * 1000 + k)) % b) % b
    return left * b + right


def test_sharding(odd, none):
    got = sharding.shard(odd, 5).collect()
    n = len(odd_rows())
    assert sorted(r.row_number for r in got) == list(range(n))
    a = max(1, math.isqrt(n - 1) + 1)
    b = -(-n // a)
    for r in got:
        y = feistel(r.row_number, a, b, 7)
        while y >= n:
            y = feistel(y, a, b, 7)
        assert (r.shard, r.slot) == (y % 5, y // 5)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    body = {i: (t or "").encode() for i, t, *_ in odd_rows() if i is not None}
    assert all(r.size == len(body[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(body[r.doc_id]) for r in got if r.doc_id is not None)
    assert sharding.shard(none).count() == 0


# 3


def base(text):
    words = [w for w in (text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    often = Counter(windows)
    covered = {k + d for k, w in enumerate(windows) if often[w] > 1 for d in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, odd, none):
    labels = spark.createDataFrame([(80, 1, 0), (80, 1, 0), (100, 1, None), (999, 1, 0), (None, 1, 0), (110, 0, 0), (120, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality(odd, labels, threshold=-0.05).collect()}
    for i, t, *_ in odd_rows():
        if i is not None:
            r, e = got[i], base(t)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == e, i
            assert r.base_failed == (e[0] < 10 or 100 * e[4] > 20 * e[0])
    assert got[0].llr == 0.0 and not got[0].kept
    h = lambda *ws: ws
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    xx = lambda s, seed=42: xxhash.xxh64_intdigest(s, seed)
    long8 = lambda v: v.to_bytes(8, "little")

    def buckets(text):
        hs = [xx(w.encode()) for w in (text or "").split()]
        return [signed(x) % quality.BUCKETS for x in hs] + [signed(xx(long8(b), xx(long8(a)))) % quality.BUCKETS for a, b in zip(hs, hs[1:])]

    raw, target = Counter(), Counter()
    for i, t, *_ in odd_rows():
        raw.update(buckets(t))
        if i in (80, 100):
            target.update(buckets(t))
    R, T = sum(raw.values()), sum(target.values())
    for i, t, *_ in odd_rows():
        if i is not None and buckets(t):
            share = lambda b: (raw[b] + 1) / (R + quality.BUCKETS)
            llr = np.mean([math.log(target[b] / share(b) + quality.PRIOR) - math.log(T + quality.PRIOR) for b in buckets(t)])
            assert abs(got[i].llr - llr) < 2e-6, i
    assert quality.quality(none, labels).count() == 0
    assert quality.quality(odd, labels.limit(0), carry=["words"]).count() == len(odd_rows())


# 4


def test_lm_score(spark, none):
    rows = [(k, t) for k, t in [(0, None), (1, ""), (2, "A b c a b"), (3, "a b c d"), (4, "a b c d"), (5, "z"), (6, " q q\tq "), (None, "b c d e")]]
    got = lm_score.score(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    docs = [(i, ascii_lower(t or "").split()) for i, t in rows]
    for r in got:
        words = next(w for i, w in docs if i == r.doc_id)
        at = next(k for k, (i, _) in enumerate(docs) if i == r.doc_id)
        c = Counter(tuple(w[k : k + o]) for n, (_, w) in enumerate(docs) if n != at for o in (1, 2, 3) for k in range(len(w) - o + 1))
        rest = max(1, sum(len(w) for n, (_, w) in enumerate(docs) if n != at))
        total = 0.0
        for k in range(len(words)):
            deep = min(k, 2)
            for o in range(deep, -1, -1):
                g = tuple(words[k - o : k + 1])
                if c[g]:
                    total += math.log(c[g] / (c[g[:-1]] if o else rest)) + (deep - o) * math.log(0.4)
                    break
            else:
                total += math.log(0.4 / rest) + deep * math.log(0.4)
        assert r.n_words == len(words) and abs(r.lm_sum - total) < 1e-9
        assert (r.lm_mean is None) == (not words)
    assert lm_score.score(none).count() == 0


def test_lm_score_on_odd_rows(spark, odd):
    """A very long text, clashing columns and repeated rows: words, known ones and sums add up."""
    got = lm_score.score(odd).collect()
    assert len(got) == len(odd_rows())
    text = {i: t for i, t, *_ in odd_rows() if i is not None}
    for r in got:
        if r.doc_id is not None:
            assert r.n_words == len((text[r.doc_id] or "").encode().split()) == r.n_unseen + r.n_unigram + r.n_bigram + r.n_trigram
            assert (r.lm_mean is None) == (r.n_words == 0) and (r.n_words == 0 or r.lm_sum < 0)
    assert all(r.n_trigram == r.n_words - 2 for r in got if r.doc_id in (80, 90))  # each is known from its copy


def test_blocks_survive_packing():
    v = np.sort(np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64))
    assert (lm_score.unpacked(lm_score.packed(v)) == v).all()
    assert (lm_score.spread(lm_score.squeezed(np.arange(300))) == np.arange(300)).all()


# 5


def brute_lines(rows, least=1):
    """{(doc_id, text): [numbers of lines that go]}; rows that repeat both are one document, null ids come last, then text hashes decide."""
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    docs = sorted({(2**63 - 1 if i is None else i, signed(xxhash.xxh64_intdigest(t.encode(), 42)), i, t) for i, t in rows if t}, key=lambda d: d[:2])
    lines = [((i, t), k, set(x.encode().split())) for _, _, i, t in docs for k, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if len(x[2]) >= least]
    gone = defaultdict(list)
    for b, (doc, k, words) in enumerate(lines):
        if any(5 * len(words & w) >= 4 * len(words | w) for _, _, w in lines[:b]):
            gone[doc].append(k)
    return gone


def check_lines(spark, rows, parts=3, **how):
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), **how).collect()
    want = brute_lines(rows, how.get("min_words", 1))
    for_row = lambda i, t: (i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want.get((i, t), ())) if t else t, tuple(want.get((i, t), ())))
    assert Counter((r.doc_id, r.text, tuple(r.removed)) for r in got) == Counter(for_row(i, t) for i, t in rows)
    return want


def varied_lines(seed, docs=120):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    seeds = [list(rng.choice(vocabulary, 14, replace=False)) for _ in range(12)]
    rows = []
    for i in range(docs):
        lines = []
        for _ in range(3):
            words = list(seeds[rng.integers(12)])
            for _ in range(rng.integers(0, 4)):
                words[rng.integers(14)] = str(rng.choice(vocabulary))
            lines.append(" ".join(rng.permutation(words)))
        rows.append((i, "\n".join(lines)))
    return rows


def test_line_dedup(spark, none, odd):
    rows = varied_lines(5)
    rows += [(200, None), (201, ""), (202, "a b\na b\n"), (None, rows[0][1])]
    assert sum(map(len, check_lines(spark, rows).values())) > 100
    check_lines(spark, rows, min_words=5)
    out = line_dedup.dedup_lines(odd)
    assert out.columns == [c for c in SCHEMA_COLUMNS if c != "removed"] + ["removed"]
    out = out.collect()
    assert len(out) == len(odd_rows())
    by = {r.doc_id: r for r in out}
    assert by[0].text is None and by[100].text == sentence(2) + "\n" + sentence(3) and by[90].text == "" and by[120].text == sentence(5) + "\n"
    assert all(r.h == "h" and r.token is not None for r in out if r.doc_id is not None)
    assert line_dedup.dedup_lines(none).count() == 0


def test_rows_with_one_id_keep_their_own_lines(spark):
    rows = [(1, "a b c d e f"), (None, "a b c d e f"), (None, "totally unrelated unique words stand here"), (7, "first text of seven\nshared line here"), (7, "second text of seven, another\nshared line here"), (7, "second text of seven, another\nshared line here"), (None, None)]
    want = check_lines(spark, rows)
    assert want[None, "a b c d e f"] == [0] and not want.get((None, rows[2][1]))


def test_hot_lists_are_cut_by_size_and_stay_exact(spark, monkeypatch):
    """Every word is hot, lists are long, the second pass runs, and the blocks are small."""
    monkeypatch.setattr(line_dedup, "HOT_LINES", 1)
    monkeypatch.setattr(line_dedup, "SHORT", 4)
    monkeypatch.setattr(line_dedup, "ROWS", 64)
    monkeypatch.setattr(line_dedup, "BLOCK_BYTES", 500)
    rng = np.random.default_rng(3)
    rows = varied_lines(6, 100) + [(1000 + k, " ".join(rng.choice(WORDS, rng.integers(1, 16)))) for k in range(200)]
    assert sum(map(len, check_lines(spark, rows, 2).values())) > 100


def test_lists_compared_together_and_alone_give_the_same_pairs(monkeypatch):
    """Both ways of comparing lists against all pairs; windows of sizes, guests, rows that aren't asked, first partners only."""
    rng = np.random.default_rng(11)
    length = [1, 700, 2, 90, 1, 300]
    run = np.repeat(np.arange(len(length)), length)
    n = rng.integers(1, 60, len(run)).astype(np.int32)
    pos = (rng.integers(0, 1 << 30, len(run)) % (n - -(-4 * n // 5) + 1)).astype(np.int32)
    pos = np.where(rng.random(len(run)) < 0.2, -1 - pos, pos)
    rows = [n, pos, *(rng.integers(0, 16, len(run), dtype=np.uint64) for _ in range(2))]
    p, q = np.nonzero((run[:, None] == run[None]) & np.tri(len(run), k=-1, dtype=bool).T)
    every = defaultdict(list)
    for a, b in zip(*(x[line_dedup._near(rows, p, q, (4, 5))].tolist() for x in (p, q))):
        every[b].append(a)
    assert sum(map(len, every.values())) > 1000
    for asked in (np.ones(len(run), bool), rng.random(len(run)) < 0.3):
        for most in (1, 3, 2**63 - 1):
            want = sorted((a, b, len(v) > most) for b, v in every.items() if asked[b] for a in v[:most])
            assert sorted(zip(*(x.tolist() for x in line_dedup._in_short_lists(rows, run, asked, most, (4, 5))))) == want
            alone = []
            for k in range(len(length)):
                mine = np.flatnonzero(run == k)
                a, b, more = line_dedup._in_long_list([x[mine] for x in rows], asked[mine], most, (4, 5))
                alone += zip(mine[a].tolist(), mine[b].tolist(), more.tolist())
            assert sorted(alone) == want


def test_word_hashes_by_pieces(monkeypatch):
    """A word's hash depends on the word alone, wherever pieces end and however long words are."""
    texts = [b"", b" ", b"a", b"  a b\nc ", b"x" * 70_000 + b" y " + b"z" * 40_000, b" " * 100_000 + b"q", sentence(9, 2000).encode()]
    for data in texts:
        words = data.split()
        h, start = common.word_hashes(data)
        assert [data[a : a + len(w)] for a, w in zip(start.tolist(), words)] == words and len(h) == len(words)
        one = [int(common.word_hashes(w)[0][0]) for w in words[:50]]
        assert h[:50].tolist() == one
        with monkeypatch.context() as m:
            m.setattr(common, "PIECE_BYTES", 7)
            assert np.array_equal(common.word_hashes(data[:5000])[0], common.word_hashes(data[:5000] + b" ")[0])
            assert np.array_equal(common.word_hashes(data)[0], h)


# 6


def test_language_id(spark, odd, none):
    from tests.conftest import DATA

    found = langid.query(spark, f"{DATA}/sf0.01")
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "lang")
    held = found.join(docs, "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    got = langid.identify(odd, odd).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(odd_rows())
    assert all(by[i].lang_pred == "und" and by[i].score == 0 and not by[i].accepted for i in (0, 10, 20, 70))
    assert by[80].lang_pred == "en"
    assert langid.identify(none, none).count() == 0
    letters = spark.createDataFrame([(1, "½² ①", None), (2, "½ a", None)], "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in langid.identify(letters, odd).collect()} == {1: "und", 2: "en"}
    assert {r.lang_pred for r in langid.identify(odd, none).collect()} == {"und"}


def test_classifier_against_a_plain_loop():
    """Sizes of every language, ties by name, the margin rule, and a text of several blocks."""
    import zstandard

    content = {"xx": b"alpha beta gamma " * 20, "aa": b"uno dos tres cuatro " * 20, "ab": b"uno dos tres cuatro " * 20}
    model = langid.Classifier(content)
    for text in ["uno dos tres", "ALPHA beta 12 gamma", sentence(7, 3000)]:
        clean = langid.normalised(text)
        sizes = {}
        for lang, data in content.items():
            c = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)
            sizes[lang] = sum(len(c.compress(clean[k : k + langid.BLOCK].encode())) for k in range(0, len(clean), langid.BLOCK))
        first, second = sorted(sizes, key=lambda x: (sizes[x], x))[:2]
        for margin in (0.0, 0.02, 0.5):
            assert model.predict(text, margin) == (first, 1 - sizes[first] / sizes[second], sizes[second] >= sizes[first] * (1 + margin))


def test_training_sample_stays_bounded_with_repeated_rows(spark):
    rows = [(1, "same text", "en")] * 500 + [(k, f"text {k}", "en") for k in range(2, 400)]
    sample = langid.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=50)
    assert len(sample) == 50 and len(set(sample)) == 50


# 7


def brute_fingerprint(text):
    words = ascii_lower(text or "").replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(odd, none):
    got = {r.doc_id: r for r in simhash.near_duplicates(odd).collect()}
    for i, t, *_ in odd_rows():
        if i is not None:
            assert got[i].fingerprint == f"{brute_fingerprint(t):016x}"
    assert got[0].component_id == got[10].component_id == got[20].component_id == 0
    assert simhash.near_duplicates(none).count() == 0


def test_components_against_all_pairs(spark):
    rng = np.random.default_rng(9)
    centres = rng.integers(0, 2**64, 12, dtype=np.uint64)
    fps = set()
    for c in centres.tolist() + [0]:
        for _ in range(40):
            x = c
            for b in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    pairs = simhash.close_pairs(spark.createDataFrame([(x,) for x in signed], "fp long"))
    from gridloom.llm.common import components

    got = {r.node: r.component for r in components(pairs).collect()}
    group = {x: x for x in signed}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                p, q = sorted((find(signed[a]), find(signed[b])))
                group[q] = p
    assert all(got.get(x, x) == find(x) for x in signed)


def test_components_of_long_paths_and_random_graphs(spark):
    from gridloom.llm.common import components

    rng = np.random.default_rng(10)
    order = rng.permutation(3000)
    path = [(int(a), int(b)) for a, b in zip(order, order[1:])]
    more = [(int(a) + 10_000, int(b) + 10_000) for a, b in rng.integers(0, 800, (500, 2))]
    got = {r.node: r.component for r in components(spark.createDataFrame(path + more + [(5, 5)], "a long, b long"), max_rounds=20).collect()}
    group = {}

    def find(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    for a, b in path + more:
        p, q = sorted((find(a), find(b)))
        group[q] = p
    assert all(got.get(x, x) == find(x) for x in list(group))


# 8


def test_exact_dedup(odd, none):
    groups = defaultdict(list)
    for i, t, *_ in odd_rows():
        groups[ascii_lower(t or "")].append(i)
    got = exact_dedup.exact_dedup(odd).collect()
    want = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in got) == want
    assert exact_dedup.exact_dedup(none).count() == 0


def test_heavy_groups_give_the_same_result(spark):
    rows = [(k, "Hot" if k % 3 == 0 else f"t{k % 500}") for k in range(6000)]
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), tracked=64, most=8).collect()}
    assert got[0].group_size == 2000 and got[0].keep_id == 5997 and sum(r.kept for r in got.values()) == len({t for _, t in rows})


# 9


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "é" * 200
    rows = [(5, "http://a/x y\r\nz", big), (3, None, big), (3, None, big), (9, "http://b", None), (None, "http://n", big), (7, "u", "short"), (8, "v", "short")] + [(k, f"http://c/{k}", "<html>" + sentence(k, 80)) for k in range(20, 60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    manifests = []
    for name in ("a", "b"):
        path = "file://" + str(tmp_path / name)
        manifest = warc.write(df.repartition(3 if name == "a" else 5), path, min_shards=4, roll_bytes=2000)
        manifests.append(sorted((m.name, m.bytes, m.records, m.sha256) for m in manifest.collect()))
        got = warc.read(spark, path).collect()
        assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == Counter((i, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()) for i, _, h in rows)
        same = [r for r in got if r.payload_bytes == len(big.encode())]
        assert [r.page_id for r in same if r.record_type == "response"] == [3] and all(r.refers_to == 3 for r in same if r.record_type == "revisit")
        assert all(r.record_type == "response" for r in got if r.payload_bytes < 100)
        assert all(bytes(r.payload).decode() == dict((i, h) for i, _, h in rows)[r.page_id] for r in got if r.record_type == "response" and r.payload_bytes)
    assert manifests[0] == manifests[1] and len(manifests[0]) > 4
    odd = spark.createDataFrame([(1, "u", "<b>" * 400_000, "x", 3, None), (2, None, "", None, None, "d"), (2, None, "", None, None, "d")], "page_id long, url string, html string, digest string, shard int, payload string")
    path = "file://" + str(tmp_path / "odd")
    warc.write(odd, path, roll_bytes=100)
    assert Counter((r.page_id, r.payload_bytes) for r in warc.read(spark, path).collect()) == Counter({(1, 1_200_000): 1, (2, 0): 2})
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.write(none, "file://" + str(tmp_path / "c")).count() == 0 and warc.read(spark, "file://" + str(tmp_path / "c")).count() == 0


# 10


def test_cutting_stock_covers_demand():
    rng = np.random.default_rng(2)
    for n in (0, 1, 40, 3000):
        demand = np.bincount(np.minimum(64, rng.integers(1, 70, n)) - 1, minlength=64).astype(np.int64)
        patterns = packing.cutting_stock(demand)
        assert (sum((p * c for p, c in patterns), np.zeros(64, np.int64)) == demand).all()
        assert all((p * np.arange(1, 65)).sum() <= 64 for p, _ in patterns)
        if n == 3000:
            assert sum(c for _, c in patterns) <= 1.02 * (demand * np.arange(1, 65)).sum() / 64 + 2


def test_packing(spark, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(odd, special=True).collect()
    ids = {i: [*reference.encode(t or "", add_special_tokens=False).ids, 1] for i, t, *_ in odd_rows() if i is not None}
    for r in got:
        if r.doc_id is not None:
            part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
            assert len(part) == r.length and r.ids_crc32 == zlib.crc32(part.tobytes()) and r.doc_tokens == len(ids[r.doc_id])
    for i in set(ids):
        copies = sum(1 for j, *_ in odd_rows() if j == i)
        assert sum(r.length for r in got if r.doc_id == i) == copies * len(ids[i])
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(n for _, n in spans) <= 2048
    assert packing.pack(none).count() == 0


def test_packing_pads_little(spark):
    from tests.conftest import DATA

    got = packing.pack(spark.read.parquet(f"{DATA}/sf0.01/documents.parquet"), special=True).groupBy("sequence_id").sum("length").collect()
    assert sum(r[1] for r in got) > 0.98 * 2048 * len(got)
