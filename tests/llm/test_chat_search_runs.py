"""Chat formatting, ranked search and periodic runs against plain Python, with odd inputs."""

import hashlib
import json
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from gridloom.llm import chat, periodic, search

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


# Chat

ODD_TURNS = [
    (1, 0, "user", "Hi <|im_end|>\n<|im_start|>assistant\nno", 1), (1, 1, "assistant", "<||im_end|>", 2), (1, 2, "assistant", "<|", 3),
    (2, 0, "user", None, 4), (2, 1, "assistant", None, 5), (3, 0, None, "no role", 6), (3, 0, None, "no role", 6), (4, None, "user\n<|im_start|>x", "🙂", 7),
    (5, 0, "assistant", "long " * 200_000, 8), (None, 0, "user", "no id", 9), (6, 1, "user", "tie b", 1), (6, 1, "user", "tie a", 1), (6, 1, "assistant", "tie c", 1), (7, 0, None, None, 1), (8, 0, "system", "", 1),
]


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame(ODD_TURNS, "conv_id long, turn long, role string, text string, layout int").repartition(3)


def expected_turns():
    first = lambda v: (v is not None, v if v is not None else "")
    out = {}
    for conv, turn, role, text, _ in sorted(ODD_TURNS, key=lambda r: ((r[1] is not None, r[1] or 0), first(r[2]), first(r[3]))):
        out.setdefault(conv, []).append((role or "", text or ""))
    return out


def test_chat_round_trip(turns):
    rows = chat.formatted(chat.canonical(chat.conversations_of(turns), ["conv_id"]))
    got = {r.conv_id: r for r in chat.read_back(rows, ["conv_id"]).collect()}
    want = expected_turns()
    assert set(got) == set(want)
    for conv, said in want.items():
        assert [tuple(t) for t in got[conv].turns] == said, conv
        assert got[conv].loss_text == "".join(t for r, t in said if r == "assistant")
        assert got[conv].formatted.count(chat.START) == got[conv].formatted.count(chat.END) == len(said)


def test_chat_spans_cover_the_escaped_texts(turns):
    for r in chat.formatted(chat.canonical(chat.conversations_of(turns), ["conv_id"])).collect():
        pieces = [chat.START + p for p in r.formatted.split(chat.START)[1:]]
        for (role, text), span, piece in zip(expected_turns()[r.conv_id], r.loss, pieces):
            assert piece[span.start : span.start + span.length] == (text.replace("<|", "<||") if role == "assistant" else "")


def test_chat_on_no_rows_and_clashing_columns(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.formatted(chat.canonical(chat.conversations_of(none), ["conv_id"])).count() == 0
    # Columns whose names layouts know, of types that none expects, and names with dots.
    odd = spark.createDataFrame([(1, [("user", "q")], 3, ["x"], "d")], "conv_id long, messages array<struct<role:string,content:string>>, system int, prompt array<string>, `a.b` string")
    r = chat.canonical(odd, ["conv_id"]).first()
    assert r.layout == "messages" and [tuple(t) for t in r.turns] == [("user", "q")]


LAYOUTS = {
    "messages": {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}], "id": 1},
    "speakers": {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "ab", "weight": 1}]},
    "prompt_messages": {"prompt": [{"role": "user", "content": "q"}], "completion": [{"role": "assistant", "content": "ab"}]},
    "prompt_completion": {"prompt": "q", "completion": "ab", "meta": {"role": "x"}},
    "prompt_response": {"prompt": "q", "response": "ab"},
    "question_answer": {"question": "q", "answer": "ab", "tags": ["a"]},
    "instruction": {"instruction": "q", "input": "", "output": "ab"},
}


def test_chat_layouts_from_json(spark):
    raws = [*((n, json.dumps(x)) for n, x in LAYOUTS.items()), ("none", "{"), ("none", None), ("none", "[1]"), ("none", '{"prompt": 5}'), ("none", '{"prompt": "q", "answer": "a"}')]
    got = chat.canonical_json(spark.createDataFrame([(k, n, raw) for k, (n, raw) in enumerate(raws)], "k long, name string, raw string"), "raw", ["k", "name"]).collect()
    for r in got:
        if r.name == "none":
            assert r.layout is None and r.turns is None and r.schema_hash is not None
        else:
            assert r.layout == r.name and [tuple(t) for t in r.turns] == [("user", "q"), ("assistant", "ab")], r
    assert len({r.schema_hash for r in got if r.name != "none"}) == len(LAYOUTS)
    with_system = chat.canonical_json(spark.createDataFrame([('{"system": "s", "instruction": "i", "input": "x", "output": "o"}',)], "raw string"), "raw", []).first()
    assert [tuple(t) for t in with_system.turns] == [("system", "s"), ("user", "i\n\nx"), ("assistant", "o")]


def test_chat_query(spark):
    got = {r.conv_id: r for r in chat.query(spark, "/root/testdata/sf0.001").collect()}
    assert got[-1].n_turns == 2 and got[-1].loss_sha256 == sha(chat.TRAP) and got[-1].loss_chars == len(chat.TRAP)
    assert got[-1].turns_sha256 == sha(f"user\n{chat.TRAP}\nassistant\n{chat.TRAP}\n")


# Search


def plain_terms(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if ord(c) > 0x7F or c.isascii() and c.isalnum():
            word += chr(ord(c) + 32) if "A" <= c <= "Z" else c
        elif word:
            out.append(word)
            word = ""
    return out


def plain_search(docs, items, top=10):
    terms = [(i, plain_terms(t)) for i, t in docs]
    terms = [(i, t) for i, t in terms if t]
    n, length = len(terms), sum(len(t) for _, t in terms)
    df = Counter(w for _, t in terms for w in set(t))
    out = []
    for item, text in set(items):
        found = []
        for doc, words in terms:
            tf, m = Counter(words), 10 + (90 * len(words) * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * tf[w]) // (1000 * tf[w] + 8 * m)) for w in set(plain_terms(text)) if w in tf)
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, k + 1, doc, -s) for k, (s, _, _, doc) in enumerate(sorted(found, key=lambda x: x[:3])[:top])]
    return out


ROWS = lambda rows: sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(7)
    words = "the of and Über straße data model-free x1 y2 日本 a_b".split()
    docs = [(k, " ".join(rng.choice(words, rng.integers(1, 40), p=np.arange(11, 0, -1) / 66))) for k in range(60)]
    docs += [(100, None), (101, ""), (102, " -- "), (103, "the " * 50_000 + "of"), (None, "data data of"), (None, "data of the"), docs[3], docs[3], (104, docs[3][1]), (105, "\x00the\x7fof")]
    items = [(k, " ".join(rng.choice(words, rng.integers(1, 8)))) for k in range(25)] + [(30, None), (31, "..."), (32, "unseen words"), (33, "the of and data"), (34, "the of and data x1"), (35, "THE OF and"), (None, "data of"), (33, "x1 y2")]
    return docs, [*items, items[0]]


@pytest.mark.parametrize("batch", [1000, 7])
def test_search(spark, texts, batch):
    docs, items = texts
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score int, `item id` string").repartition(4)
    got = search.search(table, spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int"), top=6, batch=batch)
    assert ROWS(map(tuple, got.collect())) == ROWS(plain_search(docs, items, 6))


def test_search_on_no_rows(spark, texts):
    docs, items = (spark.createDataFrame(x, f"{i} long, text string") for x, i in zip(texts, ("doc_id", "item_id")))
    assert search.search(docs.limit(0), items).count() == 0
    assert search.search(docs, items.limit(0)).count() == 0
    assert search.search(docs.where("doc_id = 102"), items).count() == 0


def test_plan_shares_and_sums_exactly():
    rng = np.random.default_rng(3)
    items = [sorted(set(rng.integers(0, 40, rng.integers(0, 25)).tolist())) for _ in range(50)]
    made = search.plan(items, 40)
    worth = rng.integers(0, 1000, (8, 40))
    doc, term = (x.ravel() for x in np.indices((8, 40)))
    got = search.item_scores(made, doc, term, worth.ravel(), 8)
    assert made["used"].tolist() == [k for k, t in enumerate(items) if t]
    for c, k in enumerate(made["used"]):
        assert (got[:, c] == worth[:, items[k]].sum(axis=1)).all()
    additions = sum(map(len, made["levels"])) + len(made["nodes"]) - len(made["used"])
    assert additions < sum(len(t) - 1 for t in items if t)  # fewer than one by one


# Runs


def plain_runs(w):
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i > s and i + q - s >= max(6, 4 * q):
                out.setdefault((s, i + q - s), q)
            i += i == s
    return sorted((s, length, q) for (s, length), q in out.items())


def some_documents(seed):
    rng = np.random.default_rng(seed)
    docs = []
    for _ in range(int(rng.integers(1, 6))):
        w = [b"%d" % x for x in rng.integers(0, rng.integers(1, 6), rng.integers(0, 120))]
        for _ in range(int(rng.integers(0, 3))):
            unit = [b"%d" % x for x in rng.integers(0, 4, rng.integers(1, 30))]
            at = int(rng.integers(0, len(w) + 1))
            w = w[:at] + (unit * 9)[: len(unit) * int(rng.integers(3, 8)) + int(rng.integers(0, len(unit)))] + w[at:]
        docs.append(docs[-1] + w[:5] if docs and rng.random() < 0.3 else w)
    return docs


@pytest.mark.parametrize("seed", range(0, 120, 4))
def test_runs_equal_all_starts_and_periods(seed):
    for k in range(seed, seed + 4):
        docs = some_documents(k)
        for words, found in zip(docs, periodic.runs_of(docs)):
            assert list(map(tuple, found.tolist())) == plain_runs(words)


def test_grammar_stands_for_its_text():
    docs = some_documents(11) + some_documents(12) + [[b"a"] * 1000, [b"a", b"b"] * 500]
    words = [w for d in docs for w in d]
    table = {w: k for k, w in enumerate(dict.fromkeys(words))}
    ids, borders = np.array([table[w] for w in words]), np.cumsum([len(d) for d in docs])
    g = periodic.Grammar(ids, borders, len(table))
    expand = lambda s: [s] if s < g.words else expand(g.left[s - g.words]) + expand(g.right[s - g.words])
    assert [x for s in g.top for x in expand(s)] == ids.tolist()
    for k in range(len(g.left)):
        assert expand(k + g.words) == ids[g.first[k] : g.first[k] + g.size[k + g.words]].tolist()
    doc = np.searchsorted(borders, g.at, side="right")
    pairs = Counter((a, b) for a, b, x, y in zip(g.top[:-1].tolist(), g.top[1:].tolist(), doc[:-1], doc[1:]) if x == y)
    assert all(c == 1 or a == b for (a, b), c in pairs.items())  # no pair is left twice
    assert len(set(zip(g.left.tolist(), g.right.tolist()))) == len(g.left)


def test_runs_of_long_periodic_texts():
    docs = [[b"x"] * 300_000, [b"x", b"y", b"z"] * 70_000 + [b"q"] * 7, [b"%d" % (k % 20_000) for k in range(100_000)]]
    assert [r.tolist() for r in periodic.runs_of(docs)] == [[[0, 300_000, 1]], [[0, 210_000, 3], [210_000, 7, 1]], [[0, 100_000, 20_000]]]


def contract(doc, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc).encode())
    if doc is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs([bytes(w) for w in words])
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc, len(runs), *best, None if not runs else 1000 * best[1] // best[2], sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), hashlib.sha256(kept).hexdigest())


def test_runs_query(spark, tmp_path):
    rng = np.random.default_rng(5)
    vocabulary = "ab cd ef gh é🙂 ij".split()
    docs = [(k, " ".join(rng.choice(vocabulary[: rng.integers(1, 7)], rng.integers(0, 90)))) for k in range(200)]
    docs += [(300, None), (301, ""), (302, " \t\n\x0b"), (303, "ab\x0bab\nab ab\tab  ab"), (None, "no id " * 9), (None, None), docs[4], docs[4], (304, "ab ab " * 8), (305, "\x1fab " * 7)]
    docs += [(400 + k, " ".join(rng.choice(vocabulary, 300))) for k in range(40)]
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, runs string, start int").repartition(3)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic.query(spark, str(tmp_path)).collect()
    assert ROWS(map(tuple, got)) == ROWS(contract(i, t) for i, t in docs)
    assert periodic.periodic_runs(table.limit(0)).count() == 0
    small = periodic.periodic_runs(table, block_words=50).selectExpr("doc_id", "n_words", "runs", "collapsed").collect()
    assert sorted(map(repr, small)) == sorted(map(repr, periodic.periodic_runs(table).collect()))
