"""Every stage of the pipeline against plain Python on what the stage before it kept."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from gridloom.llm import langid, packing, quality
from tests.conftest import DATA
from tests.llm.test_operators import ascii_lower, base, brute_fingerprint, brute_lines, sentence

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, rest string, removed string"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows before the first and after every stage, over small documents and odd rows, further columns included."""
    real = [tuple(r) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select(*corpus_pipeline.COLUMNS).orderBy("doc_id").limit(160).collect()]
    text = real[3][1]
    odd = [None, "", " \n", "½ 12 ①", "x" * 4000, text, text, text.upper(), text + " coda", real[5][1] * 30, "<|endoftext|> " + real[6][1], real[7][1] + "\n" + text]
    rows = [*real, *[(10_000 + k, t, "en" if k % 2 else None, None, None if t is None else len(t)) for k, t in enumerate(odd)]]
    rows += [rows[4], rows[4], (None, real[8][1] + " own words", "en", None, 5), (None, real[9][1], None, None, None), (None, None, None, None, None), (real[10][0], sentence(77, 90), "en", None, 9)]
    rows = [(*r, 0.5, "kept", "also kept") for r in rows]
    out, docs = [rows], spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, f"{DATA}/sf0.001").write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "packing":
            assert [f.simpleString() for f in docs.schema] == [f.simpleString() for f in spark.createDataFrame([], SCHEMA).schema]
        out.append([tuple(r) for r in docs.collect()])
    return out


def test_language(stages):
    before, after = stages[0], stages[1]
    learned = sorted({(r[2], r[0], r[1]) for r in before if r[1] is not None and r[2] is not None and not (r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 == 2)}, key=str)
    assert max(Counter(x[0] for x in learned).values()) <= langid.SAMPLE_ROWS
    sample = sorted((lang, text[: langid.SAMPLE_CHARS]) for lang, _, text in learned)
    model, margin = langid.Classifier(langid.dictionaries(sample)), langid.sample_margin(sample)
    assert Counter(after) == Counter(r for r in before if model.predict(r[1], margin)[2])
    assert 0.8 * len(before) < len(after) < len(before)


def test_quality(spark, stages):
    before, after = stages[1], stages[2]
    labels = spark.read.parquet(f"{DATA}/sf0.001/labels.parquet").collect()
    good = {r.doc_id for r in labels if r.quality == 1 and not r.toxic} - {r.doc_id for r in labels if r.quality == 0 or r.toxic}
    signed = lambda v: v - (1 << 64) if v >> 63 else v

    def buckets(text):
        hs = [xxhash.xxh64_intdigest(w, 42) for w in text.encode().split()]
        pairs = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42)) for a, b in zip(hs, hs[1:])]
        return [signed(x) % quality.BUCKETS for x in hs + pairs]

    raw, target = Counter(), Counter()
    for r in before:
        raw.update(buckets(r[1]))
        if r[0] in good:
            target.update(buckets(r[1]))
    R, T = sum(raw.values()), sum(target.values())

    def kept(text):
        n, _, _, _, again = base(text)
        if n < 10 or 100 * again > 20 * n:
            return False
        ratio = [math.log(target[b] / ((raw[b] + 1) / (R + quality.BUCKETS)) + quality.PRIOR) - math.log(T + quality.PRIOR) for b in buckets(text)]
        return not T or np.mean(ratio) >= quality.THRESHOLD

    assert Counter(after) == Counter(r for r in before if kept(r[1])) and len(after) < len(before)


def test_lines(stages):
    before, after = stages[2], stages[3]
    gone = brute_lines([r[:2] for r in before])

    def changed(r):
        lost = gone.get(r[:2], [])
        text = "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in lost)
        return (r[0], text, r[2], r[3], len(text) if lost else r[4], *r[5:])

    assert Counter(after) == Counter(map(changed, before)) and sum(map(len, gone.values())) > 10


def test_near_duplicates(stages):
    before, after = stages[3], stages[4]
    fps = sorted({int(brute_fingerprint(ascii_lower(r[1]))) for r in before})
    group = {x: x for x in fps}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 3:
                p, q = find(a), find(b)
                group[max(p, q)] = min(p, q)
    of = lambda r: find(int(brute_fingerprint(r[1])))
    least = {}
    for r in before:
        least.setdefault(of(r), []).append(math.inf if r[0] is None else r[0])
    assert Counter(map(of, after)) == Counter(dict.fromkeys(least, 1)) and not Counter(after) - Counter(before)
    assert all((math.inf if r[0] is None else r[0]) == min(least[of(r)]) for r in after) and len(after) < len(before)


def test_packing(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    before, after = stages[4], stages[5]
    code = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, spans = Counter(), {}
    for r in before:
        ids = np.array([*code.encode(r[1], add_special_tokens=False).ids, 1], "<u4")
        want.update((r[0], s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes()), len(ids)) for s in range(0, len(ids), 2048))
    assert Counter(r[:5] for r in after) == want
    for r in after:
        spans.setdefault(r[5], []).append((r[6], r[2]))
    for x in spans.values():
        x.sort()
        assert x[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(x, x[1:])) and sum(n for _, n in x) <= packing.LENGTH


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, f"{DATA}/sf0.001").count() == 0
