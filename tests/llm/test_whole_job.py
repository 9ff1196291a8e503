"""The operators as the queries call them do the whole job: nothing short, rare or special is left out."""

import zlib

import numpy as np

import corpus_pipeline
from gridloom.llm import langid, line_dedup, packing
from tests.conftest import DATA


def brute_lines(rows):
    lines = sorted((i, k, frozenset(x.split())) for i, t in rows if t for k, x in enumerate(t.split("\n")) if x.strip())
    gone = {}
    for b, (doc, k, words) in enumerate(lines):
        if any(5 * len(words & w) >= 4 * len(words | w) for _, _, w in lines[:b]):
            gone.setdefault(doc, []).append(k)
    return gone


def test_short_lines_are_deduplicated(spark):
    rng = np.random.default_rng(11)
    vocabulary = [f"w{k}" for k in range(14)]
    rows = [(i, "\n".join(" ".join(rng.choice(vocabulary, rng.integers(0, 7))) for _ in range(3))) for i in range(80)]
    rows += [(100 + k, "Menu\n\nread more now\n") for k in range(40)]
    rows += [(200, "one two three four"), (201, "one two three four five"), (202, "one two three six")]
    out = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    want = brute_lines(rows)
    assert {i: r.removed for i, r in out.items() if r.removed} == want
    assert out[100].text == "Menu\n\nread more now\n" and all(out[100 + k].text == "\n" for k in range(1, 40))
    assert out[201].removed == [0] and out[202].removed == []


def test_noise_is_rejected_and_real_texts_are_not(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rng = np.random.default_rng(12)
    noise = [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 10))) for _ in range(n)) for n in (200, 2000) for _ in range(40)]
    long = [[r.text[:600].split() for r in docs.where(f"lang = '{lang}' AND n_chars > 600").orderBy("doc_id").limit(40).collect()] for lang in ("en", "de")]
    mixed = [" ".join(w for pair in zip(*texts) for w in pair) for texts in zip(*long)]  # English and German words in turn
    rows = [(10**9 + k, t, None) for k, t in enumerate(noise)] + [(2 * 10**9 + k, t, None) for k, t in enumerate(mixed)]
    training = docs.where(~langid.held_out())
    got = langid.identify(docs.where(langid.held_out()).unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string")), training).collect()
    accepted = lambda low, high: np.mean([r.accepted for r in got if low <= r.doc_id < high])
    assert accepted(10**9, 2 * 10**9) == 0
    assert accepted(0, 10**9) > 0.97
    assert accepted(2 * 10**9, 3 * 10**9) < 0.5


def test_every_language_is_learned(spark):
    rng = np.random.default_rng(13)
    words = {f"l{k:03d}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(30)] for k in range(70)}
    rows = [(100 * k + n, " ".join(rng.choice(w, 40)), lang) for k, (lang, w) in enumerate(words.items()) for n in range(2 + (k < 64))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, docs).collect()}
    assert set(got.values()) == set(words) and all(got[i] == lang for i, _, lang in rows)


def test_special_strings_are_their_own_ids(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|><|endoftext|>\n\n y", "<|endoftext|", "<|ENDOFTEXT|> plain", "Grüße  <|endoftext|>é" + " word <|endoftext|>" * 2000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for out in (packing.query(spark, str(tmp_path)), corpus_pipeline.pack_sequences(spark, docs, str(tmp_path))):
        got = {(r.doc_id, r.start): (r.length, r.ids_crc32, r.doc_tokens) for r in out.collect()}
        want = {}
        for k, text in enumerate(texts):
            ids = np.array([*reference.encode(text, add_special_tokens=False).ids, 1], "<u4")
            for s in range(0, len(ids), 2048):
                part = ids[s : s + 2048]
                want[k, s] = (len(part), zlib.crc32(part.tobytes()), len(ids))
        assert got == want
