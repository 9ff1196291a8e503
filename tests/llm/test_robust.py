"""Long white space and words, odd column names, many copies of a row, and executors without the package."""

import os
import pickle
import subprocess
import sys
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import langid, packing, pieces, sharding

WHITE = [" " * 1_000_000, "\n" * 1_000_000, "word" + " \n" * 700_000 + "word", "<|endoftext|>" + "\t" * 1_100_000]


@pytest.mark.parametrize("special", [True, False])
def test_packing_of_long_white_space(spark, special):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = not special
    table = spark.createDataFrame([*enumerate(WHITE), (9, "a text")], "doc_id long, text string").repartition(4)
    got = packing.pack(table, special=special).select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()
    want = Counter()
    for k, text in [*enumerate(WHITE), (9, "a text")]:
        ids = np.array([*plain.encode(text, add_special_tokens=False).ids, 1], "<u4")
        want.update((k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes()), len(ids)) for s in range(0, len(ids), 2048))
    assert Counter(map(tuple, got)) == want


def test_long_words_take_the_same_path():
    codec = pieces.Codec(*pieces.codec_parts())
    rng = np.random.default_rng(6)
    letters = list("aeinrstüé🙂\x01日本語") + ["the", "ing"]
    for _ in range(150):
        word = pieces.MARK * int(rng.integers(0, 40)) + "".join(rng.choice(letters, int(rng.integers(1, 150))))
        assert codec.long_path(word) == codec.viterbi([word])[0]
    for text in ("日本語の文章です" * 7_500, " " * 20_000, "abc" * 40_000, "🙂" * 10_000):
        began = time.process_time()
        ids = codec.encode([text])[0]
        assert codec.decode(ids) == text and time.process_time() - began < 3




@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_with_odd_columns(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(*corpus_pipeline.COLUMNS)
    alone = stage(spark, docs, "/root/testdata/sf0.001")
    more = [F.lit(1), F.lit("x"), F.lit(None).cast("int"), F.array(F.lit(1)), F.lit(2), F.struct(F.lit(1).alias("x y"), F.lit("s").alias("p.q")), F.lit("r"), F.lit("T"), F.lit(3), F.lit(4), F.col("doc_id").cast("int"), F.lit(6)]
    odd = docs.select(*corpus_pipeline.COLUMNS, *more).toDF(*corpus_pipeline.COLUMNS, "a b", "a-b", "_", "a.b", "removed ", "removed", "rest", "Text", "c0", "fp", "column_5", "a`b")
    out = stage(spark, odd, "/root/testdata/sf0.001")
    if name == "packing":
        assert Counter(map(tuple, out.select("doc_id", "start", "ids_crc32").collect())) == Counter(map(tuple, alone.select("doc_id", "start", "ids_crc32").collect()))
        return
    assert out.columns == odd.columns
    rows = out.collect()
    assert Counter(tuple(r)[:5] for r in rows) == Counter(map(tuple, alone.collect()))
    assert all(r[5] == 1 and r[10].asDict() == {"x y": 1, "p.q": "s"} and r[12] == "T" and r[15] == r[0] for r in rows)


def test_many_copies_of_a_row(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK", 50)
    table = spark.range(1234).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same").alias("text")).union(spark.createDataFrame([(2, "x"), (None, None)], "doc_id long, text string"))
    got = sharding.shard(table, 4).collect()
    assert sorted(r.row_number for r in got) == list(range(1236)) and len({(r.shard, r.slot) for r in got}) == 1236
    assert Counter(r.doc_id for r in got) == {1: 1234, 2: 1, None: 1}


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 3)
    table = spark.createDataFrame([(k, "some text", f"l{k}") for k in range(5)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="over 3 different"):
        langid.training_sample(table)
    assert len(langid.training_sample(table.where("doc_id < 3"))) == 3


def test_broadcasts_hold_plain_values(spark, monkeypatch):
    """What is broadcast or shipped to tasks can be read where the package is absent."""
    sent = []
    context = spark.sparkContext
    real = type(context).broadcast
    monkeypatch.setattr(type(context), "broadcast", lambda self, value: sent.append(value) or real(self, value))
    table = spark.createDataFrame([(k, f"line one\nline {k} two\nline one") for k in range(8)], "doc_id long, text string")
    from gridloom.llm import line_dedup, search

    pieces.encode(table).count(), line_dedup.dedup_lines(table).count(), search.search(table, table.withColumnRenamed("doc_id", "item_id")).count()
    assert len(sent) > 4
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = "import pickle, sys; [pickle.loads(x) for x in pickle.load(sys.stdin.buffer)]; print('fine')"
    done = subprocess.run([sys.executable, "-c", code], cwd="/tmp", env=env, input=pickle.dumps([pickle.dumps(x) for x in sent]), capture_output=True)
    assert done.stdout.strip() == b"fine", done.stderr[-500:]
