"""How the lists of line dedup travel, and what they cost."""

import numpy as np

from gridloom.llm import line_dedup

ROWS = [(i, "\n".join(" ".join(f"w{(7 * i + 3 * k + j) % 211}" for j in range(12 + i % 5)) for k in range(6))) for i in range(80)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def sets_of(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(2)
    return line_dedup.stored(line_dedup.line_sets(docs, line_dedup.frequent_tokens(docs), (4, 5), 1))


def test_rows_of_lists_travel_by_bucket(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BUCKETS", 8)
    sets = sets_of(spark)
    got = line_dedup._postings(sets).collect()
    lists = [(r.doc, r.line, r.n, p, k) for r in sets.collect() for k, p in zip(np.frombuffer(r.lists, np.int64).tolist(), np.frombuffer(r.places, np.int32).tolist())]
    assert len(got) <= 8 * sets.rdd.getNumPartitions() < len(lists)  # a row for each before
    back = []
    for r in got:
        rows = np.ascontiguousarray(np.frombuffer(r.data, np.uint8).reshape(line_dedup._POSTING.itemsize, -1).T).view(line_dedup._POSTING)[:, 0]
        assert set((rows["list"] % 8).tolist()) == {r.bucket} and not rows["marked"].any()
        back += rows[["doc", "line", "n", "pos", "list"]].tolist()
    assert sorted(back) == sorted(lists) and 0 <= min(x[-1] for x in back) <= max(x[-1] for x in back) < 1 << 48


def test_buckets_follow_the_lines(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BUCKETS", 8)
    monkeypatch.setattr(line_dedup, "ROWS", 40)
    sets = sets_of(spark)
    seen = {r.bucket for r in line_dedup._postings(sets).select("bucket").distinct().collect()}
    assert 8 < len(seen) and max(seen) < 10 * sets.count() // 40


def test_texts_are_read_once_for_the_first_pairs_and_never_met_by_a_broadcast(spark, monkeypatch):
    reads, real = [], line_dedup._texts_of
    monkeypatch.setattr(line_dedup, "_texts_of", lambda *a: reads.append(a) or real(*a))
    base = [f"w{k}" for k in range(20)]
    # A line whose earliest partner isn't similar enough: its other partners needed a reading of their own before.
    texts = [" ".join(base[:16] + ["a", "b", "c", "d"]), " ".join(base[2:] + ["e"]), " ".join(base)]
    out = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert "Broadcast" not in plan(out)
    assert {r.doc_id: r.removed for r in out.collect()} == {0: [], 1: [], 2: [0]}
    assert len(reads) <= 2


def test_words_are_ordered_by_rank_and_hash_also_where_they_share_most_bits(monkeypatch):
    h = np.array([(7 << 16) | 5, (7 << 16) | 2, 3, (9 << 16) | 1, 3, (7 << 16) | 2], np.uint64)
    monkeypatch.setattr(line_dedup, "word_hashes", lambda data: (h, np.array([0, 2, 4, 7, 9, 11])))
    frequent = np.array([[3, 4, 9]], np.uint64)
    line, key = line_dedup.tokens(["a b c", "d e f"], frequent)  # its newline is byte 5
    assert line.tolist() == [0, 0, 0, 1, 1, 1]
    assert key.tolist() == [(7 << 16) | 2, (7 << 16) | 5, 3, (7 << 16) | 2, (9 << 16) | 1, 3]


def test_frequent_words_do_not_depend_on_bins(spark, monkeypatch):
    rows = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(60) if k % (j + 1) == 0) + "\n x") for k in range(200)], "doc_id long, text string")
    want = line_dedup.frequent_tokens(rows)
    monkeypatch.setattr(line_dedup, "BINS", 4)
    assert len(want) > 20 and np.array_equal(line_dedup.frequent_tokens(rows), want)


def test_texts_reach_python_in_small_messages(spark):
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    before = spark.conf.get(line_dedup.MESSAGES)
    assert {r.n for r in line_dedup.stored(spark.range(0, 40, 1, 2).mapInArrow(sizes, "n long"), 7).collect()} == {7, 6}
    assert spark.conf.get(line_dedup.MESSAGES) == before
    batch = pa.RecordBatch.from_arrays([pa.array(range(600))], ["x"])
    assert [b.num_rows for b in line_dedup._pieces(iter([batch]))] == [256, 256, 88]


def test_equal_sets_are_told_without_sorting_rows(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SET_BUCKETS", 3)
    rows = [(k, "\n".join(f"a{(k + j) % 9} b{j % 4}" for j in range(12))) for k in range(30)]
    docs = spark.createDataFrame(rows + rows[:5], "doc_id long, text string").repartition(5)  # some rows are there twice
    sets = line_dedup.stored(line_dedup.line_sets(docs, line_dedup.frequent_tokens(docs), (4, 5), 1))
    copies = line_dedup._copies(sets)
    assert "SortAggregate" not in plan(copies) and "Join" not in plan(copies)
    seen, want = set(), set()
    for doc, text in rows:
        for number, line in enumerate(text.split("\n")):
            (want.add((doc, number)) if line in seen else seen.add(line))
    assert {(r.doc, r.line) for r in copies.collect()} == want
    first, second = np.array([3, 1, 3, 1, 1]), np.array([2, 9, 1, 9, 4])
    assert line_dedup._order_of(first, second).tolist() == line_dedup._order_of(first << 40, second << 20).tolist() == [4, 1, 3, 2, 0]
