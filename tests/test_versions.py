"""The commit log: skipped rows, one version for a reader, conflicts, and jobs that end early."""

import os
import threading

import pytest
from pyspark.sql import types as T

from gridloom.sources.versions import Conflict, Versions

SCHEMA = T.StructType([T.StructField("day", T.StringType()), T.StructField("step", T.LongType()), T.StructField("v", T.DoubleType())])


def rows(spark, *triples):
    return spark.createDataFrame(list(triples), SCHEMA)


def store(spark, tmp_path):
    return Versions(spark, f"file://{tmp_path}/store", SCHEMA, ["day", "step"])


def content(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_append_skips_what_is_there(spark, tmp_path):
    s = store(spark, tmp_path)
    assert s.latest() == 0 and s.read().count() == 0
    one = s.append(rows(spark, ("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 3.0), ("b", 1, 3.0), (None, None, 0.0)))
    assert one.version == 1 and content(one.counts) == [("a", 2, 0), ("b", 1, 0), (None, 1, 0)]
    two = s.append(rows(spark, ("a", 2, 9.0), ("a", 3, 4.0), (None, None, 5.0)))
    assert two.version == 2 and content(two.counts) == [("a", 1, 1), (None, 0, 1)]
    assert content(s.read()) == [("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, 4.0), ("b", 1, 3.0), (None, None, 0.0)]
    assert s.read(1).count() == 4
    # Nothing new is no version.
    assert s.append(rows(spark, ("a", 3, 4.0))).version == 2 and s.latest() == 2
    assert s.append(rows(spark)).version == 2


def test_a_job_that_ends_before_its_commit_leaves_the_old_version(spark, tmp_path, monkeypatch):
    s = store(spark, tmp_path)
    s.append(rows(spark, ("a", 1, 1.0)))

    def stopped(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(Versions, "_commit", stopped)
        with pytest.raises(KeyboardInterrupt):
            s.append(rows(spark, ("a", 2, 2.0)))
    assert len(os.listdir(f"{tmp_path}/store/data")) == 2
    assert s.latest() == 1 and content(s.read()) == [("a", 1, 1.0)]
    assert s.append(rows(spark, ("a", 2, 3.0))).version == 2 and content(s.read()) == [("a", 1, 1.0), ("a", 2, 3.0)]


def test_two_writers_one_tries_again(spark, tmp_path, monkeypatch):
    """The second writer commits between the first one's write and commit."""
    s, other = store(spark, tmp_path), store(spark, tmp_path)
    s.append(rows(spark, ("a", 1, 1.0)))
    real, calls = Versions._commit, []

    def slow(self, number, folders):
        calls.append(number)
        if len(calls) == 1:
            other.append(rows(spark, ("a", 2, 20.0), ("b", 1, 30.0)))
        return real(self, number, folders)

    monkeypatch.setattr(Versions, "_commit", slow)
    done = s.append(rows(spark, ("a", 2, 2.0), ("c", 1, 4.0)))
    assert done.version == 3 and content(done.counts) == [("a", 0, 1), ("c", 1, 0)] and calls == [2, 2, 3]
    assert content(s.read()) == [("a", 1, 1.0), ("a", 2, 20.0), ("b", 1, 30.0), ("c", 1, 4.0)]
    assert content(s.read(2)) == [("a", 1, 1.0), ("a", 2, 20.0), ("b", 1, 30.0)]
    monkeypatch.setattr(Versions, "_commit", lambda *_: False)
    with pytest.raises(Conflict):
        s.append(rows(spark, ("d", 1, 1.0)), tries=2)


def test_many_writers_lose_nothing(spark, tmp_path):
    s = store(spark, tmp_path)
    wrong = []

    def work(k):
        try:
            store(spark, tmp_path).append(rows(spark, ("x", k, float(k)), ("x", -1, 0.0)))
        except Exception as e:  # shown below
            wrong.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not wrong and s.latest() == 4
    assert content(s.read()) == [("x", -1, 0.0), *(("x", k, float(k)) for k in range(4))]
