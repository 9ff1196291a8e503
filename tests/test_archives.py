"""Members of archives, damaged ones, and readers for times and ranges."""

import os
import zipfile

from pyspark.sql import functions as F

from gridloom.sources import archives as A


def test_members_of_archives_and_files(spark, tmp_path):
    os.makedirs(f"{tmp_path}/a/b")
    with zipfile.ZipFile(f"{tmp_path}/a/one.zip", "w") as z:
        z.writestr("x.txt", "packed " * 1000, zipfile.ZIP_DEFLATED)
        z.writestr("sub/y.txt", b"stored", zipfile.ZIP_STORED)
        z.writestr("empty", b"")
        z.writestr("w.txt", "other method" * 50, zipfile.ZIP_BZIP2)
        z.mkdir("folder")
    with zipfile.ZipFile(f"{tmp_path}/a/none.zip", "w"):
        pass
    for name, data in (("a/b/plain.txt", b"as it is"), ("a/bad.zip", b"not an archive")):
        with open(f"{tmp_path}/{name}", "wb") as f:
            f.write(data)
    with zipfile.ZipFile(f"{tmp_path}/a/hurt.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("h.txt", os.urandom(500))
    raw = bytearray(open(f"{tmp_path}/a/hurt.zip", "rb").read())
    raw[100] ^= 255
    with open(f"{tmp_path}/a/hurt.zip", "wb") as f:
        f.write(raw)
    found = A.members(spark, f"file://{tmp_path}")
    listed = {(os.path.basename(r.path), r.member): r for r in found.collect()}
    assert set(listed) == {("one.zip", "x.txt"), ("one.zip", "sub/y.txt"), ("one.zip", "empty"), ("one.zip", "w.txt"), ("plain.txt", None), ("bad.zip", None), ("hurt.zip", "h.txt")}
    assert listed["bad.zip", None].error and listed["one.zip", "x.txt"].size == 7000
    got = {(os.path.basename(r.path), r.member): r for r in A.read_members(found.withColumn("k", F.lit(7)), carry=["k"], parts=3).collect()}
    want = {("one.zip", "x.txt"): b"packed " * 1000, ("one.zip", "sub/y.txt"): b"stored", ("one.zip", "empty"): b"", ("plain.txt", None): b"as it is"}
    assert {k: bytes(r.content) for k, r in got.items() if r.error is None} == want and all(r.k == 7 for r in got.values())
    assert "method" in got["one.zip", "w.txt"].error and got["hurt.zip", "h.txt"].error


def test_written_archives_come_back(spark, tmp_path):
    rows = [(f"d{k % 2}/{k % 4}.zip", f"m{k}", b"%d" % k * k) for k in range(40)]
    written = A.write_archives(spark.createDataFrame(rows, "name string, member string, content binary").repartition(5), f"file://{tmp_path}/z")
    assert sorted((r.name, r.members) for r in written.collect()) == [(f"d{k % 2}/{k}.zip", 10) for k in (0, 2, 1, 3)]
    got = A.read_members(A.members(spark, f"file://{tmp_path}/z", "*.zip")).collect()
    assert {(r.path[-8:], r.member, bytes(r.content)) for r in got} == set(rows) and len(got) == 40


def test_times_lists_and_ranges(spark):
    times = lambda *a, **k: [r.t for r in A.requested(spark, *a, **k).orderBy("t").collect()]
    assert times(5) == [5] and times([7, 3, 7]) == [3, 7]
    assert times((0, 900), 300) == [0, 300, 600] and times((0, 900), 300, inclusive=True) == [0, 300, 600, 900]
    found = spark.createDataFrame([("a", 299), ("b", 300), ("c", 599), ("d", 600), ("e", None)], "member string, at long")
    got = A.members_for_times(found, F.col("at"), A.requested(spark, [600, 900, 599]), 300).select("t", "member").collect()
    assert sorted(map(tuple, got)) == [(599, "a"), (599, "b"), (600, "b"), (600, "c"), (900, "d")]
