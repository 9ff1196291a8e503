"""The container source: format, pruning, names, and commits."""

import io
import os
import pickle
import struct
import subprocess
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from gridloom.sources import containers as C

RAIN = np.arange(12.0).reshape(3, 4)


def write(path, variables, attributes=None):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(C.encode(variables, attributes))


def test_all_types_come_back():
    data = {k: (["y", "x"], RAIN.astype(k)) for k in ("i1", "i2", "i4", "f4", "f8")} | {"axis": (["y"], np.array([1.5, 2.5, 3.5]))}
    coded = C.encode({f"v_{k}": v for k, v in data.items()}, {"title": "é", "corner": [1.0, 2.0]})
    variables, attributes = C.header(coded)
    assert attributes == {"title": "é", "corner": [1.0, 2.0]}
    for k, (dims, want) in data.items():
        v = variables[f"v_{k}"]
        assert v.dims == dims and (C.values_of(io.BytesIO(coded), v) == want).all()
    with pytest.raises(ValueError, match="no type"):
        C.encode({"a": (["x"], np.array([1], "i8"))})
    with pytest.raises(ValueError, match="axis x"):
        C.encode({"a": (["x"], np.zeros(2)), "b": (["x"], np.zeros(3))})


def test_records_fill_values_and_scales():
    """A file of the 32-bit variant with an unlimited axis, two record variables, written by hand from the format's description."""
    name = lambda s: struct.pack(">I", len(s)) + s + b"\0" * (-len(s) % 4)
    number = lambda s, v: name(s) + struct.pack(">IId", 6, 1, v)
    head = b"CDF\x01" + struct.pack(">I", 2) + struct.pack(">II", 10, 2) + name(b"t") + struct.pack(">I", 0) + name(b"x") + struct.pack(">I", 3) + struct.pack(">II", 0, 0) + struct.pack(">II", 11, 2)
    a = name(b"a") + struct.pack(">III", 2, 0, 1) + struct.pack(">II", 12, 3) + number(b"_FillValue", -9.0) + number(b"scale_factor", 0.5) + number(b"add_offset", 1.0) + struct.pack(">II", 3, 8)
    b = name(b"b") + struct.pack(">II", 1, 0) + struct.pack(">II", 0, 0) + struct.pack(">II", 6, 8)
    begin = len(head) + len(a) + len(b) + 8
    records = b"".join(struct.pack(">3h", *r) + b"\0\0" + struct.pack(">d", x) for r, x in (((2, -9, 4), 7.0), ((6, 8, -9), 8.0)))
    coded = head + a + struct.pack(">I", begin) + b + struct.pack(">I", begin + 8) + records
    variables, _ = C.header(coded)
    assert C.values_of(io.BytesIO(coded), variables["a"]).tolist() == [[2.0, 0.0, 3.0], [4.0, 5.0, 0.0]]
    assert C.values_of(io.BytesIO(coded), variables["b"]).tolist() == [7.0, 8.0]


def test_only_wanted_variables_are_read(spark, tmp_path):
    """The second variable's bytes are missing: reading the first alone succeeds, reading both gives an error row."""
    path = f"{tmp_path}/a/one.nc"
    write(path, {"first": (["y", "x"], RAIN), "second": (["y", "x"], RAIN)})
    whole = open(path, "rb").read()
    with open(path, "wb") as f:
        f.write(whole[: len(whole) - RAIN.nbytes])
    source = C.read_containers(spark, f"file://{tmp_path}", [["first"]])
    assert [(r["values"], r.error) for r in source.orderBy("line").collect()] == [(x, None) for x in RAIN.tolist()]
    assert [r.error is None for r in C.read_containers(spark, f"file://{tmp_path}").collect()] == [False]
    assert [p.names for p in C.ContainerReader({"path": f"file://{tmp_path}", "variables": "first,second|2nd"}).partitions()] == [[["first"]], [["second", "2nd"]]]


def test_filters_of_one_table_stay_apart(spark, tmp_path):
    write(f"{tmp_path}/a/one.nc", {"first": (["y", "x"], RAIN), "second": (["y", "x"], RAIN)})
    source = C.read_containers(spark, f"file://{tmp_path}")
    both = source.where("variable = 'first'").union(source.where("variable = 'second'"))
    assert both.count() == 6 and source.count() == 6


def test_names_axes_and_shapes(spark, tmp_path):
    write(f"{tmp_path}/f/1.nc", {"lat": (["y"], np.zeros(3)), "DataMap": (["t", "y", "x"], RAIN[None])})
    write(f"{tmp_path}/f/2.nc", {"palette": (["k"], np.zeros(2)), "wind": (["t", "level", "y", "x"], np.stack([RAIN, RAIN + 2])[None])}, {"lat_ul": [50.0], "lat_lr": [40.0]})
    with open(f"{tmp_path}/f/3.nc", "wb") as f:
        f.write(b"not a file")
    os.makedirs(f"{tmp_path}/f/_job-1")
    write(f"{tmp_path}/f/_job-1/4.nc", {"data": (["x"], np.zeros(2))})
    rows = C.read_containers(spark, f"file://{tmp_path}", [["*"]]).orderBy("path", "line").collect()
    assert [(r.path[-4:], r.shape) for r in rows if not r.error] == [("1.nc", [3, 4])] * 3 + [("2.nc", [3, 4])] * 3
    assert [r["values"] for r in rows if r.path.endswith("2.nc")] == (RAIN + 1).tolist()
    assert [r.path[-4:] for r in rows if r.error] == ["3.nc"]
    named = C.read_containers(spark, f"file://{tmp_path}", [["data", "datamap"], ["lat"]]).where("error IS NULL").collect()
    assert {(r.path[-4:], r.variable) for r in named} == {("1.nc", "data"), ("1.nc", "lat"), ("2.nc", "lat")}
    assert [r["values"] for r in named if r.path.endswith("2.nc")] == [[50.0, 45.0, 40.0]]


def test_write_and_abort(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    rows = [(f"d{k % 2}/{k}.nc", "rain", ["y", "x"], [3, 4], i, (RAIN[i] + k).tolist()) for k in range(5) for i in range(3) if (k, i) != (4, 1)]
    lines = spark.createDataFrame(rows, "path string, variable string, dims array<string>, shape array<int>, line int, values array<double>").repartition(4)
    C.write_containers(lines, path)
    back = C.to_pixels(C.read_containers(spark, path), ["path"]).groupBy(F.regexp_extract("path", r"out/(.*)$", 1).alias("p")).agg(F.sum("v").alias("v"))
    want = {f"d{k % 2}/{k}.nc": float(RAIN.sum() + 12 * k) for k in range(4)} | {"d0/4.nc": float(RAIN[[0, 2]].sum() + 32)}
    assert {r.p: r.v for r in back.collect()} == want
    assert not [d for d in os.listdir(f"{tmp_path}/out") if d.startswith("_")]
    # A failed job leaves the files as they are and nothing else.
    bad = lines.withColumn("values", F.when(F.col("path") == "d1/3.nc", F.array(F.lit(1.0))).otherwise(F.col("values")))
    with pytest.raises(Exception, match="its shape says"):
        C.write_containers(bad.withColumn("path", F.concat(F.lit("new/"), F.col("path"))), path)
    assert sorted(os.listdir(f"{tmp_path}/out")) == ["d0", "d1"]


def test_reader_runs_without_the_package(tmp_path):
    write(f"{tmp_path}/a.nc", {"rain": (["y", "x"], RAIN)})
    with open(f"{tmp_path}/reader", "wb") as f:
        f.write(cloudpickle.dumps(C.ContainerReader({"path": f"file://{tmp_path}", "variables": "rain"})))
    code = "import pickle; r = pickle.load(open('reader', 'rb')); print(sum(b.num_rows for p in r.partitions() for b in r.read(p)))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True).stdout.strip() == "3"
    assert pickle.loads(cloudpickle.dumps(C.Written([("a", "b")]))).files == [("a", "b")]
