"""Declared predictors, resolved paths, distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import distances
from gridloom.operators import predictors as P
from gridloom.plans import inputs

DIR = "/root/testdata/sf0.001"


def test_only_sources_in_use_are_read(spark, capsys):
    references = spark.range(3).select(F.col("id").alias("t"))
    files = lambda names: {n for n in ("events", "nation", "orders") if f"/{n}.parquet" in _explained(inputs.declared(DIR).plan(spark, names, references, 1, 1), capsys)}
    assert files(["cg_log", "ic_target"]) == {"events"}
    assert files(["terrain"]) == {"nation"}
    assert files(["cg_log", "terrain", "orders"]) == {"events", "nation", "orders"}


def _explained(df, capsys):
    df.explain("formatted")
    return capsys.readouterr().out


def test_declarations_are_checked():
    with pytest.raises(KeyError, match="nowhere"):
        P.Catalog().add(P.Predictor("p", ("nowhere",), lambda v: v))
    with pytest.raises(ValueError, match="sometimes"):
        P.Catalog().add(P.Source("s", lambda s: None), P.Predictor("p", ("s",), lambda v: v, "sometimes"))


def test_steps_of_each_time_frame(spark):
    rows = spark.createDataFrame([(t, "k", float(t)) for t in range(6)], "t long, key string, v double")
    c = P.Catalog().add(P.Source("s", lambda s: rows), P.Predictor("p", ("s",), lambda v: v), P.Predictor("f", ("s",), lambda v: -v, "future"))
    got = sorted(map(tuple, c.plan(spark, ["p", "f", "p"], spark.createDataFrame([(2,), (2,), (5,)], "t long"), 2, 2).collect()))
    assert got == sorted([(2, "p", -1, "k", 1.0), (2, "p", 0, "k", 2.0), (2, "f", 1, "k", -3.0), (2, "f", 2, "k", -4.0), (5, "p", -1, "k", 4.0), (5, "p", 0, "k", 5.0)])


def test_paths_by_hand(spark):
    s = 1718280900  # 2024-06-13 12:15
    want = {
        "RZC": "radar_data/RZC/nc4_2024-06-13-Romania_RZC/nc4_2024-06-13-Romania_1215_RZC.npy",
        "IR_108": "satellite_data/MSG/IR_108/nc4_2024-06-13-Romania_IR_108/nc4_2024-06-13-Romania_1215_IR_108.npy",
        "ir_105": "satellite_data/MTG/ir_105/nc4_2024-06-13-Romania_ir_105/nc4_2024-06-13-Romania_1215_ir_105.npy",
        "density": "lightning_data/density/nc4_2024-06-13-Romania_density/lightning_density_20240613_1215.npy",
        "cmic_cot": "nwcsaf_data/2024-06-13-Romania/S_NWC_CMIC_MSG4_Romania-VISIR_20240613T121500Z.nc",
    }
    other = ["radar_data/BZC/x.txt", "nwcsaf_data/2024-06-13-Romania/S_NWC_CTTH_MSG4_Romania-VISIR_20240613T121500Z.nc", "nwcsaf_data/2024-06-13-Romania/S_NWC_CMIC_MSG4_Romania-VISIR_20240613T123000Z.nc"]
    files = spark.createDataFrame([(f"/root/regridded_data/{p}",) for p in [*want.values(), *other]], "path string")
    asked = spark.createDataFrame([(v, s) for v in [*want, "LZC", "nothing"]], "variable string, s long")
    got = {r.variable: r for r in P.resolved_paths(asked, files).collect()}
    assert {v: r.path for v, r in got.items()} == {v: f"/root/regridded_data/{p}" for v, p in want.items()} | {"LZC": None, "nothing": None}
    assert (got["ir_105"].resolution, got["ir_105"].pool, got["nothing"].product_group) == ("LR", 2, None)


@pytest.mark.parametrize("block", [7, 1000])
def test_distances(spark, block):
    x = np.random.default_rng(2).normal(100, 1, (60, 5))
    x[7] = x[3]
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(99, None)], "k long, v array<double>")
    d = np.array([np.linalg.norm(x[a] - x[b]) for a in range(60) for b in range(a)])
    got = distances.distance_statistics(rows, "k", "v", block).first()
    assert got.pairs == len(d) and got.mean == pytest.approx(d.mean(), abs=2e-6) and got.std == pytest.approx(d.std(), abs=2e-6)
    assert tuple(distances.distance_statistics(rows.where("k = 1"), "k", "v").first()) == (0, None, None)
    assert tuple(distances.distance_statistics(rows.limit(0), "k", "v").first()) == (0, None, None)


def test_readers_are_imported_when_asked_for():
    import sys

    from gridloom.operators.reports import READERS, Registry

    r = Registry("reader")
    r.declare("later", "wave:open")
    r.declare("nowhere", "no_such_module:f")
    r.declare("settled", "builtins:round", ndigits=1)
    sys.modules.pop("wave", None)
    assert "wave" not in sys.modules and r.get("later") is sys.modules["wave"].open
    assert r.get("settled")(1.26) == 1.3
    with pytest.raises(ModuleNotFoundError):
        r.get("nowhere")
    assert all(callable(READERS.get(n)) for n in list(READERS.known))
