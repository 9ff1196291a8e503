"""Hand-made cases: empty inputs, ties, midnight, NaN, formats, sinks."""

import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import transforms as T
from gridloom.operators import grid as G
from gridloom.operators import patches as P
from gridloom.operators import sequences as S
from gridloom.operators import verify as V
from gridloom.sources import sinks as K
from gridloom.sources import tables as R


def test_continuity_crosses_midnight_and_ignores_duplicates(spark):
    rows = [(s, 1) for s in range(93, 100)] + [(95, 1), (95, 2)]
    found = S.continuity(spark.createDataFrame(rows, "slot long, patch_id long")).orderBy("slot").collect()
    assert [(r.slot, r.patch_id) for r in found] == [(95, 1), (96, 1)]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 15, 25])
def test_block_split(spark, n):
    refs = spark.createDataFrame([(k, 1) for k in range(n)], "slot long, patch_id long")
    got = [r.split for r in S.block_split(refs, 5).orderBy("slot").collect()]
    k = max(1, round(n * 0.1))
    assert got == (["train"] * n if n < 3 else ["test"] * k + ["validation"] * k + ["train"] * (n - 2 * k))


def test_empty_frame(spark):
    none = spark.createDataFrame([], "frame long, i long, j long, v double")
    assert G.density_mask(none, 10, 5, 20).count() == 0
    assert G.fill_holes(none, 4, 4).count() == 0


def test_density_mask_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    at = {tuple(map(int, x)) for x in rng.integers(0, 30, (220, 2))}
    got = {(r.i, r.j) for r in G.density_mask(spark.createDataFrame([(0, i, j, 20.0) for i, j in at], "frame long, i long, j long, v double"), 10, 5, 20).collect()}
    near = lambda a, b: (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 <= 25
    cores = [a for a in at if sum(near(a, b) for b in at) >= 20]
    assert got == {a for a in at if any(near(a, c) for c in cores)} and got


def test_mode_pool_takes_the_smallest_of_ties(spark):
    rows = [(0, 0, 0, 3.0), (0, 0, 1, 1.0), (0, 1, 0, 3.0), (0, 1, 1, 1.0)]
    assert G.mode_pool(spark.createDataFrame(rows, "frame long, i long, j long, v double"), 2).first().v == 1.0


def test_transforms_fill_nan_first(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (65535.0,), (0.0,)], "x double")
    out = df.select(*[f(F.col("x")).alias(n) for n, f in T.TRANSFORMS.items()]).collect()
    assert all(v is not None for v in out[0]) and not any(np.isnan(v) for v in out[0])
    assert abs(out[0].rzc - (np.log10(0.01) + 0.051) / 0.528) < 1e-12
    assert out[2].ctth_alti == out[0].ctth_alti


def test_erf(spark):
    import math

    got = spark.createDataFrame([(-1.5,), (0.0,), (0.7,)], "x double").select("x", T.erf(F.col("x")).alias("y")).collect()
    assert all(abs(r.y - math.erf(r.x)) < 2e-7 for r in got)


def test_probabilities_at_the_ends(spark):
    df = spark.createDataFrame([(1, 1, 1, 1.0), (2, 1, 0, 0.0)], "id long, lead int, y_true int, y_pred double")
    sweep = {r.k: r for r in V.confusion_sweep(df, 10).collect()}
    assert (sweep[10].tp, sweep[10].fp, sweep[0].tp, sweep[0].fp) == (1, 0, 1, 1)
    assert sum(r.n for r in V.reliability(df, 10).collect()) == 2
    assert sum(r.n for r in V.reliability(df, 10, False).collect()) == 1


def test_flip_twice_is_identity(spark):
    df = spark.createDataFrame([(1, i, j, float(i * 4 + j)) for i in range(4) for j in range(4)], "patch long, i long, j long, v double")
    twice = P.flip(P.flip(df, 4, 4, True, True), 4, 4, True, True)
    assert twice.exceptAll(df).isEmpty()


def test_raster_round_trip(spark, tmp_path):
    data = np.arange(40 * 60, dtype=np.float32).reshape(40, 60)
    for name in ("a", "b"):
        buffer = io.BytesIO()
        np.save(buffer, data)
        (tmp_path / f"{name}.npy").write_bytes(buffer.getvalue())
    (tmp_path / "bad.npy").write_bytes(b"nothing")
    tiles = R.read_rasters(spark, str(tmp_path), tile=20)
    assert tiles.where("error IS NOT NULL").count() == 1
    got = R.tile_pixels(tiles, 3, 20).where("path LIKE '%a.npy'").collect()
    assert len(got) == 2400 and all(r.v == r.i * 60 + r.j for r in got)


def test_strokes_and_index_files(spark, tmp_path):
    (tmp_path / "archive.txt").write_text("01.02.2024 03:04:05.6 UTC|8.5|47.1|-12.5|1|2|IC|0|0|0|0|0|0|0|0|0|0\n")
    row = R.read_strokes_archive(spark, str(tmp_path / "archive.txt")).first()
    assert (row.ts.second, row.ts.microsecond, row.lon, row.current, row.intra) == (5, 600000, 8.5, -12.5, "IC")
    (tmp_path / "feed.txt").write_text("47.0  8.0 20240201030405 CG 7.5\n")
    assert R.read_strokes_feed(spark, str(tmp_path / "feed.txt")).first().current == 7.5
    active = spark.createDataFrame([("t1", 3), ("t1", 18), ("t2", 1)], "ts_text string, patch_id long")
    wide = K.wide_index(active).orderBy("ts_text").collect()
    assert (wide[0].patch_3, wide[0].patch_18, wide[0].patch_1, wide[1].patch_1) == (1, 1, 0, 1)


def test_append_new_skips_what_is_there(spark, tmp_path):
    path = str(tmp_path / "store")
    df = spark.createDataFrame([("d1", 1), ("d1", 2)], "day string, k int")
    assert K.append_new(df, None, path, ["day", "k"]).first().new == 2
    more = spark.createDataFrame([("d1", 2), ("d2", 1)], "day string, k int")
    K.append_new(more, spark.read.parquet(path), path, ["day", "k"])
    assert spark.read.parquet(path).count() == 3


def test_spaced_sample_is_the_sequential_choice(spark):
    from gridloom.plans import fixtures, reports

    got = {tuple(r) for r in reports.QUERIES["spaced_sample"][0](spark, "/root/testdata/sf0.001").collect()}
    cells = sorted(((r.i * 192 + r.j) * 7919 % 18433, r.frame, r.i, r.j) for r in fixtures.pixels(spark, "/root/testdata/sf0.001").collect())
    taken = {}
    for rank, frame, i, j in cells:
        near = [(frame, a, b) for a in range(i - 2, i + 3) for b in range(j - 2, j + 3) if (a - i) ** 2 + (b - j) ** 2 < 9]
        if not any(x in taken for x in near):
            taken[frame, i, j] = rank
    assert got == {(*k, rank) for k, rank in taken.items()} and len(got) > 100


def test_folder_names_by_hand(spark):
    from pyspark.sql import functions as F

    from gridloom.functions import names

    want = {"nc4_2025-06-01_CTTH-Romania_1215_x": "ctth_x", "nc4_IR10800_2025-06-01": "ir10800", "2025-06-01-Romania": "unknown", "RZC-hungary__A--b": "rzc_a_b", "": "unknown", "nc4_2025-06-01-Serbia_0815_lightning_density": "lightning_density"}
    rows = spark.createDataFrame([(k,) for k in want], "n string").select("n", names.clean_name(F.col("n")).alias("c")).collect()
    assert {r.n: r.c for r in rows} == want


def test_names_of_no_convention_give_null(spark):
    from pyspark.sql import functions as F

    from gridloom.functions import names

    for bad in ("", "x", "nc4_2025-13-01-Romania_1215_a", "lightning_density_2025_01", "S_NWC_x_MSG4_a-b_20250101T000000Z.nc"):
        row = spark.range(1).select(names.nc4_time(F.lit(bad)).alias("a"), names.lightning_time(F.lit(bad)).alias("b"), names.cloud_product(F.lit(bad)).alias("c"), names.imager_file(F.lit(bad))["time"].alias("d"), names.radar_network_file(F.lit(bad))["time"].alias("e")).first()
        assert tuple(row) == (None,) * 5, bad


def test_regions_of_a_long_winding_line(spark):
    from gridloom.operators.grid import connected_regions

    line = [(0, 2 * r, c) for r in range(20) for c in range(60)] + [(0, 2 * r + 1, 59 if r % 2 == 0 else 0) for r in range(19)] + [(1, 5, 5), (1, 8, 8)]
    got = connected_regions(spark.createDataFrame(line, "frame long, i long, j long"), connectivity=4, max_rounds=20).collect()
    assert {r.label for r in got if r.frame == 0} == {0} and len({r.label for r in got if r.frame == 1}) == 2


def test_rounds_of_a_training_store_replace_a_split(spark, tmp_path):
    from gridloom.sources import sinks, tables

    rows = spark.createDataFrame([(1, "a", "2024-01-01"), (2, "b", "2024-01-01"), (3, "a", "2024-01-02")], "id long, variable string, date string")
    sinks.write_partitioned(rows, str(tmp_path / "s"), ["variable", "date"])
    sinks.write_partitioned(rows.where("id = 3").selectExpr("id + 10 AS id", "variable", "date"), str(tmp_path / "s"), ["variable", "date"])
    assert sorted(r.id for r in tables.read_patches(spark, str(tmp_path / "s"), "a").collect()) == [1, 13]
    assert [r.id for r in tables.read_patches(spark, str(tmp_path / "s"), "a", ["2024-01-01"]).collect()] == [1]


def test_as_of_joins_against_brute_force(spark):
    import random

    from gridloom.operators import points as P

    rng = random.Random(3)
    frames = [(k, rng.choice([100, 101, 102, rng.randrange(0, 400), rng.randrange(900, 1000)])) for k in range(300)]
    asks = [(k, rng.randrange(-50, 1200)) for k in range(200)]
    fr, rq = spark.createDataFrame(frames, "fid long, ft long"), spark.createDataFrame(asks + [(900, None)], "rid long, t long")
    near = {r.rid: (r.fid, r.dt) for r in P.nearest_in_time(rq, fr, 30).collect()}
    last = {r.rid: r.fid for r in P.latest_before(rq, fr, 30).collect()}
    assert len(near) == len(last) == 201 and near[900] == (None, None) and last[900] is None
    for rid, t in asks:
        best = min(((abs(t - ft), ft, fid) for fid, ft in frames if abs(t - ft) <= 30), default=None)
        assert near[rid] == ((best[2], best[0]) if best else (None, None))
        found = max(((ft, fid) for fid, ft in frames if t - 30 <= ft < t), default=None)
        assert last[rid] == (found[1] if found else None)


def test_selection_of_odd_rows(spark):
    from pyspark.sql import functions as F

    from gridloom.operators import selection as C

    groups = spark.createDataFrame([(1, [[1, 2], None, []]), (2, None), (3, [[5]])], "k int, g array<array<int>>")
    assert sorted(C.flatten_groups(groups, "g", "p").collect()) == [(1, 1), (1, 2), (3, 5)]
    rows = spark.createDataFrame([([1.0, 3.0, 3.0],), ([],), (None,)], "v array<double>")
    assert [tuple(r) for r in rows.select(C.largest_channel(F.col("v")), C.one_lead(F.col("v"), 2)).collect()] == [(1, 3.0), (None, None), (None, None)]
    scores = spark.createDataFrame([("a", 0.5), ("b", None), ("c", 0.9), ("d", 0.5)], "input string, xi double")
    assert [r.input for r in C.ranked_inputs(scores, "xi", "input").orderBy("place").collect()] == ["c", "a", "d", "b"]
    cut = C.batches(spark.range(10), ["id"], 4).orderBy("id").collect()
    assert [(r.batch, r.pos) for r in cut] == [(k // 4, k % 4) for k in range(10)]
    key = spark.sql("SELECT TIMESTAMP'2024-12-31 23:55:00' AS t").select(C.object_key(F.col("t"), "-x.h5")).first()[0]
    assert key == "2025/01/01/2025-01-01T000500Z-x.h5"
    boxes = spark.createDataFrame([(1, -5, 0, 9, 1)], "id int, i1 int, j1 int, i2 int, j2 int")
    grid = spark.createDataFrame([(i, j, 10.0 * i, 1.0 * j) for i in range(2) for j in range(2)], "i int, j int, lat double, lon double")
    assert [tuple(r) for r in C.corner_coordinates(boxes, grid, 2, 2).collect()] == [(1, 0.0, 0.0, 10.0, 1.0)]
    still = C.frame_report(spark.createDataFrame([(1, 0.0), (1, 0.0)], "f int, v double"), "f", "v", 0.5, 1.0).first()
    assert still.light_from is None and still.light_km2 == 0.0 and still.coverage == 0.0
    assert C.batches(spark.range(0), ["id"], 4).count() == 0


def test_quantiles_totals_and_neighbours_across_partitions(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from gridloom.operators import ranks

    rng = np.random.default_rng(3)
    rows = [("a", k, float(v)) for k, v in enumerate(rng.integers(0, 9, 200))] + [("b", k, float(v)) for k, v in enumerate(rng.random(57))] + [("c", 0, 5.0), ("c", 1, None), ("d", 0, None)]
    table = spark.createDataFrame(rows, "g string, k int, v double").repartition(3)
    got = {(r.g, r.q): r.v for r in ranks.quantiles(table, ["g"], "v", 20).collect()}
    for g in "abc":
        want = np.quantile([v for h, _, v in rows if h == g and v is not None], np.arange(21) / 20)
        assert np.allclose([got[g, q] for q in range(21)], want)
    assert len(got) == 63
    totals = {(r.g, r.k): (r.n_, round(r.sum_, 6)) for r in ranks.running_totals(table, ["g"], ["k"], "v").collect()}
    steps = {r.g: (r.n, round(r.total, 6)) for r in ranks.neighbour_steps(table, ["g"], ["k"], F.abs(F.col("v") - F.col("was_")), "v").collect()}
    for g in "abcd":
        values = [v for h, _, v in rows if h == g]
        for k in range(len(values)):
            known = [v for v in values[: k + 1] if v is not None]
            assert totals[g, k] == (len(known), round(sum(known), 6))
        assert steps[g] == (len(values), round(sum(abs(b - a) for a, b in zip(values, values[1:]) if None not in (a, b)), 6))
