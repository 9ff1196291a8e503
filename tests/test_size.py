"""What keeps a query's memory and shuffle in step with its input."""

import numpy as np

from gridloom.operators import distances, fields, graph, grid, sampling, shared
from gridloom.plans import catalog, fixtures


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


POINTS = "{0} long, x double, y double"


def test_resample_pairs_places_only(spark):
    targets = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 9.0, 9.0), (4, 3.0, 0.0)], POINTS.format("tid"))
    sources = spark.createDataFrame([(0.0, 0.0, 1.0), (0.0, 0.0, 3.0), (3.0, 4.0, None), (3.0, 4.0, 5.0), (0.1, 5.0, 7.0)], "x double, y double, v double")
    got = fields.gaussian_resample(targets, sources, 2.5, 5.0)
    assert "Broadcast" not in plan(got)
    assert {(r.tid, r.n) for r in got.collect()} == {(1, 4), (2, 4), (4, 4)}
    assert got.where("tid = 1").first().v == got.where("tid = 2").first().v


def test_nearest_neighbour_settles_by_levels(spark):
    import random

    draw = random.Random(3)
    place = lambda n: [(k, draw.randrange(60) / 10, draw.randrange(60) / 10) for k in range(n)]
    targets, sources = place(300), place(40) + [(99, 50.0, 50.0)]
    got = grid.nearest_neighbour(spark.createDataFrame([*targets, (999, 52.0, 50.0), (1000, 52.1, 50.0)], POINTS.format("tid")), spark.createDataFrame(sources, POINTS.format("sid")), 2.0)
    assert "Broadcast" not in plan(got)
    want = {}
    for t, x, y in [*targets, (999, 52.0, 50.0), (1000, 52.1, 50.0)]:
        d2, sid = min((round((x - a) ** 2 + (y - b) ** 2, 9), s) for s, a, b in sources)
        if d2 <= 4:
            want[t] = sid
    assert {r.tid: r.sid for r in got.collect()} == want


DATA = "/root/testdata/sf0.001"


def shuffles(df):
    return plan(df).count("Exchange ")


def test_frames_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(shared, "PART_ROWS", 500)
    pixels = fixtures.pixels(spark, DATA)
    assert 12 <= pixels.rdd.getNumPartitions() <= 14  # 6,005 or so rows
    assert shuffles(grid.kernel_sum(pixels, 4, lambda a, b: 1.0)) == 1


def test_distances_move_each_vector_a_bounded_number_of_times(spark):
    vectors = np.random.default_rng(1).normal(size=(90, 3))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "k long, v array<float>")
    got = distances.distance_statistics(rows, "k", "v", 2)
    assert "sequence(0, 15" in got._jdf.queryExecution().analyzed().toString()  # 45 blocks of two otherwise
    x = vectors.astype(np.float32).astype(float)
    d = [np.linalg.norm(x[a] - x[b]) for a in range(90) for b in range(a)]
    row = got.first()
    assert row.pairs == len(d) and abs(row["mean"] - np.mean(d)) < 2e-6 and abs(row["std"] - np.std(d)) < 2e-6


def test_sight_grid_shuffles_once(spark):
    assert shuffles(catalog.QUERIES["sight_grid"](spark, DATA)) == 1


def test_parallax_grid_shuffles_once(spark):
    assert shuffles(catalog.QUERIES["parallax_grid"](spark, DATA)) == 1


def test_zero_predictor_shuffles_its_table_only(spark):
    got = plan(catalog.QUERIES["zero_predictor"](spark, DATA))
    assert got.count("Exchange ") == 2 and "ENSURE_REQUIREMENTS" not in got


def test_density_mask_without_joins(spark):
    rows = [(0, 5, j, 20.0) for j in (5, 6, 7)] * 2 + [(0, 5, 9, 20.0), (0, 5, 40, 20.0), (0, 5, 5, 1.0)]
    got = grid.density_mask(spark.createDataFrame(rows, "frame long, i long, j long, v double"), 10, 2, 6)
    assert "Join" not in plan(got)
    assert sorted((r.i, r.j) for r in got.collect()) == sorted([(5, 5), (5, 6), (5, 7)] * 2 + [(5, 9)])


def test_density_patches_shuffle_once(spark):
    assert shuffles(catalog.QUERIES["density_patches"](spark, DATA)) == 1


def test_fill_holes_without_a_join(spark):
    rows = [(0, 0, 0, 4.0), (0, 0, 1, None), (0, 1, 1, 2.0)]
    got = grid.fill_holes(spark.createDataFrame(rows, "frame long, i long, j long, v double"), 2, 3)
    assert "Join" not in plan(got)
    assert {(r.i, r.j): r.v for r in got.collect()} == {(1, 0): 3.0, (0, 2): 2.0, (1, 2): 2.0}


def test_small_frames_are_sampled_without_a_graph(spark, monkeypatch):
    monkeypatch.setattr(sampling, "components", None)
    draw = np.random.default_rng(5)
    spots = draw.permutation(400)[:250]
    i, j, rank = spots // 20 - 7, spots % 20, draw.permutation(250)
    want = sampling.decided(i, j, rank, np.full(250, -1), np.ones(250, bool), 2.5) == 1
    rows = [(0, int(a), int(b), int(c)) for a, b, c in zip(i, j, rank)]
    got = sampling.spaced_sample(spark.createDataFrame(rows, "frame long, i long, j long, rank long"), 2.5)
    assert sorted(r["rank"] for r in got.collect()) == sorted(rank[want].tolist())
    for distance in (1.0, 3.0, 40.0):
        assert (sampling.chosen(i, j, rank, distance) == (sampling.decided(i, j, rank, np.full(250, -1), np.ones(250, bool), distance) == 1)).all()


def test_small_graphs_are_settled_at_once(spark):
    links = [(0, 5, 3), (0, 9, 5), (0, 7, 8), (1, 5, 9), *[(2, k, k + 1) for k in range(20, 60)]]
    rows = spark.createDataFrame(links, "frame long, a long, b long")
    want = {(0, 3, 3), (0, 5, 3), (0, 9, 3), (0, 7, 7), (0, 8, 7), (1, 5, 5), (1, 9, 5), *[(2, k, 20) for k in range(20, 61)]}
    assert {tuple(r) for r in graph.components(rows, ["frame"], 0).collect()} == want  # no round is left
    assert {tuple(r) for r in graph.components(rows, ["frame"], together=10).collect()} == want


def test_sight_in_steps_is_compiled_and_the_same(spark):
    from pyspark.sql import functions as F

    from gridloom.functions import geodesy

    made = plan(catalog.QUERIES["sight_grid"](spark, DATA))
    assert "lambda" not in made and made.count("ATAN2") <= 6
    rows = spark.createDataFrame([(k, -170.0 + 11 * k, -85.0 + 5.5 * k, None if k % 7 == 0 else k / 2) for k in range(32)], "k long, lon double, lat double, h double")
    args = F.col("lon"), F.col("lat"), F.col("h"), geodesy.satellite_at(9.5)
    want = {r.k: (r.s.lon, r.s.lat) for r in rows.select("k", geodesy.line_of_sight(*args).alias("s")).where("s IS NOT NULL").collect()}
    got = {r.k: (r.top_lon, r.top_lat) for r in geodesy.sighted(rows, *args).where("top_lon IS NOT NULL").collect()}
    assert 5 < len(want) < 32 and got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], rtol=0, atol=1e-11) for k in want)
