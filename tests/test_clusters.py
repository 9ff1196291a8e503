"""Density clusters and regions against all pairs of pixels."""

import numpy as np
import pytest

from gridloom.operators import clusters as K
from gridloom.operators import grid as G


def brute(hits, eps, least):
    """Labels by definition: least core of the cluster, nearest core for borders, None for noise."""
    points = sorted(hits)
    near = {p: [q for q in points if (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= eps * eps] for p in points}
    cores = {p for p in points if len(near[p]) >= least}
    label = {}
    for p in points:
        if p in cores and p not in label:
            todo = [p]
            while todo:
                q = todo.pop()
                if q not in label:
                    label[q] = p
                    todo += [x for x in near[q] if x in cores]
    out = {}
    for p in points:
        best = min((((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2, q) for q in near[p] if q in cores), default=None)
        owner = label[best[1]] if best else None
        out[p] = (owner and owner[0] * K.WIDTH + owner[1] if owner else None, p in cores)
    return out


@pytest.mark.parametrize("eps,least,share,size", [(5, 12, 0.15, 40), (1, 3, 0.5, 30), (2.5, 4, 0.2, 30), (9, 30, 0.1, 50), (12, 5, 0.01, 120), (5, 1, 0.02, 40), (5, 10_000, 0.3, 20)])
def test_clusters(spark, eps, least, share, size):
    rng = np.random.default_rng(int(eps * 10) + least)
    rows, want = [], {}
    for frame in range(2):
        hits = [(int(i), int(j)) for i, j in zip(*np.nonzero(rng.random((size, size + 7)) < share))]
        rows += [(frame, i, j, 2.0) for i, j in hits] + [(frame, size + 1, k, v) for k, v in enumerate((1.0, float("nan"), None))]
        want |= {(frame, *p): x for p, x in brute(hits, eps, least).items()}
    got = K.density_clusters(spark.createDataFrame(rows, "frame int, i int, j int, v double"), 1.0, eps, least).collect()
    assert len(got) == len(want) and {(r.frame, r.i, r.j): (r.label, r.core) for r in got} == want


def test_no_hits(spark):
    none = spark.createDataFrame([], "frame int, i int, j int, v double")
    assert K.density_clusters(none, 1.0, 5, 3).count() == 0


@pytest.mark.parametrize("connectivity", [4, 8])
def test_regions(spark, connectivity):
    rng = np.random.default_rng(connectivity)
    rows, want = [], {}
    snake = [(i, j) for i in range(0, 40, 2) for j in range(60)] + [(i, 59 if i % 4 == 1 else 0) for i in range(1, 40, 2)]
    for frame, hits in enumerate([set(zip(*np.nonzero(rng.random((40, 60)) < 0.45))), set(snake), {(3, 3)}]):
        hits = {(int(i), int(j)) for i, j in hits}
        rows += [(frame, i, j) for i, j in hits]
        left = set(hits)
        while left:
            todo, region = [min(left)], set()
            while todo:
                p = todo.pop()
                if p in left:
                    left.remove(p)
                    region.add(p)
                    todo += [(p[0] + a, p[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if connectivity == 8 or a * b == 0]
            want |= {(frame, *p): min(region)[0] * (1 << 20) + min(region)[1] for p in region}
    got = G.connected_regions(spark.createDataFrame(rows + rows[:5], "frame int, i int, j int"), connectivity).collect()
    assert len(got) == len(want) and {(r.frame, r.i, r.j): r.label for r in got} == want
