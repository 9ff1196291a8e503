"""The report of a frame against plain definitions, on frames of 8 x 8 and 256 x 256 pixels."""

import numpy as np
import pytest

from gridloom.operators import insight as I

DISC = [(a, b) for a in range(-3, 4) for b in range(-3, 4) if a * a + b * b <= 9]


def around(data, cells, take):
    """``take`` over the neighbours that exist, offset by offset."""
    h, w = data.shape
    stack = np.full((len(cells), h, w), np.nan)
    for k, (a, b) in enumerate(cells):
        stack[k, max(0, -a) : h - max(0, a), max(0, -b) : w - max(0, b)] = data[max(0, a) : h + min(0, a), max(0, b) : w + min(0, b)]
    return take(stack, axis=0)


def plain(data, over):
    active, n = data > over, int((data > over).sum())
    square = [(a, b) for a in range(-2, 3) for b in range(-2, 3)]
    hot = (around(data, square, np.nanmax) == data) & (data > np.percentile(data[active], 80))
    mask = active.astype(float)
    opened = around(around(mask, DISC, np.nanmin), DISC, np.nanmax).sum()
    closed = around(around(mask, DISC, np.nanmax), DISC, np.nanmin).sum()
    k = np.arange(-8, 9)
    w = np.exp(-k * k / 8)
    w = w / w.sum()
    index = lambda size: np.clip(np.arange(size)[:, None] + k, 0, size - 1)
    soft = (data[:, index(data.shape[1])] * w).sum(axis=2)
    soft = (soft.T[:, index(data.shape[0])] * w).sum(axis=2).T
    texture = np.abs(data - soft)
    gy, gx = np.gradient(data)
    steep = np.hypot(gx, gy)
    p = np.percentile(data[active], [33, 66, 90, 99])
    return {
        "mean": data.mean(), "std": data.std(), "active": n, "pixels": data.size, "light": p[0], "extreme": p[3], "light_area": int((active & (data <= p[0])).sum()), "moderate_area": int(((data > p[0]) & (data <= p[1])).sum()), "heavy_area": int(((data > p[1]) & (data <= p[2])).sum()), "extreme_area": int((data > p[2]).sum()),
        "gradient_max": steep.max(), "gradient_mean": steep.mean(), "direction_std": np.arctan2(gy, gx).std(), "texture_mean": texture.mean(), "texture_max": texture.max(), "smoothness": 1 - texture.std() / (data.std() + 1e-10),
        "rough_area": int((texture > np.percentile(texture, 90)).sum()), "hotspots": int(hot.sum()), "strongest": data[hot].max() if hot.any() else None, "compactness": opened / n, "connectivity": closed / n, "fragmentation": 1 - opened / (closed + 1e-10),
    }


def test_figures(spark):
    rng = np.random.default_rng(8)
    big = I.smoothed(rng.gamma(1.0, 2.0, (256, 256)), 2.0)
    frames = {1: rng.gamma(0.5, 3.0, (8, 8)), 2: big, 3: np.where(rng.random((20, 33)) < 0.9, 5.0, 0.0), 4: np.zeros((5, 6))}
    frames[5] = frames[1].copy()
    frames[5][0, 0] = np.nan
    rows = [(f, k, row.tolist()) for f, data in frames.items() for k, row in enumerate(data)]
    over = 1.0
    got = {r.frame: r for r in I.frame_figures(spark.createDataFrame(rows, "frame long, line int, values array<double>").repartition(5), over).collect()}
    for f in (1, 2, 3, 5):
        for name, want in plain(np.nan_to_num(frames[f]), over).items():
            assert got[f][name] == (pytest.approx(want, abs=2e-6) if want is not None else None), (f, name)
    assert got[4].active == 0 and got[4].light is None and got[4].hotspots == 0 and got[4].compactness == 0 and got[4].texture_max == 0


@pytest.mark.parametrize("radius", [0, 1, 2, 5, 40])
def test_running(radius):
    rng = np.random.default_rng(radius)
    rows = rng.random((3, 23))
    want = np.array([[r[max(0, k - radius) : k + radius + 1].min() for k in range(23)] for r in rows])
    assert (I.running(rows, radius, np.minimum, np.inf) == want).all()
