"""Local contrast and thresholds against plain loops, on odd sizes."""

import math

import numpy as np
import pytest

from tagloom.functions import contrast
from tagloom.plans import queries

SHAPES = [(37, 53), (8, 8), (64, 40), (9, 100), (3, 5), (1, 7)]


def reflect(i, n):
    while not 0 <= i < n:
        i = -i if i < 0 else 2 * (n - 1) - i
    return i


def equalised_plainly(g, clip, tiles=8):
    h, w = g.shape
    th, tw = math.ceil(h / tiles), math.ceil(w / tiles)
    mirror = (lambda i, n: reflect(i, n)) if min(h, w) > 1 else (lambda i, n: min(i, n - 1))
    table = {}
    for ty in range(tiles):
        for tx in range(tiles):
            hist = [0] * 256
            for y in range(ty * th, ty * th + th):
                for x in range(tx * tw, tx * tw + tw):
                    hist[g[mirror(y, h), mirror(x, w)]] += 1
            most = max(1, int(clip * th * tw / 256))
            over = sum(max(0, n - most) for n in hist)
            hist = [min(n, most) + over // 256 for n in hist]
            rest = over % 256
            step, i = max(256 // rest, 1) if rest else 1, 0
            while i < 256 and rest > 0:
                hist[i] += 1
                i, rest = i + step, rest - 1
            total, row = 0, []
            for n in hist:
                total += n
                row.append(min(255, round(total * (255.0 / (th * tw)))))
            table[ty, tx] = row
    out = np.zeros_like(g)
    for y in range(h):
        for x in range(w):
            fy, fx = y / th - 0.5, x / tw - 0.5
            y1, x1 = math.floor(fy), math.floor(fx)
            a, b = fy - y1, fx - x1
            ys, xs = (max(y1, 0), min(y1 + 1, tiles - 1)), (max(x1, 0), min(x1 + 1, tiles - 1))
            t = lambda i, k: table[ys[i], xs[k]][g[y, x]]  # noqa: B023, E731
            out[y, x] = min(255, round((t(0, 0) * (1 - b) + t(0, 1) * b) * (1 - a) + (t(1, 0) * (1 - b) + t(1, 1) * b) * a))
    return out


def smoothed_plainly(g, deviation, side, mirror):
    k = [math.exp(-((i - side // 2) ** 2) / (2 * deviation**2)) for i in range(side)]
    k = [v / sum(k) for v in k]
    h, w = g.shape
    at = lambda i, n: mirror(i, n) if n > 1 else 0
    mid = [[sum(k[i] * g[at(y + i - side // 2, h), x] for i in range(side)) for x in range(w)] for y in range(h)]
    return np.array([[sum(k[i] * mid[y][at(x + i - side // 2, w)] for i in range(side)) for x in range(w)] for y in range(h)])


@pytest.mark.parametrize("shape", SHAPES)
def test_as_loops(shape):
    rng = np.random.default_rng(sum(shape))
    for g in (rng.integers(0, 256, shape), rng.integers(90, 110, shape), np.full(shape, 7)):
        g = g.astype(np.uint8)
        for clip in (2.0, 2.5):
            assert (contrast.equalised(g, clip) == equalised_plainly(g, clip)).all()
        assert contrast.smoothed(g, 1.2, 9) == pytest.approx(smoothed_plainly(g, 1.2, 9, reflect), abs=1e-9)
        side = 31
        mean = np.clip(np.rint(smoothed_plainly(g, 0.3 * 14 + 0.8, side, lambda i, n: min(max(i, 0), n - 1))), 0, 255)
        assert (contrast.local_threshold(g) == np.where(g > mean - 5, 255, 0)).all()
        blur = np.clip(np.rint(smoothed_plainly(g, 1.2, 9, reflect)), 0, 255)
        assert (contrast.sharpened(g) == np.clip(np.rint(1.8 * g - 0.8 * blur), 0, 255)).all()


def test_threshold_parts_best():
    rng = np.random.default_rng(3)
    g = np.concatenate([rng.normal(60, 9, 300), rng.normal(190, 12, 200)]).clip(0, 255).astype(np.uint8)
    variance = lambda t: 0.0 if not (g <= t).any() or not (g > t).any() else (g <= t).sum() * (g > t).sum() * (g[g <= t].mean() - g[g > t].mean()) ** 2
    assert contrast.best_threshold(g) == max(range(256), key=lambda t: (round(variance(t), 6), -t))
    assert contrast.best_threshold(np.full(9, 4, np.uint8)) == 0


def test_variants_and_query(spark):
    g = np.arange(35, dtype=np.uint8).reshape(5, 7)
    v = contrast.variants(g)
    assert v["right"].shape == (7, 5) and v["right"][0, -1] == g[0, 0] and (v["inverse"] == 255 - v["local"]).all()
    assert set(np.unique(v["parted"])) <= {0, 255}
    assert contrast.equalised(np.zeros((0, 4), np.uint8)).shape == (0, 4)
    sf = "/root/testdata/sf0.001"
    rows = queries.contrast_variants(spark, sf).collect()
    assert len(rows) == 9 * queries.painted(spark, sf).count()
    gray = {r.picture: r.mean for r in rows if r.variant == "gray"}
    assert all(r.mean == gray[r.picture] for r in rows if r.variant in ("right", "half", "left"))
