"""Masks, regions and candidates of tiled pictures: the same however a picture is tiled, and as plain definitions say."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.operators import masks


def paint(rng, h, w, n):
    x = np.full((h, w, 3), (90, 95, 100), np.uint8)
    for _ in range(n):
        y, z, hh, ww = rng.randint(0, h - 1), rng.randint(0, w - 1), rng.randint(1, max(1, h // 2)), rng.randint(1, max(1, w // 2))
        x[y : y + hh, z : z + ww] = rng.choice([(30, 30, 210), (240, 240, 240), (40, 60, 220), (200, 40, 30)])
    for _ in range(200):
        x[rng.randrange(h), rng.randrange(w)] = (20, 20, 200)
    return x


@pytest.fixture(scope="module")
def pictures():
    rng = random.Random(4)
    return {i: paint(rng, *s) for i, s in enumerate([(70, 90, 5), (41, 23, 3), (20, 130, 6), (1, 1, 1), (90, 19, 4)])}


@pytest.fixture(scope="module")
def table(spark, pictures):
    return spark.createDataFrame([(i, *x.shape[:2], bytes(x.tobytes())) for i, x in pictures.items()], "picture long, height int, width int, pixels binary")


def spread_plainly(m, times, most):
    for _ in range(times):
        out = m.copy()
        for y in range(m.shape[0]):
            for x in range(m.shape[1]):
                part = m[max(0, y - 3) : y + 4, max(0, x - 2) : x + 3]
                out[y, x] = part.max() if most else part.min()
        m = out
    return m


def test_morphology(pictures):
    rng = np.random.default_rng(1)
    for shape in ((30, 40), (1, 9), (7, 5)):
        m = (rng.random(shape) < 0.3).astype(np.uint8)
        want = spread_plainly(spread_plainly(m, 2, True), 2, False)
        want = spread_plainly(spread_plainly(want, 1, False), 1, True)
        assert (masks.closed_opened(m) == want).all()


def regions_plainly(m):
    """Boxes and areas of regions by flooding."""
    seen, out = np.zeros_like(m, bool), []
    for y, x in zip(*np.nonzero(m), strict=True):
        if seen[y, x]:
            continue
        todo, points = [(y, x)], []
        seen[y, x] = True
        while todo:
            a, b = todo.pop()
            points.append((a, b))
            for c in range(max(0, a - 1), min(m.shape[0], a + 2)):
                for d in range(max(0, b - 1), min(m.shape[1], b + 2)):
                    if m[c, d] and not seen[c, d]:
                        seen[c, d] = True
                        todo.append((c, d))
        ys, xs = zip(*points, strict=True)
        out.append((min(xs), min(ys), max(xs) + 1, max(ys) + 1, len(points)))
    return sorted(out)


def test_labels_touch_at_corners():
    rng = np.random.default_rng(2)
    for p in (0.2, 0.5, 0.8):
        m = (rng.random((25, 31)) < p).astype(np.uint8)
        label = masks.labelled(m)
        found = []
        for k in np.unique(label[label >= 0]):
            ys, xs = np.nonzero(label == k)
            assert k == ys[0] * 31 + xs[0]
            found.append((xs.min(), ys.min(), xs.max() + 1, ys.max() + 1, len(xs)))
        assert sorted(found) == regions_plainly(m)


@pytest.mark.parametrize("size", [18, 40, 256])
def test_however_tiled(spark, pictures, table, size):
    masked = masks.with_masks(masks.tiles(table, size), size).cache()
    whole = {i: masks.colour_masks(x) for i, x in pictures.items()}
    for r in masked.collect():
        for name, m in zip(("red", "white", "edge"), whole[r.picture], strict=True):
            want = m[r.ty * size : (r.ty + 1) * size, r.tx * size : (r.tx + 1) * size]
            assert (np.frombuffer(r[name], np.uint8).reshape(want.shape) == want).all(), (name, r.picture, r.ty, r.tx)
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    found = {}
    for r in masks.regions(masked).collect():
        found.setdefault(r.picture, []).append((*map(int, r.box), r.area))
    assert {i: sorted(x) for i, x in found.items()} == {i: x for i, (m, _, _) in whole.items() if (x := regions_plainly(m))}
    boxes = [(i, k, float(a), float(b), float(c), float(d)) for i, x in pictures.items() for k, (a, b, c, d) in enumerate([(0, 0, x.shape[1], x.shape[0]), (3.7, 2.2, 15.9, 19.0), (10, 5, 60, 18)]) if c <= x.shape[1] and d <= x.shape[0]]
    df = spark.createDataFrame(boxes, "picture long, ord long, x_min double, y_min double, x_max double, y_max double").withColumn("box", F.struct("x_min", "y_min", "x_max", "y_max"))
    for r in masks.shares(masked, df, size).collect():
        y1, y2, x1, x2 = int(r.box.y_min), int(r.box.y_max), int(r.box.x_min), int(r.box.x_max)
        assert (r.red, r.white, r.edge) == pytest.approx(tuple(m[y1:y2, x1:x2].mean() for m in whole[r.picture]))


def test_candidates_and_empty_tables(spark):
    x = np.full((200, 300, 3), 60, np.uint8)
    x[60:140, 100:180] = 235
    x[60:140, 100:130] = (30, 30, 210)
    x[70:130:4, 140:170] = 20
    df = spark.createDataFrame([(7, 200, 300, bytes(x.tobytes()))], "picture long, height int, width int, pixels binary")
    sets = [sorted((*map(lambda v: round(v, 6), r.box), round(r.score, 9)) for r in masks.tag_candidates(masks.tiles(df, s), s).collect()) for s in (32, 256)]
    assert sets[0] == sets[1] and sets[0]
    best = max(sets[0], key=lambda b: b[-1])
    assert best[0] < 110 and best[2] > 165 and best[1] < 65 and best[3] > 135
    assert masks.tag_candidates(masks.tiles(df.where("false"))).collect() == []


def test_query_as_one_tile(spark):
    from tagloom.plans import queries

    sf = "/root/testdata/sf0.001"
    rows = {(r.picture, r.x_min, r.y_min, r.x_max, r.y_max, r.score) for r in queries.pixel_candidates(spark, sf).collect()}
    some = queries.painted(spark, sf).where("picture % 9 = 0")
    whole = {(r.picture, *(round(v, 6) for v in r.box), round(r.score, 6)) for r in masks.tag_candidates(masks.tiles(some)).collect()}
    assert whole == {r for r in rows if r[0] % 9 == 0} and whole


def test_colours_are_worked_out_once(monkeypatch):
    """A colour that a worker has seen isn't looked at again, in whatever picture; what is told of it is what its pixels say."""
    rng, asked, plain = np.random.default_rng(3), [], masks.images.hue_saturation_value
    monkeypatch.setattr(masks.images, "hue_saturation_value", lambda x: (asked.append(x.size // 3), plain(x))[1])
    masks.colour_table.cache_clear()
    some = rng.integers(0, 256, (50, 3)).astype(np.uint8)
    for _ in range(4):
        x = some[rng.permutation(np.arange(1000) % 50)].reshape(20, 50, 3)
        kind, bright = masks.colours(x)
        hsv = np.rint(plain(x)).reshape(20, 50, 3)
        hsv[..., 0] %= 180
        within = lambda lo, hi: ((hsv >= lo) & (hsv <= hi)).all(2)
        assert (bright == np.rint(masks.images.gray(x))).all() and (kind & masks.KNOWN > 0).all()
        assert ((kind & masks.RED > 0) == np.any([within(*r) for r in masks.REDS], 0)).all() and ((kind & masks.WHITISH > 0) == within(*masks.WHITE)).all()
    assert asked == [len(np.unique(some, axis=0))]
