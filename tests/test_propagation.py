"""Template matching and chains of labels against plain definitions."""

import numpy as np
import pytest

from tagloom.functions import images
from tagloom.operators import propagation
from tagloom.plans import media

SF = "/root/testdata/sf0.001"


def scores_plainly(search, part):
    h, w = part.shape
    a = part - part.mean()
    out = np.zeros((search.shape[0] - h + 1, search.shape[1] - w + 1))
    for y in range(out.shape[0]):
        for x in range(out.shape[1]):
            c = search[y : y + h, x : x + w] - search[y : y + h, x : x + w].mean()
            norm = np.sqrt((a * a).sum() * (c * c).sum())
            out[y, x] = (a * c).sum() / norm if norm > 1e-6 * h * w else 0.0
    return out


@pytest.mark.parametrize("shape, part", [((30, 41), (7, 5)), ((9, 9), (9, 9)), ((12, 33), (1, 4)), ((16, 16), (16, 3))])
def test_scores(shape, part):
    rng = np.random.default_rng(5)
    search = rng.integers(0, 256, shape).astype(float)
    search[:6, :6] = 7  # no contrast
    p = search[-part[0] :, -part[1] :] + rng.normal(0, 3, part)
    assert images.match_scores(search, p) == pytest.approx(scores_plainly(search, p), abs=1e-7)
    assert (images.match_scores(search, np.full(part, 9.0)) == 0).all()


def test_shift_within_reach_and_outside():
    rng = np.random.default_rng(6)
    a = rng.integers(0, 256, (60, 80)).astype(np.uint8)
    b = np.roll(a, (4, -6), (0, 1))
    assert images.template_shift(a, b, (30, 20, 50, 35), 10) == ((24, 24, 44, 39), 1.0)
    assert images.template_shift(a, b, (30, 20, 50, 35), 3)[1] < 0.9
    assert images.template_shift(a, b, (70, 20, 90, 35), 10) == ((64, 24, 73, 39), 1.0)
    assert images.template_shift(a, b, (5, 5, 5, 9)) == ((5, 5, 5, 9), 0.0)
    assert images.template_shift(a, b, (5, 5, 12, 30)) == ((5, 5, 12, 30), 0.0)
    colour = np.stack([a, a, a], 2)
    assert images.template_shift(colour, np.roll(colour, 2, 1), (10, 10, 30, 30), 5)[0] == (12, 10, 32, 30)


def test_query_as_chains_over_whole_videos(spark):
    frames, labels = media.moving_pictures(spark, SF).collect(), media.small_labels(spark, SF).collect()
    held, boxes, want = {}, {}, {}
    for r in frames:
        held.setdefault(r.filename, {})[r.frame_index] = np.frombuffer(r.luma, np.uint8).reshape(48, 64)
    for r in labels:
        boxes.setdefault((r.filename, r.frame_index), {})[r.ord] = tuple(int(r[c]) for c in ("x_min", "y_min", "x_max", "y_max"))
    for (name, base), b in boxes.items():
        want |= {(name, base, k, o, *box): s for k, o, box, s in propagation.chain(held[name], base, b, 2, 12, propagation.LEAST)}
    got = {tuple(r)[:-1]: r.score for r in media.propagated_labels(spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    assert len(want) > 500 and {k for _, _, k, *_ in want} == {-2, -1, 1, 2}


def test_missing_frames_end_chains(spark):
    rng = np.random.default_rng(7)
    a = rng.integers(0, 256, (40, 40)).astype(np.uint8)
    frames = spark.createDataFrame([("v", k, 40, 40, bytes(np.roll(a, k, 1).tobytes())) for k in (1, 2, 3, 5, 17)], "filename string, frame_index long, width int, height int, luma binary")
    labels = spark.createDataFrame([("v", 2, 1, 10.5, 10.0, 20.0, 20.0), ("v", 9, 2, 1.0, 1.0, 9.0, 9.0), ("w", 2, 3, 1.0, 1.0, 9.0, 9.0)], "filename string, frame_index long, ord long, x_min double, y_min double, x_max double, y_max double")
    got = {(r.base, r.offset, r.ord, r.x_min) for r in propagation.propagated_labels(frames, labels, 3, 5).collect()}
    assert got == {(2, -1, 1, 9), (2, 1, 1, 11)}
    assert propagation.propagated_labels(frames.where("false"), labels).collect() == []
