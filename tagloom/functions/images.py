"""Pixel functions on numpy arrays, and their Arrow forms for binary columns (rows of height, width, pixels)."""

from __future__ import annotations

import numpy as np


def gray(image: np.ndarray) -> np.ndarray:
    """Brightness of blue, green, red pixels."""
    return image @ np.array([0.114, 0.587, 0.299]) if image.ndim == 3 else image.astype(float)


def sharpness(image: np.ndarray) -> float:
    """Variance of the second difference in both directions; edges mirrored."""
    if image.size == 0:
        return 0.0
    p = np.pad(np.rint(gray(image)), 1, mode="reflect" if min(image.shape[:2]) > 1 else "edge")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]).var())


def crop(image: np.ndarray, box: tuple[float, float, float, float], pad: int = 0) -> np.ndarray:
    """The part of a picture in a box, padded and clipped."""
    h, w = image.shape[:2]
    xs = sorted(min(max(0.0, v), w - 1.0) for v in (box[0] - pad, box[2] + pad))
    ys = sorted(min(max(0.0, v), h - 1.0) for v in (box[1] - pad, box[3] + pad))
    return image[int(ys[0]) : int(ys[1]), int(xs[0]) : int(xs[1])].copy()


def hue_saturation_value(image: np.ndarray) -> np.ndarray:
    """Hue (0 to 180), saturation and value (0 to 255) of blue, green, red pixels."""
    x = image.reshape(-1, 3).astype(float)
    b, g, r = x.T
    v, low = x.max(1), x.min(1)
    d = np.where(v > low, v - low, 1)
    h = np.select([v == r, v == g], [60 * (g - b) / d, 120 + 60 * (b - r) / d], 240 + 60 * (r - g) / d)
    return np.stack([np.where(v > low, h % 360 / 2, 0), np.where(v > 0, 255 * (v - low) / np.where(v > 0, v, 1), 0), v], 1)


def classify_color(image: np.ndarray) -> str:
    """Name of the most frequent hue among coloured pixels; white if hardly any pixel is coloured."""
    if image.size == 0:
        return ""
    hsv = hue_saturation_value(image)
    coloured = hsv[(hsv[:, 1] > 45) & (hsv[:, 2] > 60), 0]
    if len(coloured) < 0.01 * len(hsv):
        return "white"
    bins = np.histogram(coloured, 18, (0, 180))[0]
    hue = int(bins.argmax()) * 10 + 5
    # Upper ends of the colours' hues.
    for end, name in ((15, "red"), (38, "yellow"), (90, "green"), (135, "blue"), (165, "purple")):
        if hue < end:
            return name
    return "red"


def color_boxes(image: np.ndarray, least_area: int = 20) -> list[tuple[int, int, int, int]]:
    """Bounding boxes of connected coloured regions."""
    hsv = hue_saturation_value(image).reshape(*image.shape[:2], 3)
    mask = (hsv[..., 1] > 45) & (hsv[..., 2] > 60)
    label = np.where(mask, np.arange(mask.size).reshape(mask.shape), -1)
    while True:  # least label of a region spreads to its neighbours
        p = np.pad(label, 1, constant_values=-1)
        near = np.stack([p[1:-1, 1:-1], p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]])
        new = np.where(mask, np.where(near < 0, mask.size, near).min(0), -1)
        if (new == label).all():
            break
        label = new
    out = []
    for k in np.unique(label[mask]):
        y, x = np.nonzero(label == k)
        if len(x) >= least_area:
            out.append((int(x.min()), int(y.min()), int(x.max()) + 1, int(y.max()) + 1))
    return out


LEAST_PART = 8  # fixed value


def box_sums(x: np.ndarray, h: int, w: int) -> np.ndarray:
    """Sum of every h x w part, by summed areas."""
    s = np.pad(x, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    return s[h:, w:] - s[:-h, w:] - s[h:, :-w] + s[:-h, :-w]


def match_scores(search: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Normalised cross-correlation of a part with every place of its size in a picture: a product of Fourier transforms, norms by summed areas.

    0 where either has no contrast.
    """
    h, w = part.shape
    part, search = part - part.mean(), search - search.mean()
    shape = [2 ** int(np.ceil(np.log2(n))) for n in search.shape]
    both = np.fft.irfft2(np.fft.rfft2(search, shape) * np.conj(np.fft.rfft2(part, shape)), shape)[: search.shape[0] - h + 1, : search.shape[1] - w + 1]
    spread = box_sums(search * search, h, w) - box_sums(search, h, w) ** 2 / (h * w)
    norm = np.sqrt(np.maximum(spread, 0.0) * (part * part).sum())
    flat = norm <= 1e-6 * h * w
    return np.where(flat, 0.0, both / np.where(flat, 1.0, norm))


def template_shift(before: np.ndarray, after: np.ndarray, box: tuple[int, int, int, int], reach: int = 80) -> tuple[tuple[int, int, int, int], float]:
    """Where the part in `box` (clipped to the picture) has moved to within `reach`, and how well it fits; the first of equally good places, row by row.

    Parts of fewer than LEAST_PART pixels on a side stay where they are and fit 0.
    """
    h, w = before.shape[:2]
    (x1, x2), (y1, y2) = (sorted(min(max(0, v), n - 1) for v in vs) for vs, n in ((box[::2], w), (box[1::2], h)))
    if min(x2 - x1, y2 - y1) < LEAST_PART or after.shape[:2] != (h, w):
        return box, 0.0
    top, left = max(0, y1 - reach), max(0, x1 - reach)
    area = gray(after)[top : min(h, y2 + reach), left : min(w, x2 + reach)]
    scores = np.round(match_scores(area, gray(before)[y1:y2, x1:x2]), 9)
    dy, dx = np.unravel_index(int(scores.argmax()), scores.shape)
    return (left + int(dx), top + int(dy), left + int(dx) + x2 - x1, top + int(dy) + y2 - y1), float(scores[dy, dx])
