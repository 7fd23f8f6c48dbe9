"""Local contrast, thresholds and sharpening of brightness pictures (bytes), and the variants of a picture that code readers are given."""

from __future__ import annotations

import numpy as np

# Tiles a side and clip limit of the contrast that readers get; deviation and weight of sharpening; side and offset of local thresholds.
TILES, CLIP, BLUR, SHARPEN, SIDE, OFFSET = 8, 2.5, 1.2, 1.8, 31, 5


def rounded(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def equalised(gray: np.ndarray, clip: float = CLIP, tiles: int = TILES) -> np.ndarray:
    """Contrast-limited equalisation: a clipped histogram's running sum for each tile, and between tiles' centres their mixture.

    Pictures whose sides aren't multiples of `tiles` are continued by reflection for the histograms. What is clipped is
    spread evenly over all values, and the rest of that over values in equal steps.
    """
    h, w = gray.shape
    if not gray.size:
        return gray.copy()
    th, tw = -(-h // tiles), -(-w // tiles)
    p = np.pad(gray, ((0, th * tiles - h), (0, tw * tiles - w)), mode="reflect" if min(h, w) > 1 else "edge")
    at = (np.arange(th * tiles) // th * tiles)[:, None] + np.arange(tw * tiles) // tw
    hist = np.bincount((at * 256 + p).ravel(), minlength=tiles * tiles * 256).reshape(-1, 256)
    most = max(1, int(clip * th * tw / 256))
    over = np.maximum(hist - most, 0).sum(1)
    hist = np.minimum(hist, most) + (over // 256)[:, None]
    rest = over % 256
    step = np.maximum(256 // np.maximum(rest, 1), 1)[:, None]
    value = np.arange(256)
    hist += (value % step == 0) & (value // step < rest[:, None])
    table = rounded(hist.cumsum(1) * (255.0 / (th * tw))).reshape(tiles, tiles, 256)

    def mix(n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The tiles on either side of each place, and how far it lies towards the second."""
        f = np.arange(n) / size - 0.5
        first = np.floor(f).astype(int)
        return np.maximum(first, 0), np.minimum(first + 1, tiles - 1), f - first

    (y1, y2, ya), (x1, x2, xa) = mix(h, th), mix(w, tw)
    ya, xa = ya[:, None], xa[None]
    of = lambda y, x: table[y[:, None], x[None], gray].astype(float)
    return rounded((of(y1, x1) * (1 - xa) + of(y1, x2) * xa) * (1 - ya) + (of(y2, x1) * (1 - xa) + of(y2, x2) * xa) * ya)


def smoothed(x: np.ndarray, deviation: float, side: int, mode: str = "reflect") -> np.ndarray:
    """Mean under a bell curve of this deviation, `side` pixels wide, in both directions; edges continued."""
    k = np.exp(-((np.arange(side) - side // 2) ** 2) / (2 * deviation**2))
    k /= k.sum()
    out = x.astype(float)
    for axis in (0, 1):
        pad = [(side // 2,) * 2 if a == axis else (0, 0) for a in (0, 1)]
        p = np.pad(out, pad, mode=mode if out.shape[axis] > 1 else "edge")
        n = out.shape[axis]
        out = sum(v * (p[i : i + n] if axis == 0 else p[:, i : i + n]) for i, v in enumerate(k))
    return out


def sharpened(gray: np.ndarray, deviation: float = BLUR, weight: float = SHARPEN) -> np.ndarray:
    side = int(round(deviation * 6 + 1)) | 1
    return rounded(weight * gray - (weight - 1) * rounded(smoothed(gray, deviation, side)))


def best_threshold(gray: np.ndarray) -> int:
    """The value that parts darker (up to it) from lighter pixels with the greatest variance between them; the first of equal ones."""
    n = np.bincount(gray.ravel(), minlength=256).astype(float)
    low, total = n.cumsum(), (n * np.arange(256)).cumsum()
    high = low[-1] - low
    ok = (low > 0) & (high > 0)
    apart = np.where(ok, total / np.where(low > 0, low, 1) - (total[-1] - total) / np.where(high > 0, high, 1), 0)
    return int(np.round(low * high * apart**2, 6).argmax())


def local_threshold(gray: np.ndarray, side: int = SIDE, offset: int = OFFSET) -> np.ndarray:
    """White where a pixel is lighter than its surroundings' weighted mean less `offset`."""
    mean = rounded(smoothed(gray, 0.3 * ((side - 1) * 0.5 - 1) + 0.8, side, "edge"))
    return np.where(gray.astype(int) > mean.astype(int) - offset, 255, 0).astype(np.uint8)


def variants(gray: np.ndarray) -> dict[str, np.ndarray]:
    """What a code reader tries, one after the other: the picture, its equalised, sharpened and thresholded forms, and turns by quarters."""
    even = equalised(gray)
    local = local_threshold(even)
    parted = np.where(even > best_threshold(even), 255, 0).astype(np.uint8)
    return {"gray": gray, "equalised": even, "sharp": sharpened(gray), "parted": parted, "local": local, "inverse": 255 - local, "right": np.rot90(gray, -1), "half": np.rot90(gray, 2), "left": np.rot90(gray)}
