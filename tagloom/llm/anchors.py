"""Anchors of byte windows: positions chosen by content, the same in every copy of a window.

For each window of `span` bytes of a text the GRAM bytes of smallest hash within it are its anchor (the leftmost of equal
ones). Equal windows have their anchor at the same distance from their start, so windows that repeat meet under the
anchor's hash; only one position in about span / 2 is an anchor. Windows of one anchor are told apart further by the
bytes that all windows on its left or right side share, so that a frequent anchor alone brings nothing together.
"""

from __future__ import annotations

import numpy as np

from .shingles import PLACE, Powers, mix

GRAM = 24
NO = np.uint64(0xFFFFFFFFFFFFFFFF)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running sums from which hash_of takes the hash of any piece."""
    up, _ = Powers.upto(len(data))
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=run[1:])
    return run


def hash_of(run: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = Powers.upto(len(run))
    return mix((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64) * PLACE[0])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` numbers in a row, by running minima of blocks from either side."""
    n = len(x)
    full = np.full(-(-n // width) * width, NO, np.uint64)
    full[:n] = x
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def windows(data: np.ndarray, offsets: np.ndarray, span: int) -> dict[str, np.ndarray]:
    """Runs of windows of `span` bytes with one anchor and side, of texts that lie end to end.

    Returns arrays: text (number), first and last start of the run's windows (in data), key (64 bits of anchor and side).
    """
    width = span - GRAM + 1  # positions of a window at which its anchor may lie
    half = width // 2
    none = {k: np.zeros(0, np.int64) for k in ("text", "first", "last")} | {"key": np.zeros(0, np.uint64)}
    if len(data) < span:
        return none
    run = prefix_hash(data)
    at = np.arange(len(data) - GRAM + 1)
    gram = hash_of(run, at, at + GRAM)
    # 40 bits of hash, 24 of position: the least is the leftmost of the least; longer data comes in parts
    low = (gram & ~np.uint64(0xFFFFFF)) | at.astype(np.uint64)
    least = sliding_least(low, width)
    anchor = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    starts = np.arange(len(anchor))
    text = np.searchsorted(offsets, starts, "right") - 1
    ok = starts + span <= offsets[text + 1]
    starts, text, anchor = starts[ok], text[ok], anchor[ok]
    if not len(starts):
        return none
    right = (anchor - starts) < half
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (right[1:] != right[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    ends = np.append(new[1:], len(starts)) - 1
    a, r = anchor[new], right[new]
    core = hash_of(run, np.where(r, a, a - half), np.where(r, a + span - half, a + GRAM))
    return {"text": text[new], "first": starts[new], "last": starts[ends], "key": mix(core ^ np.where(r, PLACE[1], PLACE[2]))}
