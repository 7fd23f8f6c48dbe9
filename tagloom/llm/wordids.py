"""Words of UTF-8 texts as 64-bit ids, and hashes of word sequences, for a whole batch of texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .anchors import hash_of, prefix_hash
from .shingles import BLANK, PLACE, Powers, mix

#: Bytes that are looked at at once.
PART = 1 << 20


def word_bounds(filled: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes and ends of the runs of filled bytes; runs end with their text."""
    starts, ends = filled.copy(), filled.copy()
    starts[1:] &= ~filled[:-1]
    ends[:-1] &= ~filled[1:]
    begins = offsets[:-1][offsets[:-1] < len(filled)]
    starts[begins] = filled[begins]
    last = begins[begins > 0] - 1
    ends[last] |= filled[last]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def pieces_of(data: np.ndarray, cut: np.ndarray = BLANK) -> Iterator[tuple[int, int]]:
    """Ranges of about PART bytes that end before bytes of the given kinds (a table of 256); without any, a range is longer."""
    at = 0
    while at < len(data):
        end = min(at + PART, len(data))
        while end < len(data) and not cut[data[end]]:
            blank = np.flatnonzero(cut[data[end : end + 4096]])
            end = end + int(blank[0]) if len(blank) else min(end + 4096, len(data))
        yield at, end
        at = end


def word_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Id of each word between white space, as it stands, and the number of words before each text (one more at the end)."""
    ids, firsts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, z in pieces_of(data):
        inside = offsets[(offsets > a) & (offsets < z)] - a
        piece = data[a:z]
        starts, ends = word_bounds(~BLANK[piece], np.concatenate([[0], inside, [z - a]]))
        ids.append(hash_of(prefix_hash(piece), starts, ends))
        firsts.append(starts + a)
    return np.concatenate(ids), np.searchsorted(np.concatenate(firsts), offsets)


class Windows:
    """Hashes of any windows of a sequence of ids."""

    def __init__(self, ids: np.ndarray):
        self.n = len(ids)
        up, _ = Powers.upto(self.n + 1)
        self.run = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * up[: self.n], dtype=np.uint64)]) for x in (ids, mix(ids ^ PLACE[1]))]

    def hash(self, start: np.ndarray, size: int, kind: int = 0) -> np.ndarray:
        """64 bits of the windows of `size` ids from each start; two kinds that don't depend on one another."""
        _, down = Powers.upto(self.n + 1)
        run = self.run[kind]
        return mix((run[start + size] - run[start]) * down[start] + np.uint64(size * int(PLACE[kind + 2]) & 0xFFFFFFFFFFFFFFFF))


def row_hash(cols: list[np.ndarray]) -> np.ndarray:
    """xxhash64 of columns of longs as Spark has it."""
    p1, p2, p3, p4, p5 = (np.uint64(v) for v in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda v, r: (v << np.uint64(r)) | (v >> np.uint64(64 - r))
    h = np.full(len(cols[0]), 42, np.uint64)
    for x in cols:
        h = (h + p5 + np.uint64(8)) ^ (turn(x.view(np.uint64) * p2, 31) * p1)
        h = turn(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        h = h ^ (h >> np.uint64(32))
    return h.view(np.int64)
