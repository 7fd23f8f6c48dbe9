"""Word shingles of UTF-8 texts as 64-bit hashes, for a whole batch of texts at once."""

from __future__ import annotations

import numpy as np

WORDS = 5
#: Multiplier of the rolling hash and its inverse modulo 2^64.
BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))
MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
#: Odd multipliers of a shingle's words.
PLACE = [np.uint64(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64)) for i in range(WORDS)]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the base and of its inverse, as many as were ever asked for."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) <= n:
            size = max(n + 1, 1 << 20)
            for name, base in (("up", BASE), ("down", UNBASE)):
                x = np.full(size, base, np.uint64)
                x[0] = 1
                setattr(cls, name, np.cumprod(x, dtype=np.uint64))
        return cls.up, cls.down


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of texts that lie end to end, and the number of words before each text (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    filled = ~BLANK[data]
    first = filled.copy()
    first[1:] &= ~filled[:-1]
    begins = offsets[:-1][(offsets[:-1] < n)]
    first[begins] = filled[begins]
    starts = np.flatnonzero(first)
    last = filled.copy()
    last[:-1] &= ~filled[1:]
    ends_at = begins[begins > 0] - 1
    last[ends_at] |= filled[ends_at]
    ends = np.flatnonzero(last) + 1
    up, down = Powers.upto(n)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:n], out=run[1:])
    hashes = mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64) * PLACE[0])
    return hashes, np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than a shingle's make one shingle, no words none."""
    words, at = word_hashes(data, offsets)
    k = WORDS
    whole = np.zeros(max(len(words) - k + 1, 0), np.uint64)
    for i in range(k):
        whole += words[i : i + len(whole)] * PLACE[i]
    whole = mix(whole + np.uint64(k))
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            x = np.sort(whole[a : b - k + 1])
            out.append(x[np.append(True, x[1:] != x[:-1])])
        elif b > a:
            short = np.uint64(0)
            with np.errstate(over="ignore"):
                for i in range(b - a):
                    short += words[a + i] * PLACE[i]
                out.append(mix(np.array([short + np.uint64(b - a)])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_print(x: np.ndarray) -> bytes:
    """128 bits that stand for a set of hashes."""
    with np.errstate(over="ignore"):
        a = mix(x + PLACE[1]).sum(dtype=np.uint64)
        b = (mix(x ^ PLACE[2]) * PLACE[3]).sum(dtype=np.uint64)
    return np.array([a, b], np.uint64).tobytes()
