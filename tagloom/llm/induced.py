"""External induced suffix sorting with common-prefix values.

A text's suffixes are of type S (smaller than the next suffix) or L; the S ones after an L one are its seeds. The seeds are
sorted by recursion on the string of their substrings' names, or directly once that is small. Then all suffixes follow by
induction: symbols are taken in ascending order for the L type and in descending order for the S type, and each suffix
taken from the queue puts the one before it in the queue of its own first symbol.

The queue is a priority queue over symbols whose entries, (position, common prefix with the entry before), are kept in
order of arrival: in memory up to a budget, then appended to files of a scratch folder that goes when the sort ends.
The common prefix of two entries is one more than the least over the entries between their sources.

Order and common prefixes are exact up to DEPTH symbols, as far as repeats of that length need them.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

#: Entries that a queue holds in memory before it appends to files; a full shard has some millions.
IN_MEMORY = 500_000
#: Strings of names up to this length are sorted directly.
BASE = 16_000_000


class SymbolQueue:
    """Entries by symbol, in order of arrival; on disk beyond `budget` entries."""

    def __init__(self, symbols: int, budget: int = IN_MEMORY):
        self.parts: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(symbols)]
        self.filed: dict[int, list[tuple[int, int]]] = {}
        self.held, self.budget, self.folder, self.file = 0, budget, None, None

    def put(self, symbol: int, positions: np.ndarray, common: np.ndarray) -> None:
        self.parts[symbol].append((positions, common))
        self.held += len(positions)
        if self.held > self.budget:
            self.spill()

    def spill(self) -> None:
        if self.file is None:
            self.folder = tempfile.TemporaryDirectory(prefix="queue-")
            self.file = open(os.path.join(self.folder.name, "entries"), "w+b")  # noqa: SIM115
        self.file.seek(0, 2)
        for symbol, parts in enumerate(self.parts):
            for positions, common in parts:
                self.filed.setdefault(symbol, []).append((self.file.tell(), len(positions)))
                positions.astype(np.int64).tofile(self.file)
                common.astype(np.int32).tofile(self.file)
            self.parts[symbol] = []
        self.held = 0

    def take(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        """All entries of a symbol; none are put to it afterwards."""
        parts = []
        for at, n in self.filed.pop(symbol, []):
            self.file.seek(at)
            positions = np.fromfile(self.file, np.int64, n).astype(np.int32)
            parts.append((positions, np.fromfile(self.file, np.int32, n)))
        self.held -= sum(len(p) for p, _ in self.parts[symbol])
        parts, self.parts[symbol] = parts + self.parts[symbol], []
        if len(parts) == 1:
            return parts[0]
        none = [(np.zeros(0, np.int32), np.zeros(0, np.int32))]
        return tuple(np.concatenate(x) for x in zip(*(parts or none), strict=True))

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.folder.cleanup()


def next_different(text: np.ndarray) -> np.ndarray:
    """For each position the next one of another symbol (the length, if none)."""
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1]) + 1
    return np.repeat(np.append(change, n), np.diff(np.concatenate([[0], change, [n]]))).astype(np.int32)


def suffix_types(text: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Whether each suffix is of type S; behind the text stands a symbol smaller than all."""
    s = np.zeros(len(text), bool)
    inside = after < len(text)
    s[inside] = text[after[inside]] > text[inside]
    return s


def seed_names(text: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Ranks of the substrings from each seed to the next one, in the order that suffixes have.

    Where one is the start of another, the longer is the smaller: its suffix goes on downward there. The last one ends
    with the text, behind which stands a symbol smaller than all, so it is the smaller there.
    """
    ends = np.append(seeds[1:], len(text) - 1)
    length, wide = ends - seeds + 1, text.dtype.itemsize > 1
    step = 1 if wide else 8
    names, r = np.zeros(len(seeds), np.int64), 0
    some, last = np.arange(len(seeds)), len(seeds) - 1
    padded = np.concatenate([text, np.zeros(8, text.dtype)])
    words = None if wide else np.ndarray(len(text) + 1, ">u8", padded, strides=(1,))
    while len(some):
        at, left = seeds[some] + r * step, np.clip(length[some] - r * step, 0, step)
        if wide:
            key = np.where(left > 0, padded[np.minimum(at, len(text))].astype(np.uint64), np.where(some == last, np.uint64(0), np.uint64(0xFFFFFFFFFFFFFFFF)))
        else:
            key = words[np.minimum(at, len(text))].astype(np.uint64)
            fill = ((8 - left) * 8).astype(np.uint64)
            low = np.where(left == 0, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << np.minimum(fill, np.uint64(63))) - np.uint64(1))
            key = np.where(some == last, np.where(left == 0, np.uint64(0), key & ~low), key | low)
        names[some] = refine(names[some], key)
        r += 1
        # go on with the groups that hold a longer substring
        open_ = np.zeros(int(names.max()) + 1, bool)
        open_[names[some[length[some] > r * step]]] = True
        some = np.flatnonzero(open_[names])
    same = names == names[last]
    same[last] = False
    names[same] += 1
    return names


def refine(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Ranks of (group, key), where a group's rank is the number of entries in smaller groups: new ranks are so, too."""
    order = np.argsort(key, kind="stable") if not group.any() else np.lexsort((key, group))
    g, k = group[order], key[order]
    new_group = np.append(True, g[1:] != g[:-1])
    new = new_group | np.append(True, k[1:] != k[:-1])
    at = np.arange(len(order))
    first = np.maximum.accumulate(np.where(new_group, at, 0))
    rank = np.maximum.accumulate(np.where(new, at, 0)) - first + g
    out = np.empty_like(group)
    out[order] = rank
    return out


def sort_names(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a string of ranks, by doubling, exact up to `depth` symbols."""
    rank, h, n = names.astype(np.int64), 1, len(names)
    some = None
    while True:
        count = np.bincount(rank, minlength=n)
        some = np.flatnonzero(count[rank] > 1)
        if not len(some) or h >= depth:
            return np.argsort(rank, kind="stable")
        second = np.zeros(len(some), np.int64)
        inside = some + h < n
        second[inside] = rank[some[inside] + h] + 1
        key = rank[some] * (n + 2) + second
        order = np.argsort(key)
        k = key[order]
        at = np.arange(len(order))
        new = np.append(True, k[1:] != k[:-1])
        g = rank[some[order]]
        new_group = np.append(True, g[1:] != g[:-1])
        first = np.maximum.accumulate(np.where(new_group, at, 0))
        new_rank = np.maximum.accumulate(np.where(new, at, 0)) - first + g
        rank[some[order]] = new_rank
        h *= 2


def common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of the suffixes at a and b, `depth` at most, by words of eight bytes."""
    out = np.zeros(len(a), np.int32)
    n = len(text)
    padded = np.concatenate([text, np.zeros(16, text.dtype)])
    words = np.ndarray(n + 9, ">u8", padded, strides=(1,))
    some, at = np.arange(len(a)), 0
    while len(some) and at < depth:
        x, y = a[some] + at, b[some] + at
        differ = words[np.minimum(x, n)].astype(np.uint64) ^ words[np.minimum(y, n)].astype(np.uint64)
        equal = differ == 0
        if not equal.all():
            d = differ[~equal]
            out[some[~equal]] = at + (63 - np.floor(np.log2(d.astype(np.float64) * (1 - 2**-52))).clip(0).astype(np.int32)) // 8
        some, at = some[equal], at + 8
        out[some] = at
    return np.minimum(np.minimum(out, depth), n - np.maximum(a, b)).astype(np.int32)


def push_groups(queue: SymbolQueue, symbols: np.ndarray, positions: np.ndarray, sources: np.ndarray, common: np.ndarray | None, first_common: np.ndarray, cap: int) -> None:
    """Put positions, in the order of their sources, to the queues of their symbols.

    common[k]: common prefix of source k with source k - 1; first_common: for each symbol what the first entry shares
    with the last one put before (0 if none was).
    """
    order = np.argsort(symbols, kind="stable")
    s, p, src = symbols[order], positions[order], sources[order]
    starts = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    if common is None:
        value = np.zeros(len(p), np.int32)
    else:
        value = np.empty(len(p), np.int32)
        if len(p) > 1:
            # least of common over (source before, source]: between groups the result isn't used
            lo, hi = src[:-1] + 1, src[1:] + 1
            good = hi > lo
            pairs = np.empty(2 * int(good.sum()), np.int64)
            pairs[0::2], pairs[1::2] = lo[good], hi[good]
            got = np.minimum.reduceat(np.append(common, np.int32(0)), pairs)[0::2] if len(pairs) else np.zeros(0, np.int32)
            value[1:][good] = np.minimum(got + 1, cap)
    for a, b in zip(starts.tolist(), np.append(starts[1:], len(s)).tolist(), strict=True):
        symbol = int(s[a])
        value[a] = first_common[symbol]
        first_common[symbol] = 1
        queue.put(symbol, p[a:b], value[a:b])


def suffix_order(text: np.ndarray, depth: int, with_common: bool = True, base: int = BASE, budget: int = IN_MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all suffixes in order, and the common prefix of each with the one before (0 for the first).

    text: unsigned bytes, or non-negative numbers without gaps that matter (only their order does).
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    after = next_different(text)
    is_s = suffix_types(text, after)
    run = after - np.arange(n, dtype=np.int32)
    seeds = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    if len(seeds):
        names = seed_names(text, seeds)
        unique = len(np.unique(names)) == len(names)
        if unique or len(names) <= base:
            order = np.argsort(names, kind="stable") if unique else sort_names(names, depth)
        else:
            dense = np.unique(names, return_inverse=True)[1].astype(np.int32)
            order = suffix_order(dense, depth, False, base, budget)[0]
        seeds = seeds[order].astype(np.int32)
    symbols = int(text.max()) + 1
    seed_common = np.zeros(len(seeds), np.int32)
    if with_common and len(seeds) > 1:
        seed_common[1:] = common_prefixes(text, seeds[:-1], seeds[1:], depth)
    at_symbol = np.searchsorted(text[seeds], np.arange(symbols + 1)) if len(seeds) else np.zeros(symbols + 1, int)
    used = np.flatnonzero(np.bincount(text, minlength=symbols)).tolist()
    keep = (lambda x: x) if with_common else (lambda x: None)

    # L type, in ascending order of symbols
    queue, first = SymbolQueue(symbols, budget), np.zeros(symbols, np.int32)
    queue.put(int(text[n - 1]), np.array([n - 1], np.int32), np.zeros(1, np.int32))
    first[text[n - 1]] = 1
    lower: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for c in used:
        parts = [queue.take(c)]
        while len(parts[-1][0]):  # runs of the symbol, one longer each time
            pos, com = parts[-1]
            src = np.flatnonzero((pos > 0) & (text[pos - 1] == c))
            if not len(src):
                break
            nxt = np.empty(len(src), np.int32)
            nxt[0] = min(len(parts), depth)
            if len(src) > 1:
                nxt[1:] = np.minimum(np.minimum.reduceat(np.append(com, 0), np.stack([src[:-1] + 1, src[1:] + 1], 1).ravel())[0::2] + 1, depth)
            parts.append((pos[src] - 1, nxt))
        pos, com = (np.concatenate(x) for x in zip(*parts, strict=True))
        lower[c] = (pos, com)
        mine, mine_common = seeds[at_symbol[c] : at_symbol[c + 1]], seed_common[at_symbol[c] : at_symbol[c + 1]].copy()
        if len(mine):
            mine_common[0] = min(run[pos[-1]], run[mine[0]], depth) if len(pos) else 0
        all_pos, all_com = np.concatenate([pos, mine]), np.concatenate([com, mine_common])
        before = np.maximum(all_pos - 1, 0)
        src = np.flatnonzero((all_pos > 0) & (text[before] > c))
        if len(src):
            push_groups(queue, text[before[src]], before[src], src, keep(all_com), first, depth)
    queue.close()

    # S type, in descending order of symbols; sources from the largest
    queue, first = SymbolQueue(symbols, budget), np.zeros(symbols, np.int32)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for c in reversed(used):
        parts = [queue.take(c)]
        while len(parts[-1][0]):
            pos, com = parts[-1]
            src = np.flatnonzero((pos > 0) & (text[pos - 1] == c))
            if not len(src):
                break
            nxt = np.empty(len(src), np.int32)
            nxt[0] = min(len(parts), depth)
            if len(src) > 1:
                nxt[1:] = np.minimum(np.minimum.reduceat(np.append(com, 0), np.stack([src[:-1] + 1, src[1:] + 1], 1).ravel())[0::2] + 1, depth)
            parts.append((pos[src] - 1, nxt))
        s_pos, s_com = (np.concatenate(x) for x in zip(*parts, strict=True))
        l_pos, l_com = lower.pop(c)
        # descending: the common prefix of each with the one before it, which is larger
        down_com = np.append(l_com[1:][::-1], np.int32(0)) if len(l_pos) else l_com
        down = np.concatenate([[0], down_com[:-1]]).astype(np.int32) if len(l_pos) else l_com
        if len(l_pos) and len(s_pos):
            down[0] = min(run[s_pos[-1]], run[l_pos[-1]], depth)
        all_pos, all_com = np.concatenate([s_pos, l_pos[::-1]]), np.concatenate([s_com, down])
        before = np.maximum(all_pos - 1, 0)
        src = np.flatnonzero((all_pos > 0) & (text[before] < c))
        if len(src):
            push_groups(queue, text[before[src]], before[src], src, keep(all_com), first, depth)
        up = np.append(all_com[1:], np.int32(0))[::-1]
        out.append((all_pos[::-1], up))
    queue.close()
    return tuple(np.concatenate(x) for x in zip(*reversed(out), strict=True))
