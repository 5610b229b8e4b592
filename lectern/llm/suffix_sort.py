"""External induced suffix sorting: suffix tuples and common prefixes pass through queues on disk."""

from __future__ import annotations

import tempfile
from collections import defaultdict, deque

import numpy as np

#: Array elements and queued tuples of one level that stay in memory; a level of so few names is sorted there.
MEMORY = 1 << 22
#: Suffixes that are taken from a queue at a time.
BLOCK = 1 << 16


class Disk:
    """Arrays and queued tuples of a task: in memory up to `memory` elements, else in unnamed temporary files.

    The files are the task's own and go with it; a task that is lost makes them anew.
    """

    def __init__(self, memory: int):
        self.memory, self.file = memory, None

    def array(self, n: int, kind) -> np.ndarray:
        if n <= self.memory:
            return np.empty(n, kind)
        with tempfile.TemporaryFile() as f:
            return np.memmap(f, kind, "w+", shape=(n,))

    def put(self, a: np.ndarray) -> tuple:
        """Writes a block; what is returned brings it back."""
        if self.file is None:
            self.file = tempfile.TemporaryFile()  # noqa: SIM115
        self.file.seek(0, 2)
        at = self.file.tell()
        self.file.write(a.tobytes())
        return at, a.dtype, len(a)

    def get(self, place: tuple) -> np.ndarray:
        self.file.seek(place[0])
        return np.frombuffer(self.file.read(place[1].itemsize * place[2]), place[1])

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class Queue:
    """Priority queue of suffix tuples (position, prefix shared with the one before) by first symbol and arrival.

    Induction hands over the suffixes of one first symbol in their order, so a symbol's tuples are first in,
    first out, and the queue is emptied symbol by symbol. What exceeds the memory goes to disk.
    """

    def __init__(self, disk: Disk):
        self.disk, self.waiting, self.held = disk, defaultdict(deque), 0

    def put(self, symbol: int, positions: np.ndarray, shared: np.ndarray) -> None:
        self.waiting[symbol].append((positions, shared))
        self.held += len(positions)
        if self.held > self.disk.memory:
            for blocks in self.waiting.values():
                for k, (p, s) in enumerate(blocks):
                    if isinstance(p, np.ndarray):
                        blocks[k] = self.disk.put(p), self.disk.put(s)
            self.held = 0

    def take(self, symbol: int):
        """The next tuples of a symbol, some BLOCK of them; None where none wait."""
        blocks, got, n = self.waiting.get(symbol), [], 0
        while blocks and n < BLOCK:
            p, s = blocks.popleft()
            if isinstance(p, tuple):
                p, s = self.disk.get(p), self.disk.get(s)
            else:
                self.held -= len(p)
            got.append((p, s))
            n += len(p)
        if not got:
            self.waiting.pop(symbol, None)
            return None
        return got[0] if len(got) == 1 else tuple(np.concatenate(x) for x in zip(*got, strict=True))


class Pass:
    """One scan of the suffixes in their order, in which each hands over the one before it to the queue.

    Two suffixes that follow each other in the queue of a symbol share one symbol more than the least that
    is shared between the two that handed them over, in the order of the scan. `least` keeps that for each
    symbol since its last tuple; -1 before its first, which shares nothing with what stands before.
    """

    def __init__(self, x: np.ndarray, symbols: int, disk: Disk, descending: bool, width: int):
        self.x, self.queue, self.descending, self.width = x, Queue(disk), descending, width
        self.least = np.full(symbols, -1, np.int32) if width else None

    def feed(self, symbol: int, positions: np.ndarray, shared: np.ndarray, same: bool) -> None:
        """`same`: whether a symbol equal to the suffix's first one before it belongs to the pass as well."""
        before = self.x[np.maximum(positions - 1, 0)]
        if self.descending:
            fits = before <= symbol if same else before < symbol
        else:
            fits = before >= symbol if same else before > symbol
        at = np.flatnonzero(fits & (positions > 0))
        if not len(at):
            if self.width:
                np.minimum(self.least, shared.min(), out=self.least)
            return
        target = before[at]
        order = np.argsort(target, kind="stable")
        at, target = at[order], target[order]
        cuts = np.r_[0, np.flatnonzero(target[1:] != target[:-1]) + 1, len(at)]
        if self.width:
            handed = self._shared(shared, at, target, cuts)
        else:
            handed = np.zeros(len(at), np.uint8)
        moved = positions[at] - 1
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            self.queue.put(int(target[s]), moved[s:e], handed[s:e])

    def _shared(self, shared, at, target, cuts):
        first, last = cuts[:-1], cuts[1:] - 1
        low = np.empty(len(at), np.int32)
        ends = np.stack([np.r_[0, at[:-1] + 1], at + 1], 1)
        ends[first, 0] = 0  # from the block's beginning; what was before is in `least`
        low[:] = np.minimum.reduceat(np.append(shared, self.width).astype(np.int32), ends.reshape(-1))[::2]
        groups = target[first]
        low[first] = np.minimum(low[first], self.least[groups])
        after = np.append(np.minimum.accumulate(shared[::-1])[::-1], self.width)
        np.minimum(self.least, shared.min(), out=self.least)
        self.least[groups] = after[at[last] + 1]
        return np.minimum(low + 1, self.width).astype(shared.dtype)


def shared_prefix(x: np.ndarray, a: int, b: int, width: int) -> int:
    """Symbols that two suffixes share, `width` at most."""
    n = min(width, len(x) - max(a, b))
    differ = np.flatnonzero(x[a : a + n] != x[b : b + n])
    return int(differ[0]) if len(differ) else n


def neighbours_share(x: np.ndarray, order: np.ndarray, width: int, kind) -> np.ndarray:
    """Symbols that each suffix of `order` shares with the one before it, `width` at most; 0 for the first."""
    out = np.zeros(len(order), kind)
    four = None
    if x.dtype.itemsize <= 2 and x.nbytes <= MEMORY * 4 and len(x) > 4:  # four symbols in a word, at every place
        wide = x.astype(np.uint64)
        four = wide[:-3] << np.uint64(48) | wide[1:-2] << np.uint64(32) | wide[2:-1] << np.uint64(16) | wide[3:]
    for k in range(1, len(order), BLOCK):
        a, b = order[k - 1 : k - 1 + BLOCK], order[k : k + BLOCK]
        a = a[: len(b)]
        live, n = np.arange(len(b)), 0
        if four is not None:
            last = np.full(len(b), -1)
            while len(live) and n + 4 <= width:
                live = live[np.maximum(a[live], b[live]) + n < len(four)]
                live = live[four[a[live] + n] == four[b[live] + n]]
                n += 4
                last[live] = n
            out[k : k + len(b)] = np.maximum(last, 0)
            live = np.arange(len(b))
            for _ in range(3):  # what is left of a word
                at = out[k : k + len(b)].astype(np.int64)
                live = live[(at[live] < width) & (np.maximum(a[live], b[live]) + at[live] < len(x))]
                live = live[x[a[live] + at[live]] == x[b[live] + at[live]]]
                out[k + live] += 1
            continue
        while len(live) and n < width:
            live = live[np.maximum(a[live], b[live]) + n < len(x)]
            live = live[x[a[live] + n] == x[b[live] + n]]
            n += 1
            out[k + live] = n
    return out


def small_types(x: np.ndarray, disk: Disk) -> np.ndarray:
    """True where a suffix is less than the next one (an end mark below all symbols follows)."""
    n = len(x)
    out = disk.array(n, bool)
    coming = False  # of the suffix behind the block; the last one is greater than the empty suffix
    for e in range(n, 0, -BLOCK):
        s = max(0, e - BLOCK)
        here = x[s : e + 1].astype(np.int64)
        step = np.sign(here[1:] - here[:-1])
        if e == n:
            step = np.r_[step, -1]
        step = np.r_[step, 1 if coming else -1]
        place = np.where(step != 0, np.arange(len(step)), len(step))
        place = np.minimum.accumulate(place[::-1])[::-1]
        out[s:e] = step[place[: e - s]] > 0
        coming = bool(out[s])
    return out


def induced(x: np.ndarray, seeds: np.ndarray, seed_shared: np.ndarray | None, disk: Disk, width: int):
    """All suffixes in the order that follows from that of the star suffixes, and what each shares with the one before.

    The ascending pass takes the greater suffixes from the stars and from each other, the descending pass the
    lesser ones from the greater. With `width` 0 shared prefixes are not kept.
    """
    n, kind = len(x), np.uint8 if width < 256 else np.int32
    symbols = np.unique(x)
    of_seed = x[seeds]
    cuts = zip(np.searchsorted(of_seed, symbols).tolist(), np.searchsorted(of_seed, symbols, "right").tolist(), strict=True)
    top = int(symbols[-1]) + 1

    def boundary(a, b):
        return shared_prefix(x, int(a), int(b), width) if width else 0

    up, ends, filled = Pass(x, top, disk, False, width), [0], 0
    large, large_shared = disk.array(n, np.int64), disk.array(n, kind)
    up.queue.put(int(x[n - 1]), np.array([n - 1]), np.zeros(1, kind))  # the empty suffix hands over the last one
    if width:
        up.least[int(x[n - 1])] = width
    for symbol, (s, e) in zip(symbols.tolist(), cuts, strict=True):
        while (block := up.queue.take(symbol)) is not None:
            p, shared = block
            large[filled : filled + len(p)], large_shared[filled : filled + len(p)] = p, shared
            filled += len(p)
            up.feed(symbol, p, shared, True)
        for k in range(s, e, BLOCK):
            p = seeds[k : min(e, k + BLOCK)]
            shared = seed_shared[k : k + len(p)].astype(kind) if width else np.zeros(len(p), kind)
            if k == s:
                shared[0] = boundary(large[filled - 1], p[0]) if filled > ends[-1] else 0
            up.feed(symbol, p, shared, False)
        ends.append(filled)

    down, filled = Pass(x, top, disk, True, width), 0
    out, out_shared = disk.array(n, np.int64), disk.array(n, kind)
    for k in range(len(symbols) - 1, -1, -1):
        symbol, began = int(symbols[k]), filled
        while (block := down.queue.take(symbol)) is not None:
            p, shared = block
            out[filled : filled + len(p)], out_shared[filled : filled + len(p)] = p, shared
            filled += len(p)
            down.feed(symbol, p, shared, True)
        for e in range(ends[k + 1], ends[k], -BLOCK):
            s = max(ends[k], e - BLOCK)
            p, shared = np.array(large[s:e][::-1]), np.zeros(e - s, kind)
            shared[1:] = large_shared[s + 1 : e][::-1]
            if e < ends[k + 1]:
                shared[0] = large_shared[e]
            elif filled > began:
                shared[0] = boundary(out[filled - 1], p[0])
            out[filled : filled + len(p)], out_shared[filled : filled + len(p)] = p, shared
            filled += len(p)
            down.feed(symbol, p, shared, False)
    order = out[::-1]
    if not width:
        return order, None
    behind = disk.array(n, kind)
    behind[0], behind[1:] = 0, out_shared[::-1][:-1]
    return order, behind


def same_stretches(x: np.ndarray, stars: np.ndarray, of: np.ndarray) -> np.ndarray:
    """For star numbers in the order of their stretches (up to the next star): whether each equals the one before."""
    out = np.zeros(len(of), bool)
    size = np.diff(np.r_[stars, len(x)])
    for k in range(1, len(of), BLOCK):
        a, b = of[k - 1 : k - 1 + BLOCK], of[k : k + BLOCK]
        a = a[: len(b)]
        live = np.flatnonzero((size[a] == size[b]) & (a != len(stars) - 1) & (b != len(stars) - 1))
        n = 0
        while len(live) > 64:
            live = live[x[stars[a[live]] + n] == x[stars[b[live]] + n]]
            n += 1
            done = size[a[live]] < n  # the next star's first symbol belongs to the stretch
            out[k + live[done]] = True
            live = live[~done]
        for i in live.tolist():
            p, q, m = stars[a[i]], stars[b[i]], size[a[i]] + 1
            out[k + i] = bool((x[p : p + m] == x[q : q + m]).all())
    return out


def sorted_stars(x: np.ndarray, stars: np.ndarray, disk: Disk, depth: int) -> np.ndarray:
    """The star suffixes in order, at least by their first `depth` symbols.

    Induction from the stars by their first symbols alone sorts the stretches between stars. Equal stretches
    get one name, and the order of the names' suffixes, found by recursion, is that of the stars.
    """
    if len(stars) < 2:
        return stars
    first = stars[np.argsort(x[stars], kind="stable")]
    order, _ = induced(x, first, None, disk, 0)
    is_star = disk.array(len(x), bool)
    is_star[:] = False
    is_star[stars] = True
    of = np.searchsorted(stars, np.concatenate([order[k : k + BLOCK][is_star[order[k : k + BLOCK]]] for k in range(0, len(order), BLOCK)]))
    names = np.cumsum(~same_stretches(x, stars, of))
    if names[-1] == len(stars):
        return stars[of]
    reduced = disk.array(len(stars), np.int64)
    reduced[of] = names
    # A stretch is two symbols or more, and its last one is the next one's first.
    order, _ = sorted_suffixes(reduced, depth // 2 + 1, disk.memory, False) if len(reduced) > disk.memory else (doubled(reduced, depth // 2 + 1), None)
    return stars[order]


def doubled(x: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in memory, in order at least by their first `depth` symbols: ranks of 1, 2, 4, ... symbols."""
    n, k = len(x), 1
    rank = np.unique(x, return_inverse=True)[1].astype(np.int64) + 1
    while True:
        order = np.argsort(rank)
        if k >= depth or rank[order[-1]] == n:
            return order
        key = rank * (n + 1)
        key[:-k] += rank[k:]
        order = np.argsort(key)
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[True, key[order][1:] != key[order][:-1]])
        k *= 2
        if k >= n:
            return order


def sorted_suffixes(x: np.ndarray, width: int, memory: int = MEMORY, with_shared: bool = True):
    """Start positions of the suffixes of `x` (whole numbers from 1) in ascending order of their first `width`
    symbols at least, and how many symbols, `width` at most, each shares with the one before it.

    Suffixes less than their successor and greater than their predecessor are the stars. They are sorted by
    recursion on the names of the stretches between them, and all others are induced from them. Arrays and
    queues of more than `memory` elements are on disk, so `x`, too, may be a file mapped into memory.
    """
    n = len(x)
    if n < 2:
        return np.arange(n), np.zeros(n, np.uint8)
    disk = Disk(memory)
    try:
        small = small_types(x, disk)
        stars = np.concatenate([s + np.flatnonzero(small[s : s + BLOCK] & ~np.r_[True if s == 0 else small[s - 1], small[s : s + BLOCK][:-1]]) for s in range(0, n, BLOCK)])
        del small
        stars = sorted_stars(x, stars, disk, width)
        if not with_shared:
            return induced(x, stars, None, disk, 0)
        kind = np.uint8 if width < 256 else np.int32
        return induced(x, stars, neighbours_share(x, stars, width, kind), disk, width)
    finally:
        disk.close()
