"""Suffix order by induced sorting outside memory: queues of suffix tuples that spill to disk, and common-prefix values."""

from __future__ import annotations

import tempfile

import numpy as np


class TupleQueue:
    """Priority queue of suffix tuples (position, common prefix) by first character, taken in bulk.

    Tuples of one character leave in the order in which they came, which induction makes their sorted order. Beyond
    limit bytes the tuples of all characters but the one in hand go to a temporary file and are read back when their
    turn comes.
    """

    def __init__(self, limit: int):
        self.limit, self.held, self.bytes, self.file = limit, {}, 0, None

    def push(self, chars: np.ndarray, places: np.ndarray, common: np.ndarray, keep: int) -> None:
        """chars must be sorted."""
        if not len(chars):
            return
        cut = np.flatnonzero(np.diff(chars)) + 1
        for c, p, l in zip(chars[np.concatenate([[0], cut])].tolist(), np.split(places, cut), np.split(common, cut), strict=True):
            self.held.setdefault(c, []).append((p, l))
        self.bytes += places.nbytes + common.nbytes
        if self.bytes > self.limit:
            self._spill(keep)

    def _spill(self, keep: int) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for c, chunks in self.held.items():
            for i, (p, l) in enumerate(chunks):
                if c != keep and not isinstance(p, int):
                    chunks[i] = (self.file.tell(), len(p))
                    self.file.write(p.tobytes() + l.tobytes())
        self.bytes = sum(p.nbytes + l.nbytes for p, l in self.held.get(keep, ()))

    def pop(self, c: int) -> tuple[np.ndarray, np.ndarray]:
        """All tuples now held for c, in order."""
        places, common = [np.zeros(0, np.int32)], [np.zeros(0, np.uint8)]
        for p, l in self.held.pop(c, ()):
            if isinstance(p, int):
                self.file.seek(p)
                p, l = np.frombuffer(self.file.read(4 * l), np.int32), np.frombuffer(self.file.read(l), np.uint8)
            else:
                self.bytes -= p.nbytes + l.nbytes
            places.append(p)
            common.append(l)
        return np.concatenate(places), np.concatenate(common)


def _types(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix is larger than the next one (the end counts as smallest), and how often its first character repeats."""
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])
    ends = np.append(change, n - 1)
    falls = np.append(text[change] > text[change + 1], True)
    sizes = np.diff(np.concatenate([[-1], ends]))
    return np.repeat(falls, sizes), np.repeat(ends, sizes) - np.arange(n) + 1


def _range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least of values[low..high] for each pair, both ends included."""
    width = high - low + 1
    level = np.frexp(width.astype(np.float64))[1] - 1
    out = np.empty(len(low), dtype=values.dtype)
    table, step = values, 1
    for k in range(int(level.max(initial=0)) + 1):
        here = np.flatnonzero(level == k)
        out[here] = np.minimum(table[low[here]], table[high[here] - step + 1])
        table = np.minimum(table[:-step], table[step:]) if len(table) > step else table
        step *= 2
    return out


def _dense(keys: np.ndarray) -> np.ndarray:
    """Rank of each key among the distinct ones."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    out = np.empty(len(keys), dtype=np.int64)
    out[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
    return out


def _sort_seeds(text: np.ndarray, seeds: np.ndarray, depth: int, limit: int, base: int) -> np.ndarray:
    """Order of the suffixes at seeds (those smaller than the next, after a larger one), right for depth characters.

    Each is named by the rank of its stretch up to and with the next seed; of two stretches of which one begins the
    other the shorter is larger. The names make up a text of their own, which is sorted by the same induction, or by
    doubling where it is no longer than base.
    """
    n, m = len(text), len(seeds)
    stop = np.append(seeds[1:] + 1, n + 1)
    padded = np.concatenate([text.astype(np.int64) + 1, np.zeros(1, np.int64)])
    wide = int(padded.max()).bit_length() + 1
    fit = max(1, 62 // wide)
    names = np.zeros(m, dtype=np.int64)
    open_, at = np.arange(m), 0
    while len(open_):
        key = np.zeros(len(open_), dtype=np.int64)
        for k in range(at, at + fit):
            place = seeds[open_] + k
            key = (key << wide) | np.where(place < stop[open_], padded[np.minimum(place, n)], (1 << wide) - 1)
        if at:
            order = np.lexsort((key, names[open_]))
            a, b = names[open_][order], key[order]
            first = np.concatenate([[True], a[1:] != a[:-1]])
            fresh = np.cumsum(first | np.concatenate([[True], b[1:] != b[:-1]]))
            base_of = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
            bump = np.zeros(m, dtype=np.int64)
            bump[open_[order]] = fresh - fresh[base_of]
            names = _dense(names * (m + 1) + bump)
        else:
            names = _dense(key)
        at += fit
        count = np.bincount(names, minlength=m)
        open_ = np.flatnonzero((count[names] > 1) & (stop - seeds >= at)) if at < depth else open_[:0]
    if m > base and names.max() + 1 < m:
        order, _ = induced_order(names, depth, limit, base, common=False)
        return order
    step, reach = 1, 2
    while names.max() + 1 < m and reach < 2 * depth:
        after = np.full(m, -1, dtype=np.int64)
        after[: max(m - step, 0)] = names[step:]
        names = _dense(names * (m + 1) + after + 1)
        step *= 2
        reach *= 2
    return np.argsort(names, kind="stable")


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, up to most."""
    n = len(text)
    out = np.zeros(len(a), dtype=np.uint8)
    live = np.arange(len(a))
    for k in range(most):
        live = live[(a[live] + k < n) & (b[live] + k < n)]
        live = live[text[a[live] + k] == text[b[live] + k]]
        if not len(live):
            break
        out[live] += 1
    return out


def induced_order(text: np.ndarray, depth: int, limit: int = 1 << 28, base: int = 1 << 22, common: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of text (non-negative integers) and each suffix's common prefix with the one before, up to depth.

    Suffixes are in order as far as their first depth characters tell (depth at most 200); those that agree on so many
    stand together in some order. Seeds are sorted first; larger-than-next suffixes are then induced in ascending, the
    others in descending order of what they precede. Every tuple that induction makes carries its common prefix with the
    tuple before it: one more than the least along the stretch of their sources. limit: bytes of tuples in memory;
    base: names that are sorted by doubling rather than by another round of induction.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    larger, run = _types(text)
    run = np.minimum(run, depth).astype(np.uint8)
    seed = ~larger
    seed[1:] &= larger[:-1]
    seed[0] = False
    seeds = np.flatnonzero(seed)
    seeds = seeds[_sort_seeds(text, seeds, depth, limit, base)] if len(seeds) else seeds
    seed_common = np.zeros(len(seeds), dtype=np.uint8)
    if common and len(seeds):
        seed_common[1:] = _common(text, seeds[:-1], seeds[1:], depth)
    seed_char = text[seeds]
    chars = np.unique(text)
    first_seed, last_seed = np.searchsorted(seed_char, chars), np.searchsorted(seed_char, chars, side="right")
    index = {c: i for i, c in enumerate(chars.tolist())}

    def induce(queue: TupleQueue, places: np.ndarray, shared: np.ndarray, pending: np.ndarray, c: int, want_larger: bool) -> None:
        """Queues the suffix before each source. pending: least common prefix since the last tuple of each character."""
        before = places - 1
        ok = np.flatnonzero(before >= 0)
        ok = ok[larger[before[ok]] == want_larger]
        before = before[ok]
        to = text[before]
        order = np.argsort(to, kind="stable")
        to, before, src = to[order], before[order], ok[order]
        if not common:
            queue.push(to, before.astype(np.int32), np.zeros(len(to), np.uint8), c)
            return
        whole = shared.min(initial=255)
        if not len(to):
            np.minimum(pending, whole, out=pending)
            return
        fresh = np.concatenate([[True], to[1:] != to[:-1]])
        low = np.where(fresh, 0, np.concatenate([[0], src[:-1] + 1]))
        least = _range_min(shared, low, src)
        slot = np.searchsorted(chars, to[fresh])
        least[fresh] = np.minimum(least[fresh], pending[slot])
        queue.push(to, before.astype(np.int32), np.minimum(least.astype(np.int16) + 1, depth).astype(np.uint8), c)
        last = src[np.append(np.flatnonzero(fresh)[1:] - 1, len(to) - 1)]
        np.minimum(pending, whole, out=pending)
        tail = last + 1 < len(shared)
        after = np.full(len(last), 255, dtype=np.uint8)
        after[tail] = _range_min(shared, last[tail] + 1, np.full(int(tail.sum()), len(shared) - 1))
        pending[slot] = after

    def rounds(queue: TupleQueue, c: int, pending: np.ndarray, want_larger: bool) -> tuple[np.ndarray, np.ndarray]:
        places, shared = [], []
        while c in queue.held:
            p, l = queue.pop(c)
            if not places:
                l = l.copy()
                l[0] = 0
            places.append(p.astype(np.int64))
            shared.append(l)
            induce(queue, places[-1], l, pending, c, want_larger)
        return (np.concatenate(places), np.concatenate(shared)) if places else (np.zeros(0, np.int64), np.zeros(0, np.uint8))

    queue = TupleQueue(limit)
    queue.push(text[-1:], np.array([n - 1], np.int32), np.zeros(1, np.uint8), -1)
    falling: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for c in chars.tolist():
        pending = np.zeros(len(chars), dtype=np.uint8)
        places, shared = falling[c] = rounds(queue, c, pending, True)
        i = index[c]
        if first_seed[i] < last_seed[i]:
            own = slice(first_seed[i], last_seed[i])
            link = seed_common[own].copy()
            link[0] = min(run[places[-1]], run[seeds[own][0]]) if len(places) else 0
            induce(queue, seeds[own], link, pending, c, True)
    queue = TupleQueue(limit)
    parts, commons = [], []
    for c in reversed(chars.tolist()):
        pending = np.zeros(len(chars), dtype=np.uint8)
        places, shared = rounds(queue, c, pending, False)
        low, low_shared = falling[c]
        seam = min(run[low[-1]], run[places[-1]]) if len(low) and len(places) else 0
        if len(low):
            down = np.append(low_shared[1:], np.uint8(0))[::-1].copy()
            down[0] = seam
            induce(queue, low[::-1], down, pending, c, False)
        up = np.append(shared[1:], np.uint8(0))[::-1].copy() if len(shared) else shared
        if len(up):
            up[0] = seam
        parts.append(np.concatenate([low, places[::-1]]))
        commons.append(np.concatenate([low_shared, up]))
    return np.concatenate(parts[::-1]), np.concatenate(commons[::-1])
