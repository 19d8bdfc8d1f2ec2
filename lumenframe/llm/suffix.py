"""Suffix order and common prefixes of one shard by external induced sorting: queues of tuples and all arrays on disk.

Positions are split at the S* positions (an ascent after a descent). The tuple of a suffix is its characters up to the
next S* position, inclusive, and the rank of the suffix there; sorting the tuples induces the order of all suffixes
from that of the S* suffixes. Those are ordered by recursion on the string of the names of their first parts, which is
at most half as long. Common prefixes come along: tuples carry their first characters through the queue, and where those
are equal, the prefix goes on over the rest of the part and then over the common prefixes of the S* suffixes, by range
minima, up to a limit.

Whatever is longer than Scratch.limit entries lies in files that only the running task uses, and is gone through in
slices of that length; work arrays in memory are some slices. A lost task starts again from its input.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

#: Entries that a shard holds in memory at once.
IN_MEMORY = 1 << 20


class Scratch:
    """Arrays in memory, or in unlinked files once they are longer than ``limit``; files: how many were made."""

    def __init__(self, limit: int = IN_MEMORY):
        self.limit, self.files = limit, 0

    def array(self, n: int, dtype=np.int64, on_disk: bool = False) -> np.ndarray:
        """Zeros. on_disk: one of several that together may be long."""
        if n == 0 or n <= self.limit and not on_disk:
            return np.zeros(n, dtype)
        self.files += 1
        fd, path = tempfile.mkstemp(prefix="suffix-")
        try:
            os.truncate(fd, n * np.dtype(dtype).itemsize)
            return np.memmap(path, dtype=dtype, mode="r+", shape=(n,))
        finally:
            os.close(fd)
            os.unlink(path)

    def slices(self, n: int) -> Iterator[tuple[int, int]]:
        for a in range(0, n, self.limit):
            yield a, min(n, a + self.limit)


class TupleQueue:
    """A priority queue of tuples of integers, by their first two: sorted runs on disk, popped in order, a slice at a time.

    ordered: equal tuples keep the order in which they were pushed; sorting is faster where that doesn't matter.
    """

    def __init__(self, scratch: Scratch, ordered: bool = True):
        self.scratch, self.kind, self.held, self.n_held, self.runs = scratch, "stable" if ordered else None, [], 0, []

    def push(self, *columns: np.ndarray) -> None:
        if not len(columns[0]):
            return
        self.held.append([np.asarray(c, np.int64) for c in columns])
        self.n_held += len(columns[0])
        if self.n_held >= self.scratch.limit:
            self._write()

    def _sorted(self, columns: list[np.ndarray]) -> list[np.ndarray]:
        first, second = columns[:2]
        by = np.lexsort((second, first)) if second.any() else np.argsort(first, kind=self.kind)
        return [c[by] for c in columns]

    def _write(self) -> None:
        run = []
        for c in self._sorted([np.concatenate(c) for c in zip(*self.held)]):
            own = self.scratch.array(len(c), on_disk=True)
            own[:] = c
            run.append(own)
        self.runs.append(run)
        self.held, self.n_held = [], 0

    @staticmethod
    def _place(run: list[np.ndarray], mark: tuple[int, int], side: str) -> int:
        """Where (a, b) belongs in a run, left or right of its equals."""
        lo, hi = (int(np.searchsorted(run[0], mark[0], s)) for s in ("left", "right"))
        return lo + int(np.searchsorted(run[1][lo:hi], mark[1], side))

    def pop(self) -> Iterator[list[np.ndarray]]:
        """All tuples in order, as columns of slices; equal ones in the order in which they were pushed, if ordered."""
        if self.held:
            if not self.runs:  # never went to disk
                yield self._sorted([np.concatenate(c) for c in zip(*self.held)])
                return
            self._write()
        if len(self.runs) == 1:
            for a, b in self.scratch.slices(len(self.runs[0][0])):
                yield [np.asarray(c[a:b]) for c in self.runs[0]]
            return
        # between neighbours of these marks lies at most a slice, but for those that equal a mark
        step = max(1, self.scratch.limit // max(1, 2 * len(self.runs)))
        marks = sorted({(int(x), int(y)) for run in self.runs for x, y in zip(run[0][::step], run[1][::step])})
        at = [0] * len(self.runs)
        for mark in [*marks, None]:
            upto = [len(run[0]) if mark is None else self._place(run, mark, "left") for run in self.runs]
            some = [[np.asarray(c[a:b]) for c in run] for run, a, b in zip(self.runs, at, upto) if b > a]
            if some:
                yield self._sorted([np.concatenate(c) for c in zip(*some)])
            at = upto
            if mark is None:
                return
            for i, run in enumerate(self.runs):
                end = self._place(run, mark, "right")
                for a, b in self.scratch.slices(end - at[i]):
                    yield [np.asarray(c[at[i] + a : at[i] + b]) for c in run]
                at[i] = end


def _starts(batches: Iterator[list[np.ndarray]]) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """Sorted slices with, for each tuple, the place of the first tuple of equal keys, and its own place."""
    done, last, lead = 0, None, 0
    for columns in batches:
        first, second = columns[:2]
        n = len(first)
        new = np.ones(n, dtype=bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        new[0] = last is None or last != (int(first[0]), int(second[0]))
        own = done + np.arange(n)
        start = np.maximum.accumulate(np.where(new, own, lead))
        yield columns, start, own
        done, last, lead = done + n, (int(first[-1]), int(second[-1])), int(start[-1])


class _Parts:
    """For each position, the characters up to the next S* position, in words of several characters, and their name.

    Names are in the order of the parts: the place of the first equal part among all. A part that ends where another
    goes on comes after it.
    """

    def __init__(self, t: np.ndarray, stars: np.ndarray, scratch: Scratch):
        self.t, self.stars, self.scratch, n = t, stars, scratch, len(t)
        top = max((int(t[a:b].max()) for a, b in scratch.slices(n)), default=0)
        self.bits = (top + 3).bit_length()
        self.q = max(1, 62 // self.bits)
        self.full = (1 << (self.bits * self.q)) - 1
        self.word, self.end = scratch.array(n + 1), scratch.array(n + 1)  # one more: the end alone
        pad = (1 << self.bits) - 1
        for a, b in scratch.slices(n + 1):
            chars = np.zeros(b - a + self.q, np.int64)
            inner = np.asarray(t[a : min(n, b + self.q)]) + 1
            chars[: len(inner)] = inner
            at, end, own = np.arange(a, b), self.ends(a, b)[1], np.zeros(b - a, np.int64)
            self.end[a:b] = end
            for j in range(self.q):
                own <<= self.bits
                own |= np.where(at + j <= end, chars[j : j + b - a], pad)
            self.word[a:b] = own
        self._name()

    def ends(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the positions a .. b: the number of the next S* position, and where it is (the end where there is none)."""
        index = self._next_star(a, b)
        return index, np.append(np.asarray(self.stars[index[0] : index[-1] + 1]), len(self.t))[index - index[0]] if b > a else index

    def _next_star(self, a: int, b: int) -> np.ndarray:
        lo, hi = (int(x) for x in np.searchsorted(self.stars, (a, b)))
        met = np.zeros(b - a, np.int64)
        met[np.asarray(self.stars[lo:hi]) - a] = 1
        return lo + np.cumsum(met)

    def end_of(self, at: np.ndarray) -> np.ndarray:
        return np.asarray(self.end[at])

    def _name(self) -> None:
        n, scratch = len(self.t), self.scratch
        self.name, tied = scratch.array(n), scratch.array(n, np.uint8)
        queue = TupleQueue(scratch, ordered=False)
        for a, b in scratch.slices(n):
            queue.push(self.word[a:b], np.zeros(b - a, np.int64), np.arange(a, b))
        self._take(queue, tied, lambda start, columns: start)
        # parts longer than a word: names are refined by further words, among parts that share all before
        members, k = None, 1
        longer = scratch.array(n, np.uint8)
        while True:
            queue, found = TupleQueue(scratch, ordered=False), 0
            for at in self._pieces(members, n):
                at = at[np.asarray(tied[at]) > 0]
                more = self.end_of(at) - at + 1 > k * self.q
                longer[self.name[at[more]]] = 1
                found += int(more.sum())
            if not found:
                return
            kept = []
            for at in self._pieces(members, n):
                at = at[np.asarray(tied[at]) > 0]
                at = at[np.asarray(longer[self.name[at]]) > 0]
                word = np.full(len(at), self.full)
                more = self.end_of(at) - at + 1 > k * self.q
                word[more] = self.word[at[more] + k * self.q]
                queue.push(self.name[at], word, at)
                own = scratch.array(len(at), on_disk=n > scratch.limit)
                own[:] = at
                kept.append(own)
            for at in kept:
                longer[self.name[at]] = 0
                tied[at] = 0
            self._take(queue, tied, None)
            members, k = kept, k + 1

    def _pieces(self, members: list[np.ndarray] | None, n: int) -> Iterator[np.ndarray]:
        if members is None:
            for a, b in self.scratch.slices(n):
                yield np.arange(a, b)
        else:
            yield from map(np.asarray, members)

    def _take(self, queue: TupleQueue, tied: np.ndarray, first) -> None:
        """Names from sorted tuples (name or nothing yet, word, position): by place among all, or within the old name."""
        base = (None, 0)  # an old name, and the place of its first tuple
        for columns, start, own in _starts(queue.pop()):
            at = columns[2]
            if first:
                self.name[at] = start
            else:
                old = columns[0]
                new = np.ones(len(old), dtype=bool)
                new[1:] = old[1:] != old[:-1]
                new[0] = base[0] is None or base[0] != int(old[0])
                lead = np.maximum.accumulate(np.where(new, own, base[1]))
                base = (int(old[-1]), int(lead[-1]))
                self.name[at] = old + start - lead
            same = start != own
            tied[at[same]] = 1
            tied[at[np.flatnonzero(same[1:])]] = 1
            if len(at) and same[0] and own[0]:
                tied[self._last] = 1
            self._last = int(at[-1])

    def common(self, a: np.ndarray, b: np.ndarray, limit: int, words: tuple | None = None) -> np.ndarray:
        """Leading characters that the suffixes at a and b, whose first parts differ, share, up to limit; words: their first ones."""
        n, out = len(self.t), np.zeros(len(a), np.int64)
        left, k = np.arange(len(a)), 0
        while len(left) and k < limit:
            x, y = a[left] + k, b[left] + k
            ok = (x <= n) & (y <= n)
            left, x, y = left[ok], x[ok], y[ok]
            diff = (words[0] ^ words[1])[ok] if words and not k else self.word[x] ^ self.word[y]
            width = np.zeros(len(diff), np.int64)
            some = diff > 0
            width[some] = np.frexp(diff[some].astype(np.float64))[1]
            # frexp rounds: a difference just under a power of two may seem a bit wider
            over = some & (width > 0) & ((diff >> np.maximum(width - 1, 0)) == 0)
            width[over] -= 1
            out[left] += self.q - -(-width // self.bits)
            left = left[~some]
            k += self.q
        # a part may end where the other goes on: then one run of equal characters can be longer than the part
        left = np.arange(len(a))
        while len(left):
            x, y = a[left] + out[left], b[left] + out[left]
            ok = (x < n) & (y < n) & (out[left] < limit)
            left = left[ok]
            left = left[np.asarray(self.t[x[ok]]) == np.asarray(self.t[y[ok]])]
            out[left] += 1
        return np.minimum(out, limit)


def _range_minimum(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, table: "_Table") -> np.ndarray:
    """Minima of values[lo:hi], hi > lo."""
    out = np.empty(len(lo), np.int64)
    level = (np.frexp((hi - lo).astype(np.float64))[1] - 1).astype(np.int64)
    for k in np.unique(level).tolist():
        at, row = np.flatnonzero(level == k), table.row(k)
        out[at] = np.minimum(row[lo[at]], row[hi[at] - (1 << k)])
    return out


class _Table:
    """Minima of runs of 1, 2, 4 ... values, made when they are first asked for."""

    def __init__(self, values: np.ndarray, scratch: Scratch):
        self.rows, self.scratch = [values], scratch

    def row(self, k: int) -> np.ndarray:
        while len(self.rows) <= k:
            last, half = self.rows[-1], 1 << (len(self.rows) - 1)
            n = len(last) - half
            own = self.scratch.array(n)
            for a, b in self.scratch.slices(n):
                own[a:b] = np.minimum(last[a:b], last[a + half : b + half])
            self.rows.append(own)
        return self.rows[k]


def _stars(t: np.ndarray, scratch: Scratch) -> np.ndarray:
    """The S* positions: smaller than the suffix after them (equal neighbours are of one type), after one that is not."""
    n = len(t)
    s_type, after, later = scratch.array(n, np.uint8), -1, 0
    for a, b in reversed(list(scratch.slices(n))):
        own = np.asarray(t[a:b])
        ascent = np.sign(np.diff(np.append(own, after)))
        known = np.flatnonzero(ascent)
        place = np.searchsorted(known, np.arange(b - a))
        up = np.full(b - a, later, np.uint8)
        some = place < len(known)
        up[some] = ascent[known[place[some]]] > 0
        s_type[a:b] = up
        after, later = int(own[0]), int(up[0])
    count = lambda a, b: a + 1 + np.flatnonzero((np.asarray(s_type[a + 1 : b + 1]) > 0) & (np.asarray(s_type[a : min(b, n - 1)]) == 0))
    m = sum(len(count(a, b)) for a, b in scratch.slices(n))
    out, at = scratch.array(m), 0
    for a, b in scratch.slices(n):
        own = count(a, b)
        out[at : at + len(own)] = own
        at += len(own)
    return out


def suffix_order(t: np.ndarray, limit: int, scratch: Scratch | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): positions of ``t`` (integers >= 0) in the order of their suffixes, and how many characters each
    shares with the one before it, up to ``limit``. The end is smaller than any character."""
    scratch = scratch or Scratch()
    n = len(t)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    stars = _stars(t, scratch)
    parts, m = _Parts(t, stars, scratch), len(stars)
    rank, shared = scratch.array(m + 1), scratch.array(m + 1)  # of S* suffixes (the end's is 0); shared with the one before
    if m:
        _induce(parts, limit, rank, shared)
    queue = TupleQueue(scratch, ordered=False)
    for a, b in scratch.slices(n):
        queue.push(parts.name[a:b] * (m + 1) + rank[parts.ends(a, b)[0]], np.zeros(b - a, np.int64), np.arange(a, b), parts.word[a:b])
    order, common, done, table = scratch.array(n), scratch.array(n), 0, _Table(shared, scratch)
    last = None
    for key, _, at, word in queue.pop():
        if last:
            key, at, word = (np.append(x, y) for x, y in zip(last, (key, at, word)))
        last = (key[-1], at[-1], word[-1])
        one, two = key[:-1] // (m + 1), key[1:] // (m + 1)
        out, equal = np.empty(len(one), np.int64), one == two
        differ = ~equal
        out[differ] = parts.common(at[:-1][differ], at[1:][differ], limit, (word[:-1][differ], word[1:][differ]))
        if equal.any():
            a = at[:-1][equal]
            lo, hi = key[:-1][equal] % (m + 1), key[1:][equal] % (m + 1)
            out[equal] = np.minimum(parts.end_of(a) - a + _range_minimum(shared, lo + 1, hi + 1, table), limit)
        if done == 0:
            order[0], done = at[0], 1
        order[done : done + len(out)], common[done : done + len(out)] = at[1:], out
        done += len(out)
    return order, common


def _induce(parts: _Parts, limit: int, rank: np.ndarray, shared: np.ndarray) -> None:
    """Ranks and common prefixes of the S* suffixes, from the order of the string of their parts' names."""
    t, stars, scratch = parts.t, parts.stars, parts.scratch
    n, m = len(t), len(stars)
    names, queue, kinds = scratch.array(m), TupleQueue(scratch, ordered=False), 0
    for a, b in scratch.slices(m):
        queue.push(parts.name[np.asarray(stars[a:b])], np.zeros(b - a, np.int64), np.arange(a, b))
    for columns, start, own in _starts(queue.pop()):
        new = start == own
        names[columns[2]] = kinds - 1 + np.cumsum(new)
        kinds += int(new.sum())
    if kinds < m:
        order, common = suffix_order(names, limit, scratch)
    else:
        order, common = scratch.array(m), scratch.array(m)
        for a, b in scratch.slices(m):
            order[np.asarray(names[a:b])] = np.arange(a, b)
    place = lambda i: np.where(i < m, stars[np.minimum(i, m - 1)], n)
    for a, b in scratch.slices(m):
        rank[np.asarray(order[a:b])] = np.arange(a + 1, b + 1)
        lo = max(a, 1)
        one, two, same = (np.asarray(x) for x in (order[lo - 1 : b - 1], order[lo:b], common[lo:b]))
        x, y = place(one + same), place(two + same)
        beyond, inside = x - place(one), (x < n) & (y < n)
        rest = np.zeros(len(one), np.int64)
        rest[inside] = parts.common(x[inside], y[inside], limit)
        shared[lo + 1 : b + 1] = np.minimum(beyond + rest, limit)
