"""Vectorised byte, word and n-gram kernels over Arrow string columns (used inside Spark tasks)."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15 | 1)
STEP = U64(0xD6E8FEB86659FD93)

#: [^\x20\x09-\x0D]+
PLAIN_WORD = np.ones(256, dtype=bool)
PLAIN_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, of lower-cased text
ALNUM_WORD = np.ones(256, dtype=bool)
ALNUM_WORD[:0x30] = ALNUM_WORD[0x3A:0x61] = ALNUM_WORD[0x7B:0x80] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BYTE_CODE = mix(np.arange(1, 257, dtype=U64) * BASE)


@lru_cache(maxsize=4)
def _powers(bits: int, base: int) -> np.ndarray:
    p = np.full(1 << bits, U64(base), dtype=U64)
    p[0] = 1
    return np.multiply.accumulate(p)


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """base ** 0, 1, 2 ... modulo 2 ** 64, at least ``n`` of them."""
    return _powers(max(10, int(n).bit_length()), int(base))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows with some ``limit`` bytes of text: work arrays grow with a run, not with a batch."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64) + 8)
    at = 0
    while at < batch.num_rows:
        done = int(ends[at - 1]) if at else 0
        upto = max(int(np.searchsorted(ends, done + limit, side="right")), at + 1)
        yield batch.slice(at, upto - at)
        at = upto


@lru_cache(maxsize=1)
def _libc():
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.malloc_trim  # noqa: B018
        return libc
    except (OSError, AttributeError):
        return None


def release() -> None:
    """Gives freed memory back: Python workers live on between tasks, beside each other in one executor."""
    pa.default_memory_pool().release_unused()
    if _libc() is not None:
        _libc().malloc_trim(0)


def string_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    if n == 0 or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


class Words:
    """The words of a batch of texts.

    data: bytes (lower-cased on request); start, end: of each word in data; row: the text of each word;
    first: index of the first word of each text, with the total at its end; hash: 64 bits a word, if ``hashed``.
    """

    def __init__(self, column, alphabet: np.ndarray = PLAIN_WORD, lower: bool = False, hashed: bool = True):
        self.data, self.offsets = string_bytes(column)
        if lower:
            self.data = LOWER[self.data]
        rows = len(self.offsets) - 1
        inside = alphabet[self.data]
        n = len(inside)
        before = np.zeros(n, dtype=bool)
        before[1:] = inside[:-1]
        before[self.offsets[:-1][self.offsets[:-1] < n]] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.zeros(n, dtype=bool)
        after[:-1] = inside[1:]
        cuts = self.offsets[1:]
        after[cuts[cuts > 0] - 1] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.row = np.repeat(np.arange(rows, dtype=np.int32), np.diff(self.first))
        self.hash = self._hash(inside) if hashed else None

    def __len__(self) -> int:
        return len(self.start)

    def _hash(self, inside: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.start), dtype=U64)
        lens = self.end - self.start
        pw = powers(int(lens.max()) + 1) if len(lens) else None
        a, n = 0, len(lens)
        while a < n:  # a quarter of a megabyte at a time: the 64-bit work arrays stay small
            b = max(a + 1, int(np.searchsorted(self.start, self.start[a] + (1 << 18))))
            lo, hi = self.start[a], self.end[b - 1]
            chars = self.data[lo:hi][inside[lo:hi]]
            own = lens[a:b]
            at = np.zeros(b - a, dtype=np.int64)
            np.cumsum(own[:-1], out=at[1:])
            offset = np.arange(len(chars)) - np.repeat(at, own)
            terms = BYTE_CODE[chars]
            terms *= pw[offset]
            out[a:b] = np.add.reduceat(terms, at)
            a = b
        return mix(out ^ (lens.astype(U64) * STEP))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of ``n`` consecutive items of ``h`` (borders are the caller's business)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=U64)
    acc = h[:m].copy()
    for j in range(1, n):
        acc *= BASE
        acc += h[j : j + m]
    return mix(acc)


def within(group: np.ndarray, n: int) -> np.ndarray:
    """Whether the run of ``n`` items from each position stays in one group (group ids ascend)."""
    m = len(group) - n + 1
    return group[:m] == group[n - 1 :] if m > 0 else np.zeros(0, dtype=bool)


def cover(starts: np.ndarray, width: int, total: int) -> np.ndarray:
    """Mask of the ``total`` items that runs of ``width`` from ``starts`` cover."""
    begins = np.bincount(starts, minlength=total + 1)
    ends = np.bincount(np.minimum(starts + width, total), minlength=total + 1)
    return np.cumsum(begins - ends)[:total] > 0
