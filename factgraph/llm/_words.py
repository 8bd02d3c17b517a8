"""Vectorised words, lines and hashes over whole Arrow text columns.

Words are maximal runs of bytes outside ``\\x20\\x09-\\x0D``.  In UTF-8 none of those bytes occurs
inside a multi-byte character, so cutting bytes equals cutting code points.  A text is never cut
short: blocks end at white space, so that a hash depends on its word alone.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once by one task; a longer text makes a longer chunk of its own.
CHUNK_BYTES = 3 << 20
#: The same where a chunk becomes many arrays with an entry a byte or word; they are smaller and stay in the caches.
SMALL_CHUNK_BYTES = 1 << 19
_BLOCK_BYTES = 1 << 20


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (a bijection for each salt)."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = np.arange(256)
IS_SPACE = (_BYTE == 32) | ((_BYTE >= 9) & (_BYTE <= 13))
LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)
_VALUE = mix(np.arange(256, dtype=np.uint64), 11)
_STEP = 0x2545F4914F6CDD1D
_BACK = pow(_STEP, -1, 2**64)
_tables: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept for the next call."""
    have = _tables.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        x = np.full(size, base, dtype=np.uint64)
        x[0] = 1
        have = _tables[base] = np.multiply.accumulate(x)
    return have[:n]


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same task, which at its end gives unused memory back: workers live on for other stages."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):
                pass  # another C library

    return inner


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets from 0; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(at):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each, one whole row at least."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


class Words:
    """All words of a chunk of texts.

    start, end: byte positions; doc: row of the chunk; first: index of each row's first word
    (with a last entry, the number of words); hash: 64 bits that depend on the word alone.
    """

    def __init__(self, column: pa.Array, lower: bool = False):
        data, self.offsets = utf8(column)
        self.data = LOWER[data] if lower else data
        inside = ~IS_SPACE[self.data] if len(data) else np.zeros(0, bool)
        begins = np.zeros(len(data) + 1, bool)
        begins[self.offsets] = True
        opens = inside.copy()
        opens[1:] &= ~inside[:-1] | begins[1:-1]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:] | begins[1:-1]
        self.inside = inside
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.count)), self.count)
        self.hash = span_hashes(self.data, self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sums of a per-word array by row."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.first[1:]] - total[self.first[:-1]]

    def per_doc_bytes(self, flags: np.ndarray) -> np.ndarray:
        """Sums of a per-byte array by row."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of n words inside one row, and the index of each one's first word."""
        if len(self) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.doc[: len(self) - n + 1] == self.doc[n - 1 :])
        return rolling(self.hash, n)[at], at


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of ascending, disjoint byte spans, in blocks of whole spans."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + _BLOCK_BYTES)))
        a, b = int(start[i]), int(end[j - 1])
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_VALUE[data[a:b]] * powers(_STEP, b - a), out=total[1:])
        s, e = start[i:j] - a, end[i:j] - a
        out[i:j] = mix((total[e] - total[s]) * powers(_BACK, b - a + 1)[s] + (e - s).astype(np.uint64))
        i = j
    return out


def rolling(h: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hashes of every n neighbours: a rolling polynomial modulo 2**64, then a finaliser."""
    step = (_STEP + 2 * salt) % 2**64
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(step, len(h)), out=total[1:])
    m = len(h) - n + 1
    return mix((total[n:] - total[:m]) * powers(pow(step, -1, 2**64), m), n + salt)


def twice(key: np.ndarray) -> np.ndarray:
    """True where a 64-bit key occurs two times or more.

    Counts in a table of low bits rule out most of the unique keys; the rest is sorted.
    """
    out = np.zeros(len(key), bool)
    if len(key) < 2:
        return out
    bits = max(8, int(len(key) * 4 - 1).bit_length())
    low = (key & np.uint64((1 << bits) - 1)).astype(np.int64)
    maybe = np.flatnonzero(np.bincount(low, minlength=1 << bits)[low] > 1)
    order = maybe[np.argsort(key[maybe], kind="stable")]
    same = key[order[1:]] == key[order[:-1]]
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def later(key: np.ndarray) -> np.ndarray:
    """True where a key has occurred at a smaller index."""
    out = np.zeros(len(key), bool)
    maybe = np.flatnonzero(twice(key))
    order = maybe[np.argsort(key[maybe], kind="stable")]
    out[order[1:][key[order[1:]] == key[order[:-1]]]] = True
    return out


def covered(flags: np.ndarray, at: np.ndarray, n: int, size: int) -> np.ndarray:
    """True for words inside a flagged run of n words; at: the runs' first words."""
    step = np.zeros(size + 1, np.int32)
    begin = at[flags]
    np.add.at(step, begin, 1) if len(begin) and (np.diff(begin) == 0).any() else step.__setitem__(begin, step[begin] + 1)
    step[:] += -np.bincount(begin + n, minlength=size + 1).astype(np.int32) if len(begin) else 0
    return np.cumsum(step[:-1]) > 0
