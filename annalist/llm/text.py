"""Whole-text tokenising in numpy: Arrow string columns are read as bytes, and words are hashed without Python strings.

Words are maximal runs of non-separator bytes inside one document. All tables below work on UTF-8 bytes; since
separators are ASCII, a multi-byte character is never split.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Text bytes handled at once (a longer document is handled alone); numpy temporaries are some 50 times that.
CHUNK = 1 << 20

_P = 0x9E3779B97F4A7C15 | 1
_Q = 0xD1342543DE82EF95
_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
KEEP_CASE = np.arange(256, dtype=np.uint8)
#: Separators of words ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (after lower-casing).
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

_powers: dict[str, np.ndarray] = {}


def release() -> None:
    """Give a finished task's memory back: Python workers live on, and the C library would keep what arrays have freed."""
    for kind in [k for k, x in _powers.items() if len(x) > CHUNK + (1 << 16)]:  # as grown for a long document
        del _powers[kind]
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def _power(kind: str, n: int) -> np.ndarray:
    base = _P if kind == "up" else pow(_P, -1, 2**64)
    if kind not in _powers or len(_powers[kind]) < n:
        size = max(n, CHUNK + (1 << 16))
        run = np.full(size, base, U64)
        run[0] = 1
        _powers[kind] = np.multiply.accumulate(run)
    return _powers[kind][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit affects every output bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Rolling:
    """Hashes of any byte ranges of one buffer after one running sum."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sum = np.zeros(n + 1, U64)
        np.cumsum(_BYTE[data] * _power("up", n), out=self.sum[1:])
        self.inverse = _power("down", n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sum[end] - self.sum[start]) * self.inverse[start] + (end - start).astype(U64) * U64(_Q))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and where each value starts (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of whole rows with about ``size`` text bytes: (rows, bytes, starts)."""
    for batch in batches:
        data, offsets = raw(batch.column(column))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
            yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j


@dataclass
class Words:
    hash: np.ndarray  # of each word
    first: np.ndarray  # index of each document's first word, and the count of all at the end
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # byte after each word

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE, fold: np.ndarray = LOWER) -> Words:
    n = len(data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return Words(np.zeros(0, U64), np.zeros(len(offsets), np.int64), empty, empty)
    low = fold[data]
    gap = separators[low]
    begin, last = ~gap, ~gap
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    edge = np.zeros(n, bool)
    edge[inner] = True
    begin[1:] &= gap[:-1] | edge[1:]
    last[:-1] &= gap[1:] | edge[1:]
    start, end = np.flatnonzero(begin), np.flatnonzero(last) + 1
    return Words(Rolling(low)(start, end), np.searchsorted(start, offsets), start, end)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words (across documents too; see ``inside``)."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, U64)
    for j in range(k):
        out *= U64(_Q)
        out += hashes[j : j + n]
    return mix64(out + U64(k))


def inside(doc: np.ndarray, k: int) -> np.ndarray:
    """Which k-grams lie in one document."""
    n = max(0, len(doc) - k + 1)
    return doc[:n] == doc[k - 1 : k - 1 + n]


def distinct(x: np.ndarray) -> np.ndarray:
    """Distinct values, ascending; by a sort, which is many times faster than the hash table of ``np.unique``."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]][: len(x)]]


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    if len(values) < w:
        return values[:0]
    out, done = values, 1
    while done * 2 <= w:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    return np.minimum(out[: len(out) - (w - done)], out[w - done :]) if w > done else out


def sliding_max(values: np.ndarray, w: int) -> np.ndarray:
    return ~sliding_min(~values, w)


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions of all ranges, one after the other."""
    return np.repeat(start - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(int(size.sum())) if len(size) else np.zeros(0, np.int64)


def member(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of x are among the ascending keys."""
    if not len(keys):
        return np.zeros(len(x), bool)
    at = np.searchsorted(keys, x)
    at[at == len(keys)] = 0
    return keys[at] == x
