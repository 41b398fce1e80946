"""Vectorised text primitives: all work on the byte buffers of Arrow string columns.

Null text counts as empty everywhere. Positions are byte offsets into the slice's buffer unless a
function says otherwise.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Text that one numpy pass handles at a time; a longer single document is a slice of its own.
SLICE_BYTES = 1 << 20

WS = np.zeros(256, bool)
WS[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(0, 2**64, 256, dtype=U)
_X = U(0x9E3779B97F4A7C15)
_LEN = U(0xD6E8FEB86659FD93)
_XI = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_pow = [np.ones(1, U), np.ones(1, U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, n of each."""
    if len(_pow[0]) < n:
        m = -(-max(n, SLICE_BYTES + (1 << 16)) // (1 << 20)) << 20  # in steps, so that a slightly longer text finds them made
        for i, x in enumerate((_X, _XI)):
            p = np.full(m, x, U)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            _pow[i] = p
    return _pow[0][:n], _pow[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def buffers(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, ob, db = arr.buffers()
    if len(arr) == 0 or ob is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(ob, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(db, np.uint8) if db is not None and db.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES, max_rows: int = 60_000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) in slices of about `limit` bytes of text."""
    for b in batches:
        if not b.num_rows:
            continue
        col = b.column(b.schema.get_field_index(column))
        data, off = buffers(col)
        i = 0
        while i < b.num_rows:
            j = int(np.searchsorted(off, off[i] + limit, side="right")) - 1
            j = min(max(j, i + 1), b.num_rows, i + max_rows)
            yield b.slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j
    release()


def release() -> None:
    """Give freed memory back to the system: Python workers are reused and would else keep their peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # no glibc
        pass


def doc_of(off: np.ndarray) -> np.ndarray:
    """For each byte the row it belongs to."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


class Rolling:
    """Polynomial fingerprints modulo 2**64 over random byte values, any substring in O(1)."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        p, self.inv = _powers(n + 1)
        self.pre = np.zeros(n + 1, U)
        v = _TABLE[data]
        v *= p[:n]
        np.cumsum(v, out=self.pre[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = self.pre[end] - self.pre[start]
        h *= self.inv[start]
        return h

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = self.raw(start, end)
        h += (end - start).astype(U) * _LEN
        return mix(h)

    def windows(self, size: int) -> np.ndarray:
        """The same fingerprint for every window of `size` bytes, by its start."""
        n = len(self.pre) - 1
        if n < size:
            return np.zeros(0, U)
        h = self.pre[size:] - self.pre[: n - size + 1]
        h *= self.inv[: n - size + 1]
        h += U(size * int(_LEN) % 2**64)
        return mix(h)


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of True; none crosses a row's end."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[off] = True  # a row begins here (or the buffer ends)
    st = inside.copy()
    st[1:] &= ~inside[:-1] | first[1:n]
    en = inside.copy()
    en[:-1] &= ~inside[1:] | first[1:n]
    return np.flatnonzero(st), np.flatnonzero(en) + 1


def words(data: np.ndarray, off: np.ndarray, separator: np.ndarray = WS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word: maximal runs of bytes that are no separators."""
    st, en = runs(~separator[data], off)
    return st, en, np.searchsorted(off, st, side="right") - 1


def per_row(row: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Count (or sum of integer weights) for each of n rows."""
    if weights is None:
        return np.bincount(row, minlength=n)
    return np.bincount(row, weights=weights, minlength=n).astype(np.int64)


def code_points(data: np.ndarray) -> np.ndarray:
    """Prefix count of code points: code_points(d)[i] is how many begin before byte i."""
    c = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=c[1:])
    return c


def starts_of_groups(sorted_keys: np.ndarray) -> np.ndarray:
    """Index at which each run of equal keys begins."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))


def pack40(h: np.ndarray) -> bytes:
    """The low 40 bits of each, five bytes apiece."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def unpack40(b: bytes) -> np.ndarray:
    a = np.zeros((len(b) // 5, 8), np.uint8)
    a[:, :5] = np.frombuffer(b, np.uint8).reshape(-1, 5)
    return a.view("<u8").ravel()


def pack_n(h: np.ndarray, n: int) -> bytes:
    """The low n bytes of each."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()


def unpack_n(b: bytes, n: int) -> np.ndarray:
    a = np.zeros((len(b) // n, 8), np.uint8)
    a[:, :n] = np.frombuffer(b, np.uint8).reshape(-1, n)
    return a.view("<u8").ravel()


def pack_small(v: np.ndarray) -> bytes:
    """Numbers from 0, mostly below 255: a byte each, with a byte of 255 before for every 255 beyond."""
    q = v // 255
    out = np.full(len(v) + int(q.sum()), 255, np.uint8)
    out[np.cumsum(q + 1) - 1] = v % 255
    return out.tobytes()


def unpack_small(b: bytes) -> np.ndarray:
    a = np.frombuffer(b, np.uint8)
    return np.diff(np.cumsum(a, dtype=np.int64)[a != 255], prepend=0)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
