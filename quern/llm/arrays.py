"""Vectorised work on Arrow strings: bytes, words, rolling hashes, groups in sorted rows."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_pow: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    got = _pow.get(base)
    if got is None or len(got) < n:
        full = np.full(max(n, 1 << 16), base, U)
        full[0] = 1
        got = _pow[base] = np.multiply.accumulate(full)
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


class Prefix:
    """Hashes of any spans of a byte array, from one cumulative sum."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, U)
        np.cumsum((data.astype(U) + U(1)) * powers(_BASE, n), out=self.sums[1:])
        self.inv = powers(_INV, n + 1)

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Unmixed hashes of data[start:end]; spans of other lengths may collide, see mix."""
        return (self.sums[end] - self.sums[start]) * self.inv[start]

    def windows(self, k: int) -> np.ndarray:
        """Unmixed hashes of all k-byte windows."""
        n = len(self.sums) - 1
        return (self.sums[k:] - self.sums[: n + 1 - k]) * self.inv[: n + 1 - k]


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without copies; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if pa.types.is_null(column.type):
        column = column.cast(pa.binary())
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if offsets is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), off


def slices(column, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole rows of about limit bytes."""
    data, off = raw(column)
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words(data: np.ndarray, off: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs without bytes of `apart` (white space), and each row's place among them."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    space = apart[data]
    before = edge[:n].copy()
    before[1:] |= space[:-1]
    after = edge[1:].copy()
    after[:-1] |= space[1:]
    start, end = np.flatnonzero(before & ~space), np.flatnonzero(after & ~space) + 1
    return start, end, np.searchsorted(start, off)


def release() -> None:
    """Gives freed memory back, so that an idle worker holds little beside the next stage's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(run):
    """run, a function over Arrow batches, that gives memory back when a task ends."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return whole


def from_bytes(data: bytes | np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow string or binary array of joined bytes and the lengths of its values."""
    off = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=off[1:])
    return pa.Array.from_buffers(kind, len(lengths), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data) if isinstance(data, np.ndarray) else data)])


def labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the links i - j."""
    low = np.arange(n)
    while len(i):
        m = np.minimum(low[i], low[j])
        np.minimum.at(low, low[i], m)
        np.minimum.at(low, low[j], m)
        while True:
            nxt = low[low]
            if (nxt == low).all():
                break
            low = nxt
        keep = low[i] != low[j]
        i, j = i[keep], j[keep]
    return low


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole runs of rows with equal keys, in tables of one or more runs, from sorted batches.

    Memory holds a batch and the run that it ends in; callers bound the runs.
    """
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        same = np.ones(b.num_rows, bool)
        for k in keys:
            v = b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
            same &= v == v[-1]
        cut = b.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut == 0 and held and any(held[-1].column(held[-1].schema.get_field_index(k))[-1] != b.column(b.schema.get_field_index(k))[0] for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def runs(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where runs of equal keys begin in a sorted table, and its end."""
    change = np.zeros(table.num_rows, bool)
    change[:1] = True
    for k in keys:
        v = table.column(k).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(change), table.num_rows)
