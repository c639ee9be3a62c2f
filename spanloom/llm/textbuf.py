"""Vectorised byte-level text handling over Arrow string buffers: words, their hashes, byte grams.

All functions take the bytes of many texts in one array with offsets, so the cost a byte is that of a
few numpy passes. Memory is bounded by `slices` (a few MB of text at a time, or one longer text)."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Buffers go back to the system once they are free: a worker serves one stage after another, and should hold no more than the one at hand.
pa.set_memory_pool(pa.system_memory_pool())

_malloc_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's

U64 = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Everything in ASCII but digits and letters (after lower-casing).
NONWORD = np.zeros(256, bool)
NONWORD[0:0x30] = NONWORD[0x3A:0x61] = NONWORD[0x7B:0x80] = True
SLICE_BYTES = 2 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, U64), np.ones(1, U64)]


def buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)), off


def trim() -> None:
    """Hand back what the C library keeps of freed memory, of this kernel and of those before it in the process."""
    if _malloc_trim:
        _malloc_trim(0)


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run`, a kernel over batches, after which its idle worker holds no freed memory beside the executor's next stages."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            trim()

    return whole


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def strings(column: pa.Array, step: int = 128) -> Iterator[str | None]:
    """The texts of a column, of which few at a time are Python strings."""
    for a in range(0, len(column), step):
        yield from column.slice(a, step).to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers. (np.unique without counts builds a hash table, which costs ten times as much.)"""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES // 2 + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            out = np.full(size, base, U64)
            out[0] = 1
            _powers[k] = np.cumprod(out, dtype=U64)
    return _powers[0][:n], _powers[1][:n]


class Words:
    """Words of texts i..j: byte starts and ends within `low`, 64-bit hashes, and words for each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, i: int, j: int, separators: np.ndarray):
        first = offsets[i]
        bounds = offsets[i : j + 1] - first
        self.low = LOWER[data[first : offsets[j]]]
        inside = ~separators[self.low]
        head, last = inside.copy(), inside.copy()
        head[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        begin, end = bounds[:-1][bounds[:-1] < len(inside)], bounds[1:][bounds[1:] > 0]
        head[begin] = inside[begin]
        last[end - 1] = inside[end - 1]
        self.starts, self.ends = np.flatnonzero(head), np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.starts, bounds)  # of each text's words, and the end
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        n = len(self.low)
        up, down = powers(n + 1)
        total = np.zeros(n + 1, U64)
        np.cumsum((self.low.astype(U64) + U64(1)) * up[:n], dtype=U64, out=total[1:])
        return mix((total[self.ends] - total[self.starts]) * down[self.starts])


def grams(low: np.ndarray, bounds: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of every text and an end mark 0xFF after it: the byte in the lowest eight bits, the
    `depth` bytes before it above (nearest lowest; 0xFF before the text). Also how many each text has."""
    sizes = np.diff(bounds)
    texts = len(sizes)
    out = np.full(len(low) + (depth + 1) * texts, 0xFF, np.uint8)
    at = np.repeat(depth * np.arange(1, texts + 1) + np.arange(texts), sizes) + np.arange(len(low))
    out[at] = low
    wide = out.astype(U64)
    key = wide.copy()
    for i in range(1, depth + 1):
        key[i:] |= wide[:-i] << U64(8 * i)
    keep = np.ones(len(out), bool)
    starts = np.concatenate([[0], np.cumsum(sizes + depth + 1)[:-1]]) if texts else np.zeros(0, np.int64)
    keep[(starts[:, None] + np.arange(depth)[None]).ravel().astype(np.int64)] = False
    return key[keep], sizes + 1
