"""Words and hashes of whole Arrow text columns, vectorised with numpy.

Everything works on slices of a batch that hold about a quarter of a megabyte of text (or one longer text), so that the
memory of a task doesn't depend on the size of its partition. Rolling sums are taken piece by piece, as a long text's take
eight bytes or more for each of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18
#: Bytes, or windows, whose sums are held at a time.
PIECE = 1 << 16
#: An odd number and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base, and of its inverse."""
    size = 1 << max(10, int(n - 1).bit_length())
    if size not in _powers:
        both = []
        for base in (_BASE, _BASE_INV):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        if size > 4 * SLICE_BYTES:
            return both[0], both[1]
        _powers[size] = (both[0], both[1])
    return _powers[size]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, offsets into them) for runs of rows; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    rows = len(column)
    if not rows:
        return
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + rows + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


class Words:
    """The words of a slice: byte spans, document index, and where each document's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES, lower: bool = False):
        n = len(data)
        self.data, self.offsets = data, offsets
        word = ~separators[data]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        begins = word.copy()
        begins[1:] &= ~word[:-1] | first[1:n]
        ends = word.copy()
        ends[:-1] &= ~word[1:] | first[1:n]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.counts)
        self._lower = lower

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """One 64-bit hash for each word."""
        if not len(self):
            return np.zeros(0, np.uint64)
        out = np.empty(len(self), np.uint64)
        lo = 0
        while lo < len(out):
            base = self.starts[lo]
            hi = max(lo + 1, int(np.searchsorted(self.ends, base + PIECE, "right")))
            starts, ends = self.starts[lo:hi] - base, self.ends[lo:hi] - base
            data = self.data[base : base + ends[-1]]
            up, down = powers(len(data) + 1)
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_BYTE[LOWER[data] if self._lower else data] * up[: len(data)], out=total[1:])
            out[lo:hi] = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
            lo = hi
        return out


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of so many consecutive words, whatever document they are in."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for lo in range(0, n, PIECE):
        part = hashes[lo : lo + PIECE + width - 1]
        up, down = powers(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=total[1:])
        out[lo : lo + PIECE] = mix((total[width:] - total[:-width]) * down[: len(part) - width + 1] + np.uint64(width))
    return out


def whole(doc: np.ndarray, width: int) -> np.ndarray:
    """Which of those runs lie within one document."""
    n = max(0, len(doc) - width + 1)
    return doc[:n] == doc[width - 1 :] if n else np.zeros(0, bool)


def binaries(parts: list) -> pa.Array:
    return pa.array([bytes(x) for x in parts], pa.binary())
