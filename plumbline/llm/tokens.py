"""Words and rolling hashes of whole Arrow string batches, in numpy over the UTF-8 bytes.

A word is a maximal run of bytes other than ASCII white space (blank, tab, line feed, vertical
tab, form feed, carriage return). Hashes are polynomials modulo 2**64 over random tables, read
off prefix sums, so that a batch costs a few passes over its bytes and no Python per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[list(b" \t\n\v\f\r")] = True
_RANDOM = np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.uint64)
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_powers: dict[int, np.ndarray] = {}
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def powers(base: int, n: int) -> np.ndarray:
    """``base**i`` modulo 2**64 for i < n; kept for later batches while small."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 1 << 23:
            _powers[base] = have
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n+1 offsets of its values; a null is an empty value."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows with at most ``most`` bytes of ``column`` each; one longer text is a run of its own."""
    _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
    start, n = 0, batch.num_rows
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end
    release()


def release() -> None:
    """Gives memory that allocators hold back to the system; a worker may wait for long before its next batch."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


class Words:
    """Word boundaries of a batch: ``begin`` and ``end`` in bytes, ``first`` word of each text (n+1)."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = text_bytes(column)
        solid = ~SPACE[self.data]
        n = len(solid)
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        begins = solid.copy()
        if n:
            begins[1:] &= ~solid[:-1] | edge[1:n]
        ends = solid.copy()
        if n:
            ends[:-1] &= ~solid[1:] | edge[1:n]
        self.begin, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.begin, self.offsets)

    def __len__(self) -> int:
        return len(self.begin)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, data: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each word; ``data`` replaces the bytes, such as by their lower case."""
        data = self.data if data is None else data
        return span_hashes(data, self.begin, self.end)


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each span's bytes; spans in ascending order. About ``most`` bytes are worked on at once."""
    if len(begin) and end[-1] - begin[0] > most:
        out, i = np.empty(len(begin), np.uint64), 0
        while i < len(begin):
            j = max(i + 1, int(np.searchsorted(end, begin[i] + most, "right")))
            low = begin[i]
            out[i:j] = span_hashes(data[low : end[j - 1]], begin[i:j] - low, end[i:j] - low, 1 << 62)
            i = j
        return out
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_RANDOM[data] * powers(_BYTE_BASE, n), out=sums[1:])
    h = (sums[end] - sums[begin]) * powers(inverse(_BYTE_BASE), n + 1)[begin]
    return mix(h + (end - begin).astype(np.uint64))


def rolling(values: np.ndarray, length: int) -> np.ndarray:
    """Rabin-Karp hashes of every run of ``length`` values, boundaries of texts ignored: ``len(values) - length + 1`` of them."""
    n = len(values)
    if n < length:
        return np.empty(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(_WORD_BASE, n), out=sums[1:])
    count = n - length + 1
    return mix((sums[length:] - sums[:count]) * powers(inverse(_WORD_BASE), count))


def window_starts(first: np.ndarray, length: int) -> np.ndarray:
    """Word indices at which a run of ``length`` words lies within one text."""
    counts = np.maximum(np.diff(first) - length + 1, 0)
    return ranges(first[:-1], counts)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenation of ``starts[i] + arange(counts[i])``."""
    total = int(counts.sum())
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(total)


def planes(x: np.ndarray, kind: type = np.uint32) -> bytes:
    """The bytes of ``x``, low ones first, so that small numbers compress to little."""
    return np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(len(x), -1).T).tobytes()


def unplanes(raw: bytes, kind: type = np.uint32) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()
