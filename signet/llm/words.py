"""Words and shingles of whole texts as numpy arrays, straight from Arrow buffers.

A word's hash is a polynomial in its bytes, taken from running sums, so no Python object is made for a word.
Work goes over pieces of at most PIECE bytes that end between words, which bounds memory for any text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of a piece, whose arrays of 8 bytes each stay in a core's cache; of the texts of one batch.
PIECE, BATCH = 1 << 17, 1 << 21
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PI = np.uint64(pow(int(_P), -1, 1 << 64))
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SAME = np.arange(256, dtype=np.uint8)
LOWER = _SAME.copy()
LOWER[65:91] += 32


def mix64(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(30))
        h *= _C1
        h ^= h >> np.uint64(27)
        h *= _C2
        h ^= h >> np.uint64(31)
    return h


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i for i < n, kept for pieces of the usual length."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, PIECE + 1)
        out = []
        with np.errstate(over="ignore"):
            for base in (_P, _PI):
                row = np.full(size, base, np.uint64)
                row[0] = 1
                out.append(np.multiply.accumulate(row))
        _POWERS[:] = out
    return _POWERS[0][:n], _POWERS[1][:n]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null texts count as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    lo, hi = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(texts.buffers()[2], np.uint8, hi - lo, lo) if hi > lo else np.zeros(0, np.uint8)
    return data, offsets - lo


def spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): words as byte ranges that never cross texts; first[i] is the number of text i's first word."""
    gap = space[data]
    begin, end = np.ones(len(data) + 1, bool), np.ones(len(data) + 1, bool)
    begin[1:-1] = gap[:-1]
    begin[offsets] = True
    end[1:-1] = gap[1:]
    end[offsets] = True
    starts = np.flatnonzero(~gap & begin[:-1])
    ends = np.flatnonzero(~gap & end[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges, over pieces that end between them."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + PIECE, "right")))
        hi = int(ends[j - 1])
        power, inverse = _powers(hi - lo)
        with np.errstate(over="ignore"):
            total = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
            a, b = starts[i:j] - lo, ends[i:j] - lo
            out[i:j] = mix64((total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64))
        i = j
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    return _hashes(LOWER[data] if lower else data, starts, ends)


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n hashes (len(h) - n + 1 of them; none where fewer)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * _P + h[k : k + m]
    return mix64(out)


def trim() -> None:
    """Gives memory that arrays have left back to the machine: a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def trimmed(group):
    """A function of one group's table that trims when the group's arrays are gone."""

    def run(table: pa.Table) -> pa.Table:
        out = group(table)
        trim()
        return out

    return run


try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018  other C libraries lack it
except (OSError, AttributeError):
    _LIBC = None


def pieces(batches: Iterator[pa.RecordBatch], text: str, size: int = BATCH) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each holds about `size` bytes of text at most, or one text."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        lengths = np.asarray(pa.compute.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
        total, i = np.cumsum(lengths), 0
        while i < len(lengths):
            base = total[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(total, base + size, "right")))
            yield batch.slice(i, j - i)
            i = j
    trim()


import pyarrow.compute  # noqa: E402,F401  pa.compute is used above
