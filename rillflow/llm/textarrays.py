"""Vectorised text kernels shared by the operators: UTF-8 bytes of many texts in one flat array.

A *slab* holds the bytes of several whole texts back to back.  Kernels work on a
slab at a time, so their memory is bounded by the slab size (``SLAB_BYTES``) or by
the longest single text, never by the Arrow batch.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLAB_BYTES = 512 << 10

_WORD_BASE = np.uint64(0x9E3779B97F4A7C15)
_ROLL_BASE = 0xD1342543DE82EF95
_MASK = (1 << 64) - 1


def _byte_codes() -> np.ndarray:
    """A fixed 64-bit code for every byte value (splitmix of the value)."""
    return mix64(np.arange(1, 257, dtype=np.uint64) * _WORD_BASE)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising mix of 64-bit integers (murmur-style avalanche)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


BYTE_CODE = _byte_codes()

#: Word separators of the text operators: space and \x09-\x0D.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Separators that also cut off ASCII punctuation.
IS_SPACE_OR_MARK = IS_SPACE.copy()
IS_SPACE_OR_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Slab:
    """``data``: bytes of all texts; text ``i`` is ``data[start[i]:start[i + 1]]`` and row ``first + i``."""

    data: np.ndarray
    start: np.ndarray
    first: int

    @property
    def n(self) -> int:
        return len(self.start) - 1

    def owner(self, positions: np.ndarray) -> np.ndarray:
        """The text that each byte position lies in."""
        return np.searchsorted(self.start, positions, side="right") - 1


def give_back() -> None:
    """Returns freed memory to the system; workers are reused and would keep their largest batch's for good."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def as_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One contiguous large_string array (null texts stay null)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    return column.cast(pa.large_string())


def slabs(column: pa.Array | pa.ChunkedArray, limit: int = SLAB_BYTES) -> Iterator[Slab]:
    """Cuts a string column into slabs of about ``limit`` bytes of whole texts; null counts as empty."""
    array = as_array(column)
    if array.null_count:
        array = array.fill_null("")
    if not len(array):
        return
    _, offset_buffer, data_buffer = array.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer is not None else np.empty(0, np.uint8)
    i = 0
    while i < len(array):
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), len(array))
        yield Slab(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i)
        i = j
    give_back()


@dataclass
class Words:
    """Words of a slab in order: byte range and text number of each; ``first[i]:first[i + 1]`` are text i's."""

    begin: np.ndarray
    end: np.ndarray
    text: np.ndarray
    first: np.ndarray


def find_words(slab: Slab, separates: np.ndarray = IS_SPACE) -> Words:
    """Maximal runs of bytes that don't separate words, never across texts."""
    solid = np.zeros(len(slab.data) + 1, dtype=bool)
    np.logical_not(separates[slab.data], out=solid[:-1])
    opens = solid[:-1].copy()
    opens[1:] &= ~solid[:-2]
    heads = slab.start[:-1][slab.start[:-1] < len(slab.data)]
    opens[heads] = solid[heads]
    begin = np.flatnonzero(opens)
    closes = solid[:-1] & ~solid[1:]
    tails = slab.start[1:][slab.start[1:] > slab.start[:-1]] - 1
    closes[tails] = solid[tails]
    end = np.flatnonzero(closes) + 1
    first = np.searchsorted(begin, slab.start)
    text = np.repeat(np.arange(slab.n), np.diff(first))
    return Words(begin, end, text, first)


def hash_words(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range: a polynomial over byte codes, then a mix."""
    if not len(begin):
        return np.empty(0, np.uint64)
    n = len(data)
    _grow_powers(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * _powers[0][:n], out=prefix[1:])
    return mix64((prefix[end] - prefix[begin]) * _powers[1][begin] + (end - begin).astype(np.uint64))


#: Powers of the base of ``hash_words``, and their inverses.
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grow_powers(n: int) -> None:
    if len(_powers[0]) < n:
        n = max(n, SLAB_BYTES + 1)
        for k, base in enumerate((int(_WORD_BASE), pow(int(_WORD_BASE), -1, 1 << 64))):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)


class Rolling:
    """Hashes of any byte range of a slab in O(1): prefix sums of code * B^i, divided by B^start (mod 2^64)."""

    _power = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        self._grow(n + 1)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_CODE[data] * Rolling._power[:n], out=self.prefix[1:])

    @classmethod
    def _grow(cls, n: int) -> None:
        if len(cls._power) < n:
            n = max(n, SLAB_BYTES + 1)
            for name, base in (("_power", _ROLL_BASE), ("_inverse", pow(_ROLL_BASE, -1, 1 << 64))):
                x = np.full(n, base & _MASK, np.uint64)
                x[0] = 1
                setattr(cls, name, np.multiply.accumulate(x))

    def ranges(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Raw (unmixed) hash of data[begin:end]."""
        return (self.prefix[end] - self.prefix[begin]) * Rolling._inverse[begin]

    def windows(self, width: int) -> np.ndarray:
        """Raw hash of data[i:i + width] for each i."""
        n = len(self.prefix) - width
        if n <= 0:
            return np.empty(0, np.uint64)
        return (self.prefix[width:] - self.prefix[:-width]) * Rolling._inverse[:n]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i:i + width] for each i, by doubling."""
    if len(x) < width:
        return x[:0]
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x
