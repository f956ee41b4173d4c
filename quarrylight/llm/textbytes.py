"""Vectorised views of Arrow text columns.

A slice of rows is one ``uint8`` buffer plus row offsets.  Words are runs of digits, ASCII letters
and bytes above 0x7F, which on UTF-8 is exactly the class ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``
after lower-casing A-Z.  Null texts read as empty texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
HASH_BYTES = 1 << 19

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True

_rng = np.random.default_rng(20240229)
_BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BYTE_VALUE_LOWER = _BYTE_VALUE[LOWER]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: tuple[np.ndarray, np.ndarray] | None = None

try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim
except (OSError, AttributeError):  # not glibc
    _libc = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        up, down = np.full(size, _BASE), np.full(size, _BASE_INVERSE)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each byte span; equal bytes give equal hashes wherever they stand.

    Spans are in order; they are hashed HASH_BYTES at a time, which bounds the tables of powers.
    """
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(int(np.searchsorted(ends, base + HASH_BYTES, side="right")), at + 1)
        out[at:to] = _span_hashes(data[base : ends[to - 1]], starts[at:to] - base, ends[at:to] - base, lower)
        at = to
    return out


def _span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    up, down = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.multiply((_BYTE_VALUE_LOWER if lower else _BYTE_VALUE)[data], up[: len(data)], out=sums[1:])
    np.cumsum(sums, out=sums)
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64))


@dataclass
class TextSlice:
    """Rows ``first`` to ``first + len`` of a batch."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, row: int) -> str:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes().decode("utf-8", "replace")


def text_slices(column: pa.Array | pa.ChunkedArray, slice_bytes: int = SLICE_BYTES, rows: int = 1 << 20) -> Iterator[TextSlice]:
    """Cut a string column in slices of about ``slice_bytes`` and at most ``rows``; a longer text is a slice of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None and data_buffer.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offsets, offsets[at] + slice_bytes, side="right")) - 1
        to = min(max(to, at + 1), at + rows, len(column))
        yield TextSlice(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to
    give_back()


def give_back() -> None:
    """Return freed memory to the system: several workers share an executor's."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


@dataclass
class Words:
    """Byte spans of the words of a slice; row r has the words first[r] to first[r + 1]."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes, cut at row boundaries."""
    n = len(mask)
    begin, end = mask.copy(), mask.copy()
    begin[1:] &= ~mask[:-1]
    end[:-1] &= ~mask[1:]
    at = offsets[:-1][offsets[:-1] < n]
    begin[at] = mask[at]
    at = offsets[1:][offsets[1:] > 0] - 1
    end[at] = mask[at]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def find_words(piece: TextSlice) -> Words:
    starts, ends = runs(IS_WORD[piece.data], piece.offsets)
    return Words(starts, ends, np.searchsorted(starts, piece.offsets))


def word_hash(word: str) -> int:
    """The hash that ``span_hashes`` gives to this word."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(span_hashes(data, np.array([0]), np.array([len(data)]))[0])


def words_of(text: str | None) -> list[str]:
    """Plain form of the word rule, for short texts and tests."""
    if not text:
        return []
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    piece = TextSlice(0, data, np.array([0, len(data)]))
    w = find_words(piece)
    low = LOWER[data].tobytes()
    return [low[a:b].decode("utf-8", "replace") for a, b in zip(w.starts.tolist(), w.ends.tolist())]
