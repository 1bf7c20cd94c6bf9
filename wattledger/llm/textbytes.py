"""Words of many texts at once: numpy over the UTF-8 bytes of an Arrow column.

Every separator used here is an ASCII character, so words can be found in the
bytes without decoding them. Texts are worked off in slices of bounded size; a
text longer than the bound makes a slice of its own and is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

# Small enough for the arrays of a slice, eight bytes for each of its bytes, to stay near a CPU's cache.
SLICE_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1

# Bytes that are not part of a word: white space, and everything in ASCII but digits and letters.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
NOT_ALNUM = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])


class Words(NamedTuple):
    """Words of a slice of rows: byte bounds, the row of each word (from 0) and a 64-bit hash."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # by row: index of its first word; one more entry than rows


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all its bits depend on all bits of the input."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@cache
def _byte_values() -> np.ndarray:
    """A 64-bit value for each byte, the same for A-Z and a-z."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    values[65:91] = values[97:123]
    return values


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64; kept for slices of usual size only."""
    if _powers and len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    size = max(n, SLICE_BYTES + 1)
    tables = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        table = np.full(size, base, np.uint64)
        table[0] = 1
        tables.append(np.multiply.accumulate(table))
    if size == SLICE_BYTES + 1:
        _powers[:] = tables
    return tables[0], tables[1]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets from 0) of runs of rows holding at most ``limit`` bytes, or one row; null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    if len(texts) == 0:
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, bounds, data = texts.buffers()
    offsets = np.frombuffer(bounds, kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    every = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, every[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


def range_hashes(data: np.ndarray, ranges: list, values: np.ndarray | None = None) -> list[np.ndarray]:
    """64-bit hashes for each (starts, ends), A-Z taken as a-z unless other values of the 256 bytes are given."""
    power, inverse = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.multiply((_byte_values() if values is None else values)[data], power[:len(data)], out=total[1:])
    np.cumsum(total, out=total)
    return [mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64)) for start, end in ranges]


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of the byte ranges."""
    return range_hashes(data, [(start, end)], values)[0]


def bounds(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, index of each row's first) of maximal runs of marked bytes that do not go over a row's end."""
    begins, ends = inside.copy(), np.zeros(len(inside) + 1, bool)
    if len(inside):
        begins[1:] &= ~inside[:-1]
        heads = offsets[:-1][offsets[:-1] < len(inside)]
        begins[heads] = inside[heads]
        ends[1:] = inside
        ends[1:-1] &= ~inside[1:]
        tails = offsets[1:][offsets[1:] > 0]
        ends[tails] = inside[tails - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    return start, end, np.searchsorted(start, offsets)


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> Words:
    """Maximal runs of bytes that are not separators; a run never goes over the end of its row."""
    start, end, first = bounds(~separators[data], offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(start, end, row, hashes(data, start, end), first)


def grams(hash_of_word: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words, by the index of the first; they depend on the order of the words."""
    if len(hash_of_word) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hash_of_word) - k + 1, np.uint64)
    for i in range(k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += hash_of_word[i:i + len(out)]
    return mix(out)


def grams_in_rows(found: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every k consecutive words within a row."""
    every = grams(found.hash, k)
    at = np.flatnonzero(found.row[:len(every)] == found.row[k - 1:]) if len(every) else np.zeros(0, np.int64)
    return at, every[at]
