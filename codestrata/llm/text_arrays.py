"""Text columns of Arrow batches as numpy arrays: words, hashes and windows.

Hashes are 64-bit polynomial sums over a random value for each byte, so that
every substring of a block gets its hash from two prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that are turned into arrays at a time (more only for one longer text).
BLOCK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads each input bit (splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(4)
def byte_values(fold_case: bool) -> np.ndarray:
    """The random 64-bit value of each byte; A-Z get those of a-z when folding."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
    if fold_case:
        values[65:91] = values[97:123]
    return values


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = BLOCK_BYTES
    while size < n:
        size *= 2
    return _powers(size)


class SortedHashes:
    """Sorted, distinct hashes of 64 bits, with the place where each range of their high bits begins."""

    def __init__(self, values: np.ndarray):
        bits = len(values).bit_length() + 1
        self.values, self.shift = values, np.uint64(64 - bits)
        self.starts = np.searchsorted(values >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each wanted hash, -1 of those that are not there."""
        if not len(self.values):
            return np.full(len(wanted), -1, np.int32)
        cell = (wanted >> self.shift).astype(np.int64)
        at = self.starts[cell]
        left = self.starts[cell + 1] - at
        out = np.where(self.values.take(at, mode="clip") == wanted, at, -1)
        more, nth = np.flatnonzero((out < 0) & (left > 1)), 1
        while len(more):
            place = at[more] + nth
            hit = self.values[place] == wanted[more]
            out[more[hit]] = place[hit]
            nth += 1
            more = more[~hit & (left[more] > nth)]
        return out


class Block:
    """Some consecutive texts of a batch as one byte array."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first_row: int):
        self.data, self.offsets, self.first_row = data, offsets, first_row
        self.rows = len(offsets) - 1

    def prefix_sums(self, fold_case: bool = False) -> np.ndarray:
        n = len(self.data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(byte_values(fold_case)[self.data] * powers(n + 1)[0][:n], out=sums[1:])
        return sums

    def span_hashes(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each span [start, end); equal bytes give equal hashes at any place."""
        raw = (sums[end] - sums[start]) * powers(len(self.data) + 1)[1][start]
        return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def window_hashes(self, sums: np.ndarray, width: int) -> np.ndarray:
        """``span_hashes`` of the ``width`` bytes from each place where as many follow."""
        raw = sums[width:] - sums[:-width]
        raw *= powers(len(self.data) + 1)[1][: len(raw)]
        raw += np.uint64(width * 0xD6E8FEB86659FD93 % (1 << 64))
        return mix(raw)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of each word; white space is 0x20 and 0x09-0x0D."""
        n = len(self.data)
        if not n:
            none = np.zeros(0, np.int64)
            return none, none, none
        inside = ~_WHITE[self.data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cuts = self.offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        begins[cuts] = inside[cuts]
        ends[cuts - 1] = inside[cuts - 1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        return start, end, np.searchsorted(self.offsets, start, "right") - 1


def blocks(column: pa.Array | pa.ChunkedArray, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts of ``column`` in blocks of about ``size`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64, len(column) + 1, 8 * column.offset)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        last = min(last, len(column))
        yield Block(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], first)
        first = last


def grouped_lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.ListArray:
    """``values``, sorted by ``owner``, as one list for each owner 0..n-1."""
    ends = np.searchsorted(owner, np.arange(n + 1), "left").astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
