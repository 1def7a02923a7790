"""Words of Arrow text columns as numpy arrays, for the operators that work in Arrow batches.

A word is ``[^\\x20\\x09-\\x0D]+`` on the UTF-8 bytes, which splits at the same places as on code points.
Words, windows and sets are compared by 64-bit hashes; two different ones of a document are taken for
one with odds of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Inverse of _BASE modulo 2**64.
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
#: Bytes of text worked on at a time; one longer text is taken whole.
BLOCK = 1 << 20


_KINDS = {"bigint": LongType(), "double": DoubleType(), "string": StringType(), "binary": BinaryType()}


def extended(row: StructField, **types: str) -> StructType:
    """Schema of a row passed through a task with further columns; any column names may be inside the row."""
    return StructType([row, *(StructField(name, _KINDS[kind]) for name, kind in types.items())])


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over all of them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", _BACK)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


@dataclass
class Words:
    """Rows ``first`` .. of a column: their bytes, and the words as byte ranges and hashes."""

    first: int
    data: np.ndarray
    #: Byte offsets of the rows, one more than rows.
    rows: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    #: Word positions of the rows, one more than rows.
    bounds: np.ndarray
    #: Running sums of the byte hashes, from which any byte range is hashed.
    sums: np.ndarray

    def hash_ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * _power_tables(len(self.sums))[1][starts])

    def range(self, row: int) -> slice:
        return slice(int(self.bounds[row]), int(self.bounds[row + 1]))

    def __len__(self) -> int:
        return len(self.rows) - 1


def text_blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) of consecutive rows of about ``BLOCK`` bytes; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + BLOCK, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        low = offsets[first]
        yield first, data[low : offsets[last]], offsets[first : last + 1] - low
        first = last


def word_blocks(column: pa.Array, lower: bool = False) -> Iterator[Words]:
    """The words of all rows, block by block. ``lower`` maps A-Z to a-z first."""
    for first, data, rows in text_blocks(column):
        if lower:
            data = _LOWER[data]
        n = len(data)
        inside = ~SPACE[data]
        edge = rows[:-1][rows[:-1] < n]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[edge] = False
        after[edge[edge > 0] - 1] = False
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        up, down = _power_tables(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * down[starts])
        yield Words(first, data, rows, starts, ends, hashes, np.searchsorted(starts, rows), sums)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every ``size`` consecutive words; none when there are fewer words."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for i in range(size):
        total = total * _BASE + hashes[i : i + count]
    return mix(total)


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingles of one text; with fewer words the whole sequence is one shingle."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    return np.unique(windows(hashes, min(size, len(hashes))))
