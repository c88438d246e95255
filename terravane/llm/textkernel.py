"""Numpy helpers that Arrow tasks share: words of a batch of texts, 64-bit word and shingle hashes, per-document sets.

Everything works on one Arrow batch at a time, on the UTF-8 bytes of all its texts laid end to end, so that the
cost is a few vector passes over the bytes and memory is bounded by the batch. Long texts are whole: a batch is cut
between texts only (``slices``), and a text that is larger than the target is a batch of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Odd 64-bit multipliers of the hashes (from the golden ratio and the finaliser of a public 64-bit mixer).
STEP = np.uint64(0x9E3779B97F4A7C15)
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BYTE_VALUES = np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
#: Texts of one numpy pass, in bytes.
SLICE_BYTES = 1_000_000

_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[65:91] += 32
#: Bytes of words between ASCII white space, and of words of ASCII letters, digits and all non-ASCII characters.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its rows; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    if offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of the rows whose texts have ``most`` bytes together, or one row if it alone has more."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64))
    i = 0
    while i < len(ends):
        j = int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, side="right"))
        yield i, (j := max(j, i + 1))
        i = j


@dataclass
class Words:
    """Words of a slice: byte ranges, the row of each, and for each row the range of its words."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray  # n_rows + 1
    offsets: np.ndarray  # n_rows + 1, in bytes


def words_of(column: pa.Array, of_word: np.ndarray = NOT_SPACE, lower: bool = True) -> Words:
    """Runs of bytes that ``of_word`` allows, inside each row; ``lower`` turns A-Z into a-z first."""
    data, offsets = text_bytes(column)
    if lower:
        data = _ASCII_LOWER[data]
    n = len(data)
    inside = np.zeros(n + 1, dtype=bool)
    inside[:n] = of_word[data]
    begins = inside[:n].copy()
    begins[1:] &= ~inside[: max(n - 1, 0)]
    ends = inside[:n] & ~inside[1:]
    row_starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[row_starts] = inside[row_starts]  # a word ends with its row
    before = row_starts[row_starts > 0] - 1
    ends[before] = inside[before]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(data, start, end, row, first, offsets)


_UP = np.ones(1, dtype=np.uint64)
_DOWN = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of STEP and of its inverse modulo 2^64; kept for the next slice."""
    global _UP, _DOWN
    if len(_UP) < n:
        up = np.full(n, STEP, dtype=np.uint64)
        down = np.full(n, np.uint64(pow(int(STEP), -1, 2**64)), dtype=np.uint64)
        up[0] = down[0] = 1
        up, down = np.cumprod(up), np.cumprod(down)
        if n > 4 * SLICE_BYTES:
            return up, down
        _UP, _DOWN = up, down
    return _UP[:n], _DOWN[:n]


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each range, the same wherever it stands."""
    n = len(data)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUES[data] * up[:n], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(w: Words) -> np.ndarray:
    return range_hashes(w.data, w.start, w.end)


def shingles(w: Words, hashes: np.ndarray, size: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, first word) of all runs of ``size`` words; ``short``: a row with 1 to size - 1 words has its whole sequence."""
    n_words = np.diff(w.first)
    at = np.flatnonzero(np.arange(len(hashes)) + size <= np.repeat(w.first[1:], n_words))
    out = np.zeros(len(at), dtype=np.uint64)
    factors = np.cumprod(np.full(size, MIX_1, dtype=np.uint64))
    for k in range(size):
        out += hashes[at + k] * factors[k]
    row = w.row[at]
    if short and len(few := np.flatnonzero((n_words > 0) & (n_words < size))):
        extra = n_words[few].astype(np.uint64) * STEP
        for k in range(size - 1):
            there = n_words[few] > k
            extra[there] += hashes[w.first[few[there]] + k] * factors[k]
        row, out, at = np.concatenate([row, few]), np.concatenate([out, extra]), np.concatenate([at, w.first[few]])
    return row, mix(out), at


def distinct_sets(row: np.ndarray, values: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, end to end, and the n_rows + 1 offsets."""
    order = np.argsort(values)
    order = order[np.argsort(row[order], kind="stable")]
    row, values = row[order], values[order]
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    return values[keep], np.searchsorted(row[keep], np.arange(n_rows + 1))


def segment_reduce(ufunc: np.ufunc, values: np.ndarray, first: np.ndarray, empty) -> np.ndarray:
    """``ufunc`` over each range of ``values``; ``empty`` for ranges without values."""
    out = np.full(len(first) - 1, empty, dtype=values.dtype)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        out[full] = ufunc.reduceat(values, first[:-1][full])
    return out
