"""Vectorised words and hashes over the contiguous bytes of an Arrow text column.

Words are runs of bytes other than space and \\x09-\\x0D; UTF-8 keeps those six values for
themselves, so working on bytes is working on characters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
BLOCK_BYTES = 1 << 20

_IS_SEPARATOR = np.zeros(256, bool)
_IS_SEPARATOR[list(SEPARATORS)] = True
NOT_ALPHANUMERIC = np.zeros(256, bool)
NOT_ALPHANUMERIC[:128] = [not chr(b).isalnum() for b in range(128)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# An odd multiplier has an inverse modulo 2**64, so any substring's polynomial hash is a
# difference of prefix sums times a power of that inverse.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, length: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < length:
        table = np.full(max(length, BLOCK_BYTES + 1), base, np.uint64)
        table[0] = 1
        table = np.cumprod(table, dtype=np.uint64)
        if length <= 8 * BLOCK_BYTES:
            _powers[base] = table
    return table[:length]


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly."""
    values = values ^ (values >> np.uint64(30))
    values = values * _MIX_1
    values ^= values >> np.uint64(27)
    values = values * _MIX_2
    return values ^ (values >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of the bytes' polynomial terms; entry i covers data[:i]."""
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    terms = data.astype(np.uint64)
    terms += np.uint64(1)
    terms *= _power_table(_BASE, len(data))
    np.cumsum(terms, out=sums[1:])
    return sums


def substring_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for each pair, equal for equal contents anywhere."""
    values = sums[ends] - sums[starts]
    values *= _power_table(_INVERSE, len(sums))[starts]
    return mix(values)


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES):
    """Cut a text column into runs of whole rows of about `limit` bytes.

    Yields (first row, bytes, offsets); offsets has one entry more than the run has rows.
    Null counts as empty. A row longer than the limit is a run of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    if not len(column):
        return
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(buffers[1], kind, len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(column))
        low, high = offsets[first], offsets[last]
        yield first, data[low:high], offsets[first : last + 1] - low
        first = last


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


@dataclass
class Words:
    starts: np.ndarray  # byte positions
    ends: np.ndarray
    rows: np.ndarray  # row of each word
    first: np.ndarray  # first word of each row, with one entry more than rows

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def find_words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _IS_SEPARATOR) -> Words:
    """The words of every row; `separator` marks the byte values between words."""
    inside = ~separator[data]
    begins, finishes = inside.copy(), inside.copy()
    if len(data):
        begins[1:] &= ~inside[:-1]
        finishes[:-1] &= ~inside[1:]
        heads = offsets[:-1][np.diff(offsets) > 0]
        begins[heads] = inside[heads]
        tails = offsets[1:][np.diff(offsets) > 0] - 1
        finishes[tails] = inside[tails]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(finishes) + 1
    first = np.searchsorted(starts, offsets)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(starts, ends, rows, first)


def word_hashes(data: np.ndarray, words: Words) -> np.ndarray:
    return substring_hashes(prefix_sums(data), words.starts, words.ends)


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of several hashes, in their order."""
    total = np.full(len(parts[0]), np.uint64(len(parts)), np.uint64)
    for part in parts:
        total *= np.uint64(_BASE)
        total += part
    return mix(total)


def shingles(hashes: np.ndarray, words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words, and the row of each.

    A row with fewer words gives its whole sequence as one; a row without words gives none.
    """
    count = max(len(hashes) - width + 1, 0)
    parts = [hashes[k : k + count] for k in range(width)]
    whole = words.rows[:count] == words.rows[width - 1 : width - 1 + count]
    values, rows = combine(parts)[whole], words.rows[:count][whole]
    sizes = words.counts()
    extra_values, extra_rows = [], []
    for size in range(1, width):
        short = np.flatnonzero(sizes == size)
        if len(short):
            extra_values.append(combine([hashes[words.first[short] + k] for k in range(size)]))
            extra_rows.append(short)
    if extra_rows:
        values = np.concatenate([values, *extra_values])
        rows = np.concatenate([rows, *extra_rows])
    return values, rows


def shingle_sums(values: np.ndarray, words: Words, width: int) -> np.ndarray:
    """The sum of the words' values in each of `shingles`, in its order."""
    count = max(len(values) - width + 1, 0)
    whole = words.rows[:count] == words.rows[width - 1 : width - 1 + count]
    sums = [sum(values[k : k + count] for k in range(width))[whole]]
    sizes = words.counts()
    for size in range(1, width):
        first = words.first[:-1][sizes == size]
        if len(first):
            sums.append(sum(values[first + k] for k in range(size)))
    return np.concatenate(sums)
