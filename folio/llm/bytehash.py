"""Hashes of words and word windows over Arrow string columns, by array arithmetic.

A word is ``[^\\x20\\x09-\\x0D]+``. UTF-8 never uses those bytes inside a longer
character, so words are found on bytes. A word's hash is a polynomial in a fixed
odd base over random 64-bit values of its bytes, taken from running sums modulo
2**64, then mixed; no Python code runs per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes hashed at once; longer only where a single word is.
SEGMENT = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_WINDOW_FACTORS = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * U64(2) + U64(1)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: ASCII letters and digits, ASCII marks.
IS_LETTER, IS_MARK = np.zeros(256, bool), np.zeros(256, bool)
IS_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
IS_MARK[33:127] = ~IS_LETTER[33:127]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers = [np.ones(1, U64), np.ones(1, U64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SEGMENT + 4096)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            x = np.full(size, base, U64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1, from 0) and the bytes of all texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def _marks_after_letters(part: np.ndarray) -> np.ndarray:
    """Places of the ASCII marks that follow an ASCII letter or digit, or a letter from U+00C0 to U+00FF."""
    mark = np.flatnonzero(IS_MARK[part])
    mark = mark[mark > 0]
    before = part[mark - 1]
    latin = (part[mark - 2] == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)
    return mark[IS_LETTER[before] | latin]


class Words:
    """Start, end (bytes) and hash of each word; ``of[i]:of[i + 1]`` are those of text i.

    With ``marks``, an ASCII mark after a letter or digit begins a word of its own, as do texts.
    """

    def __init__(self, column: pa.Array, lower: bool = False, marks: bool = False):
        self.offsets, self.data = text_bytes(column)
        offsets, data = self.offsets, self.data
        starts, ends, hashes = [], [], []
        edge = np.unique(offsets)
        a = 0
        while a < len(data):
            b = self._cut(a)
            part = data[a:b]
            if lower:
                part = LOWER[part]
            inside = ~IS_SPACE[part]
            opens = np.empty(len(part), bool)
            opens[0] = True
            opens[1:] = ~inside[:-1]
            opens[edge[np.searchsorted(edge, a) : np.searchsorted(edge, b)] - a] = True
            if marks:
                opens[_marks_after_letters(part)] = True
            closes = np.empty(len(part), bool)
            closes[-1] = True
            closes[:-1] = opens[1:] | ~inside[1:]
            start, end = np.flatnonzero(inside & opens), np.flatnonzero(inside & closes) + 1
            up, down = _power_tables(len(part))
            total = np.zeros(len(part) + 1, U64)
            np.cumsum(_BYTE_VALUES[part] * up[: len(part)], out=total[1:])
            hashes.append(mix((total[end] - total[start]) * down[start]))
            starts.append(start + a)
            ends.append(end + a)
            a = b
        self.starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.ends = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, U64)
        self.of = np.searchsorted(self.starts, offsets)

    def _cut(self, a: int) -> int:
        """A place from a on, about SEGMENT later, that is in no word."""
        data, step = self.data, SEGMENT
        if a + step >= len(data):
            return len(data)
        spaces = np.flatnonzero(IS_SPACE[data[a : a + step]])
        if len(spaces):
            return a + int(spaces[-1]) + 1
        b = a + step
        while b < len(data):
            spaces = np.flatnonzero(IS_SPACE[data[b : b + step]])
            if len(spaces):
                return b + int(spaces[0]) + 1
            b += step
        return len(data)

    def counts(self) -> np.ndarray:
        return np.diff(self.of)

    def windows(self, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of n words, in order, and where each text's begin.

        With ``short``, a text of 1 to n - 1 words has its whole sequence as one.
        """
        count = self.counts()
        own = np.maximum(count - n + 1, 0)
        if short:
            own = np.where((count > 0) & (count < n), 1, own)
        of = np.concatenate([[0], np.cumsum(own)])
        # where each window starts among the words
        first = np.repeat(self.of[:-1] - of[:-1], own) + np.arange(of[-1])
        size = np.repeat(np.minimum(count, n), own)
        total = np.zeros(of[-1], U64)
        for k in range(n):
            if short:
                there = size > k
                total[there] += self.hashes[first[there] + k] * _WINDOW_FACTORS[k]
            else:
                total += self.hashes[first + k] * _WINDOW_FACTORS[k]
        return mix(total + size.astype(U64)), of


def distinct_sets(values: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each slice, and where each slice's begin."""
    parts = [np.unique(values[a:b]) for a, b in zip(of[:-1], of[1:], strict=True)]
    new = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
    return (np.concatenate(parts) if parts else values[:0]), new
