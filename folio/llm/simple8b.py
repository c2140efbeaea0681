"""Simple-8b word-aligned coding of unsigned integers, on whole arrays.

A 64-bit word has a 4-bit selector on top and 60 bits of values, the first value
lowest. ``SLOTS`` gives (values, bits) per selector; selector 0 is the escape:
its word holds no bits and the next word is one raw 64-bit value. Values are coded
in blocks of ``BLOCK``; each block begins at a word of its own, so blocks decode
independently and, many at once, by array operations.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
BLOCK = 4096
#: Fixed values of the format: values in a word and bits of each, by selector.
SLOTS = [(1, 64), (240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (1, 60)]
_COUNT = np.array([n for n, _ in SLOTS])
_WORDS = np.array([2] + [1] * 15)
#: Bits of every value below 65,536.
_SHORT = np.frexp(np.arange(1 << 16))[1].astype(np.uint8)
#: Blocks whose selectors are chosen at once, so that their arrays stay in a core's cache.
_AT_ONCE = 64


def _bit_lengths(values: np.ndarray) -> np.ndarray:
    if int(values.max()) < len(_SHORT):
        return _SHORT[values]
    high = (values >> U64(32)).astype(np.float64)
    low = (values & U64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1]).astype(np.uint8)


def _choices(bits: np.ndarray) -> np.ndarray:
    """The selector of most values that can begin at each place; bits: a row per block."""
    choice = np.zeros(bits.shape, np.int8)
    for k in range(len(SLOTS) - 1, 0, -1):  # the selector of most values last, so that it stays
        count, width = SLOTS[k]
        run = bits <= width
        have = 1
        while have < count and run.any():  # places from which so many values are narrow enough
            step = min(have, count - have)
            run = run[:, :-step] & run[:, step:]
            have += step
        if have == count:
            np.copyto(choice[:, : run.shape[1]], k, where=run)
    return choice


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All words, and the word at which each block begins."""
    values = values.astype(U64)
    n = len(values)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    ends = np.minimum(np.arange(1, blocks + 1) * BLOCK, n)
    bits = np.full((blocks, BLOCK), 255, np.uint8)  # what follows the last value fits no selector
    bits.ravel()[:n] = _bit_lengths(values)
    choice = np.concatenate([_choices(bits[k : k + _AT_ONCE]) for k in range(0, blocks, _AT_ONCE)]).ravel()
    # walk all blocks side by side
    begins = np.zeros(n, bool)
    at, end = np.arange(blocks) * BLOCK, ends
    while len(at):
        begins[at] = True
        at = at + _COUNT[choice[at]]
        live = at < end
        if not live.all():
            at, end = at[live], end[live]
    first = np.flatnonzero(begins)
    picked = choice[first]
    sizes = _WORDS[picked]
    where = np.cumsum(sizes) - sizes
    words = np.zeros(int(sizes.sum()), U64)
    padded = np.concatenate([values, np.zeros(240, U64)])
    for k in range(16):
        mine = np.flatnonzero(picked == k)
        if not len(mine):
            continue
        count, width = SLOTS[k]
        word = np.full(len(mine), k << 60, U64)
        if k == 0:
            words[where[mine] + 1] = padded[first[mine]]
        elif width:
            for j in range(count):
                word |= padded[first[mine] + j] << U64(j * width)
        words[where[mine]] = word
    return words, where[np.searchsorted(first, np.arange(blocks) * BLOCK)]


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n values; offsets: the word at which each block begins."""
    if not n:
        return np.zeros(0, U64)
    selector = (words >> U64(60)).astype(np.int64)
    head = np.ones(len(words), bool)
    if (selector == 0).any():  # a raw word after an escape is no selector
        maybe = np.flatnonzero(selector == 0)
        previous = -2
        for k in maybe:
            if k != previous + 1:
                head[k + 1] = False
                previous = k
        # a raw word may itself look like any selector
    heads = np.flatnonzero(head)
    picked = selector[heads]
    ends = np.cumsum(_COUNT[picked])
    begin = ends - _COUNT[picked]
    out = np.zeros(int(ends[-1]), U64)
    for k in range(16):
        mine = np.flatnonzero(picked == k)
        count, width = SLOTS[k]
        if k == 0:
            out[begin[mine]] = words[heads[mine] + 1]
        elif width:
            mask = U64((1 << width) - 1)
            for j in range(count):
                out[begin[mine] + j] = (words[heads[mine]] >> U64(j * width)) & mask
    return out[:n]


def decode_block(words: np.ndarray, offsets: np.ndarray, n: int, block: int) -> np.ndarray:
    """The values of one block."""
    a = int(offsets[block])
    b = int(offsets[block + 1]) if block + 1 < len(offsets) else len(words)
    return decode(words[a:b], np.zeros(1, np.int64), min(BLOCK, n - block * BLOCK))
