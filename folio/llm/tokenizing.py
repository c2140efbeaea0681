"""Token ids of many texts by a public tokenizer file, with each distinct piece encoded once.

A BPE tokenizer splits its input before it merges, never within the white space in
front of a word and always after a word that white space follows. So a text is cut
into pieces, each a word with the white space before it; every new piece is encoded
by the tokenizers library, and the ids of a text are those of its pieces. Where a
tokenizer also splits between a letter or digit and the ASCII mark that follows it (it
is tried out on each mark), words are cut there too, so fewer pieces are new. Pieces
recur, so most are found by hash (64 bits, mixed with the white space) in a table of
arrays, and no Python code runs per word. Texts with white space beyond ASCII, whose
pieces could join, are encoded whole, and so are texts that hold the string of one of the
tokenizer's added tokens, such as ``<|endoftext|>``: it is that token's id, as in the library.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from folio.llm.bytehash import IS_MARK, Words, mix, text_bytes
from folio.llm.memory import release

U64 = np.uint64
#: Pieces a worker remembers; beyond that it forgets those that did not recur (speed only, not results).
REMEMBERED_PIECES = 1_000_000

#: White space beyond ASCII, as classes of RE2 have it.
_WIDE_SPACES = r"\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: No space but one in front, and no mark that could be a separator's.
_PLAIN = rf"^ ?[^\x00-\x20{_WIDE_SPACES}]+$"
_ODD_SPACE = re.compile(r"[^\S \t\n\x0b\x0c\r]")


class _Table:
    """Keys (64-bit hashes, not 0) to numbers, by open addressing on whole arrays."""

    def __init__(self, bits: int = 16):
        self.bits, self.size = bits, 0
        self.keys, self.values = np.zeros(1 << bits, U64), np.zeros(1 << bits, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where it is absent."""
        out = np.full(len(keys), -1, np.int32)
        slot = (keys >> U64(64 - self.bits)).astype(np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            there = self.keys[slot]
            hit = there == keys[open_]
            out[open_[hit]] = self.values[slot[hit]]
            go = ~hit & (there != 0)
            open_, slot = open_[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct absent keys."""
        if 2 * (self.size + len(keys)) > len(self.keys):
            used = np.flatnonzero(self.keys)
            old = self.keys[used], self.values[used]
            while 2 * (self.size + len(keys)) > 1 << self.bits:
                self.bits += 1
            self.keys, self.values = np.zeros(1 << self.bits, U64), np.zeros(1 << self.bits, np.int32)
            self._place(*old)
        self._place(keys, values)
        self.size += len(keys)

    def _place(self, keys: np.ndarray, values: np.ndarray) -> None:
        slot = (keys >> U64(64 - self.bits)).astype(np.int64)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, first = np.unique(slot[free], return_index=True)
            mine = free[first]
            self.keys[slot[mine]], self.values[slot[mine]] = keys[mine], values[mine]
            rest = np.ones(len(keys), bool)
            rest[mine] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)


def _pieces(column: pa.Array, marks: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All pieces: key, begin, end (bytes), where each text's begin, and the bytes."""
    words = Words(column, marks=marks)
    data, offsets = words.data, words.offsets
    n = words.counts()
    begin = np.empty(len(words.starts), np.int64)
    begin[1:] = words.ends[:-1]
    first = words.of[:-1][n > 0]
    begin[first] = offsets[:-1][n > 0]
    gap = words.starts - begin
    # what the white space in front is: nothing, one byte, or several
    space = np.where(gap == 0, 0, data[np.maximum(words.starts - 1, 0)]).astype(U64) if len(data) else np.zeros(0, U64)
    for k in np.flatnonzero(gap > 1).tolist():
        space[k] = _bytes_key(data[begin[k] : words.starts[k]])
    key = mix(words.hashes ^ mix(space + U64(1)))
    # white space at the end of a text is a piece of its own
    last = np.where(n > 0, words.ends[np.maximum(words.of[1:] - 1, 0)] if len(words.ends) else 0, offsets[:-1])
    tail = np.flatnonzero(last < offsets[1:])
    if len(tail):
        extra = np.array([_bytes_key(data[last[k] : offsets[k + 1]]) for k in tail.tolist()], U64)
        at = words.of[1:][tail]
        key = np.insert(key, at, mix(extra + U64(2)))
        begin, end = np.insert(begin, at, last[tail]), np.insert(words.ends, at, offsets[1:][tail])
        n = n.copy()
        n[tail] += 1
    else:
        end = words.ends
    key[key == 0] = 1
    return key, begin, end, np.concatenate([[0], np.cumsum(n)]), data


def _bytes_key(part: np.ndarray) -> int:
    total = 0xCBF29CE484222325
    for x in part.tolist():
        total = (total * 0x100000001B3 + x + 1) & 0xFFFFFFFFFFFFFFFF
    return total


class PieceEncoder:
    """``encode(column)`` gives all ids in order and where each text's begin."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.separator = self._separator()
        self.marks = self._parts_marks()
        self._forget()

    def _forget(self) -> None:
        self.table = _Table()
        self.ids = np.empty(1 << 16, np.uint32)
        self.at = np.empty(1 << 16, np.int64)
        self.size = np.empty(1 << 16, np.int32)
        self.again = np.zeros(1 << 16, bool)
        self.used = 0

    def _forget_some(self) -> None:
        """Keep the pieces that a later batch had again, unless they are most of those remembered."""
        number = self.table.values[self.table.keys != 0]
        keys = self.table.keys[self.table.keys != 0]
        stay = self.again[number]
        keys, number = keys[stay], number[stay]
        size, at, ids = self.size[number], self.at[number], self.ids
        self._forget()
        if 2 * len(keys) <= REMEMBERED_PIECES:
            self._remember(np.arange(len(keys)), _slices(ids, at, size), size)
            self.table.add(keys, np.arange(len(keys), dtype=np.int32))

    def _separator(self) -> tuple[str, int] | None:
        """A string that, between two pieces, is one id of its own and changes neither."""
        encode = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        for mark in ("\n", " \x01 "):
            whole, left, right = encode(f"ab.{mark} cd"), encode("ab."), encode(" cd")
            if len(whole) == len(left) + 1 + len(right) and whole == [*left, whole[len(left)], *right]:
                return mark, whole[len(left)]
        return None

    def _parts_marks(self) -> bool:
        """Does a word end between a letter or digit and the ASCII mark after it, with the ids of both parts alone?"""
        encode = lambda x: self.tokenizer.encode(x, add_special_tokens=False)
        for letter in "aZ7\u00e9":
            for mark in map(chr, np.flatnonzero(IS_MARK).tolist()):
                whole = encode(f"x{letter}{mark}b")
                if whole.char_to_word(1) == whole.char_to_word(2) or whole.ids != encode(f"x{letter}").ids + encode(f"{mark}b").ids:
                    return False
        return True

    def _one_by_one(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for x in found for i in x), np.uint32, int(sizes.sum())), sizes

    def _together(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces that hold no separator, encoded many in one text."""
        if not self.separator:
            return self._one_by_one(pieces.to_pylist())
        mark, mark_id = self.separator
        groups = pa.LargeListArray.from_arrays([*range(0, len(pieces), 500), len(pieces)], pieces)
        groups = pc.binary_join(groups, pa.scalar(mark, pa.large_string())).to_pylist()
        found = self.tokenizer.encode_batch_fast(groups, add_special_tokens=False)
        ids = np.concatenate([np.array(x.ids + [mark_id], np.uint32) for x in found])
        marks = np.flatnonzero(ids == mark_id)
        if len(marks) != len(pieces):
            return self._one_by_one(pieces.to_pylist())
        return np.delete(ids, marks), np.diff(marks, prepend=-1) - 1

    def _remember(self, numbers: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Note the ids, one after the other, of the pieces of these ascending numbers."""
        while len(numbers) and numbers[-1] >= len(self.at):
            self.at = np.concatenate([self.at, np.empty_like(self.at)])
            self.size = np.concatenate([self.size, np.empty_like(self.size)])
            self.again = np.concatenate([self.again, np.zeros_like(self.again)])
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.at[numbers] = self.used + np.cumsum(sizes) - sizes
        self.size[numbers] = sizes
        self.used += len(ids)

    def _learn(self, keys: np.ndarray, pieces: pa.Array) -> None:
        first = self.table.size
        plain = pc.match_substring_regex(pieces, _PLAIN)
        for there, encode in ((plain, self._together), (pc.invert(plain), lambda x: self._one_by_one(x.to_pylist()))):
            which = np.flatnonzero(there.to_numpy(zero_copy_only=False))
            if len(which):
                self._remember(first + which, *encode(pieces.filter(there)))
        self.table.add(keys, np.arange(first, first + len(keys), dtype=np.int32))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.table.size > REMEMBERED_PIECES:
            self._forget_some()
        odd = [k for k, x in enumerate(column.to_pylist()) if x and not x.isascii() and _ODD_SPACE.search(x)] if _may_be_odd(column) else []
        odd = sorted({*odd, *_holding(column, self.added)})
        key, begin, end, of, data = _pieces(column, self.marks)
        which = self.table.find(key)
        new = np.flatnonzero(which < 0)
        self.again[which[which >= 0] if len(new) else which] = True
        if len(new):
            keys, first = np.unique(key[new], return_index=True)
            first = new[first]
            self._learn(keys, _texts(data, begin[first], end[first]))
            which[new] = self.table.find(key[new])
        size = self.size[which].astype(np.int64)
        ids = _slices(self.ids, self.at[which], size)
        of = np.concatenate([[0], np.cumsum(size)])[of]
        return (ids, of) if not odd else self._whole(column, ids, of, odd)

    def _whole(self, column: pa.Array, ids: np.ndarray, of: np.ndarray, odd: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Put the ids of the texts ``odd``, each encoded at once, in place of those from pieces."""
        parts = [ids[a:b] for a, b in zip(of[:-1], of[1:], strict=True)]
        for k in odd:
            parts[k] = np.array(self.tokenizer.encode(column[k].as_py(), add_special_tokens=False).ids, np.uint32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


def _slices(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices of so many values that begin at the places given, one after the other."""
    ends = np.cumsum(size, dtype=np.int64)
    return values[np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]


def _texts(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """Slices of UTF-8 bytes as strings."""
    size = end - begin
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(_slices(data, begin, size)))


def _may_be_odd(column: pa.Array) -> bool:
    """Could any text hold white space beyond ASCII, or a separator that counts as such?"""
    return bool(pc.any(pc.match_substring_regex(column, rf"[\x1c-\x1f{_WIDE_SPACES}]")).as_py())


def _holding(column: pa.Array, strings: list[str]) -> list[int]:
    """The texts that hold any of the strings; all bytes are searched at once, texts only where that finds any."""
    raw = text_bytes(column)[1].tobytes()
    some = [x for x in strings if x.encode() in raw]
    return [k for k, text in enumerate(column.to_pylist()) if text and any(x in text for x in some)] if some else []


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The worker's own encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def text_groups(batch, column: str, most: int = 2 << 20):
    """Slices of an Arrow batch of at most ``most`` bytes of text, or one row."""
    import pyarrow as pa
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_string())), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(size)
    a = 0
    while a < len(total):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
        yield batch.slice(a, b - a)
        a = b
    release()
