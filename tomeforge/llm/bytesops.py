"""Words, word hashes and shingles of whole UTF-8 texts, computed on Arrow buffers with numpy.

Word and shingle hashes have 64 bits. Two different ones fall together with probability 2**-64;
operators that return spans or decisions on single words verify the bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa

#: Bytes of text that a task works on at once; temporary arrays take up to some 60 times as much. Of one text that is longer, words take
#: some 15 bytes a byte, and their hashes are made piece by piece.
SLICE_BYTES = 1 << 20
#: Longer slices, where fewer and larger groups save more than memory.
LONG_SLICE_BYTES = 4 << 20
_R = 0x9E3779B97F4A7C15 | 1
_INV = pow(_R, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}
_HELD: dict[str, Any] = {}


def held(token: str, build: Callable[[], Any]) -> Any:
    """The one large table that a worker keeps from task to task; another one takes its place."""
    if token not in _HELD:
        settle()
        _HELD[token] = build()
    return _HELD[token]


def settle() -> None:
    """Gives back what earlier tasks of other stages left in a reused worker; called before a task's first batch."""
    _HELD.clear()
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # a function of glibc only
        trim(0)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["p"]) < n:
        size = -(-n // SLICE_BYTES) * SLICE_BYTES
        for key, base in (("p", _R), ("i", _INV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _POWERS[key] = np.multiply.accumulate(a)
    return _POWERS["p"], _POWERS["i"]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB))


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the bytes in the ranges."""
    lut = np.zeros(256, bool)
    for a, b in ranges:
        lut[a : b + 1] = True
    return lut


#: Words are runs of bytes that are not ASCII white space ([^\x20\x09-\x0D]+).
NON_SPACE = byte_class((0, 8), (14, 31), (33, 255))
#: Words are runs of ASCII letters, digits and all non-ASCII ([^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lowered).
ALNUM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 255))


def folded() -> np.ndarray:
    """Byte to byte, A-Z lowered."""
    t = np.arange(256, dtype=np.uint8)
    t[0x41:0x5B] += 32
    return t


FOLD = folded()
_FOLDED_VALUE = _VALUE[FOLD]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n, at = len(column), column.offset
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
        at = column.offset
    _, off, data = column.buffers()
    if not n or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[at : at + n + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole texts of about limit bytes; a longer text is alone."""
    data, off = flat(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """A hash, never 0, of each range of bytes; where fold is set, A-Z lowered."""
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    h = np.empty(len(start), np.uint64)
    for values, which in ((_FOLDED_VALUE, fold), (_VALUE, ~fold)):
        np.cumsum(values[data] * power[: len(data)], out=total[1:])
        a, b = start[which], end[which]
        h[which] = (total[b] - total[a]) * inverse[a]
    return np.maximum(mix(h + (end - start).astype(np.uint64) * np.uint64(0x8EBC6AF09C88C6E3)), np.uint64(1))


class Lookup:
    """Places of numbers in a list of distinct ones, by an open table; -1 where there is none."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, (2 * len(keys)).bit_length())
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.keys, self.place = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int64)
        keys, todo = keys.astype(np.uint64), np.arange(len(keys))
        slot = self._home(keys)
        while len(todo):
            free = todo[self.place[slot[todo]] < 0]
            self.place[slot[free]] = free  # of those that want one slot the last gets it
            won = self.place[slot[todo]] == todo
            self.keys[slot[todo[won]]] = keys[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(_R)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.uint64)
        slot = self._home(keys)
        out = self.place[slot]
        todo = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            out[todo] = self.place[slot[todo]]
            todo = todo[(out[todo] >= 0) & (self.keys[slot[todo]] != keys[todo])]
        return out


class Words:
    """Words of a slice: start and end byte, doc (row in the slice), count and first word of each doc."""

    def __init__(self, data: np.ndarray, off: np.ndarray, keep: np.ndarray):
        n, docs = len(data), len(off) - 1
        inside = keep[data]
        before, after = np.empty(n, bool), np.empty(n, bool)
        if n:
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
            before[off[:-1][off[:-1] < n]] = False
            after[off[1:][off[1:] > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, off[:-1], "left")
        self.count = np.diff(np.append(self.first, len(self.start)))
        self.doc = np.repeat(np.arange(docs), self.count)
        self.data, self.off = data, off

    def hashes(self) -> np.ndarray:
        """A hash of each word, A-Z lowered. It doesn't depend on the word's place, so about SLICE_BYTES are worked on at once."""
        out, a = np.zeros(len(self.start), np.uint64), 0
        while a < len(out):
            b = max(a + 1, int(np.searchsorted(self.end, self.start[a] + SLICE_BYTES, "right")))
            base = int(self.start[a])
            start, end, data = self.start[a:b] - base, self.end[a:b] - base, self.data[base : self.end[b - 1]]
            power, inverse = _powers(len(data) + 1)
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_FOLDED_VALUE[data] * power[: len(data)], out=total[1:])
            out[a:b] = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0x8EBC6AF09C88C6E3))
            a = b
        return out


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes, across documents too."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    n, seed = len(h) - k + 1, (k * 0x589965CC75374CC3) & 0xFFFFFFFFFFFFFFFF
    total = np.full(n, seed, np.uint64)
    for j in range(k):
        total = total * np.uint64(0x2545F4914F6CDD1D) + h[j : j + n]
    return mix(total)


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each doc; a doc of fewer words has one shingle, of none, none."""
    h = words.hashes()
    sh = window_hashes(h, k)
    out = []
    for a, n in zip(words.first.tolist(), words.count.tolist(), strict=True):
        if n >= k:
            s = np.sort(sh[a : a + n - k + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        else:
            out.append(window_hashes(h[a : a + n], n) if n else np.zeros(0, np.uint64))
    return out


def bounds(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes that are inside; runs end with their text."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    begin, last = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:n]
    last[:-1] &= ~inside[1:] | edge[1:n]
    start = np.flatnonzero(begin)
    return start, np.flatnonzero(last) + 1, np.searchsorted(off, start, "right") - 1


def cut_long(inside: np.ndarray, limit: int = SLICE_BYTES) -> list[int]:
    """Ends of pieces of a long text, of about limit bytes and never within a run of bytes that are inside."""
    ends, at, n = [], 0, len(inside)
    while at < n:
        at = min(n, at + limit)
        while at < n and inside[at]:  # on to the end of the run, which may be long itself
            gap = np.flatnonzero(~inside[at : at + limit])
            at = at + int(gap[0]) if len(gap) else min(n, at + limit)
        ends.append(at)
    return ends


def joined(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of these words, one blank after each, and the place of each word in them."""
    size = end - start + 1
    place = np.cumsum(size) - size
    total = int(size.sum())
    if not total:
        return np.zeros(0, np.uint8), place
    source = np.repeat(start - place, size) + np.arange(total)
    out = data[np.minimum(source, len(data) - 1)]
    out[place + size - 1] = 0x20
    return out, place


def distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place of each different word, number of its word for each place), confirmed byte by byte."""
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, first, number = np.unique(range_hashes(data, start, end, np.zeros(len(start), bool)), return_index=True, return_inverse=True)
    size, of = end - start, first[number]
    same = bool((size == size[of]).all())
    if same:
        steps = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        same = np.array_equal(data[np.repeat(start, size) + steps], data[np.repeat(start[of], size) + steps])
    if not same:  # two words of one hash
        raw, seen = data.tobytes(), {}
        number = np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip(start.tolist(), end.tolist(), strict=True)], np.int64)
        first = np.unique(number, return_index=True)[1]
    return first, number
