"""Token ids of whole texts by the tokenizers library, with each word encoded once.

The tokenizer of word_bpe_49k.json lowers case, drops white space and never joins across it; runs of letters and runs of other
signs are units of their own. So the ids of a text are those of its units, one after the other. A unit is a run of letters
A-Z, a-z and U+00C0 to U+00FF (without the two signs among them) at the start of a piece between white space, the ASCII punctuation that ends such a
piece, or else the whole piece. Units are found and hashed for a whole slice at once, and looked up in a table
from hash to ids; only units that are not in the table go through the library. Hashes have 64 bits.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tomeforge.llm.bytesops import SLICE_BYTES, byte_class, held, range_hashes, slices

END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Slots of a worker's table of units (a power of two); when it is three quarters full it is emptied and filled again.
SLOTS = 1 << 21
#: Units of letters that are encoded in one call.
TOGETHER = 2000
_GAP = byte_class((0x20, 0x20), (0x09, 0x0A), (0x0D, 0x0D))
_LETTER = byte_class((0x41, 0x5A), (0x61, 0x7A))
_MARK = byte_class((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


class Coder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.words = Tokenizer(self.tokenizer.model)  # the same model (it is shared) for lowered runs of letters with blanks between them
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.clear()

    def clear(self) -> None:
        self.hash = np.zeros(SLOTS, np.uint64)
        self.at = np.zeros(SLOTS, np.int64)
        self.size = np.zeros(SLOTS, np.int32)
        self.filled, self.pool, self.used = 0, np.zeros(1 << 20, np.uint32), 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The slot that holds each hash or, if none does, the empty one where it belongs."""
        slot = (h >> np.uint64(20)).astype(np.int64) & (SLOTS - 1)
        todo = np.flatnonzero((self.hash[slot] != h) & (self.hash[slot] != 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (SLOTS - 1)
            there = self.hash[slot[todo]]
            todo = todo[(there != h[todo]) & (there != 0)]
        return slot

    def learn(self, h: np.ndarray, words: np.ndarray, texts: list[str]) -> None:
        """Puts new units into the table; words: which are runs of letters."""
        ids: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        runs = np.flatnonzero(words).tolist()
        for i in range(0, len(runs), TOGETHER):
            part = runs[i : i + TOGETHER]
            got = np.array(self.words.encode_batch_fast([" ".join(texts[x].lower() for x in part)], add_special_tokens=False)[0].ids, np.uint32)
            cut = np.flatnonzero(self.ends[got]) + 1  # the last id of a run, and no other, ends a word
            if len(cut) != len(part):
                raise ValueError("runs of letters are not units of this tokenizer")
            for x, piece in zip(part, np.split(got, cut[:-1]), strict=True):
                ids[x] = piece
        rest = np.flatnonzero(~words).tolist()
        for x, e in zip(rest, self.tokenizer.encode_batch_fast([texts[x] for x in rest], add_special_tokens=False) if rest else [], strict=True):
            ids[x] = np.array(e.ids, np.uint32)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(size.sum())
        if self.used + total > len(self.pool):
            self.pool = np.append(self.pool, np.zeros(max(total, len(self.pool)), np.uint32))
        self.pool[self.used : self.used + total] = np.concatenate(ids)
        at = self.used + np.cumsum(size) - size
        self.used += total
        todo = np.arange(len(h))
        while len(todo):  # of new hashes that want one slot the last gets it, and the others look on
            slot = self.find(h[todo])
            self.hash[slot] = h[todo]
            won = self.hash[slot] == h[todo]
            self.at[slot[won]], self.size[slot[won]] = at[todo[won]], size[todo[won]]
            todo = todo[~won]
        self.filled += len(h)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all the texts, their number in each text) of a slice."""
        n, docs = len(data), len(off) - 1
        if not n:
            return np.zeros(0, np.uint32), np.zeros(docs, np.int64)
        start, end, word, first = units(data, off)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(docs, np.int64)
        h = range_hashes(data, start, end, word)
        slot = self.find(h)
        new = np.flatnonzero(self.hash[slot] != h)
        if len(new):
            fresh, once = np.unique(h[new], return_index=True)
            if self.filled + len(fresh) > SLOTS * 3 // 4:
                self.clear()
                fresh, once = np.unique(h, return_index=True)
                new = np.arange(len(h))
            if len(fresh) > SLOTS * 3 // 4:
                raise ValueError("a slice holds more different units than the table")
            at = new[once]
            raw = data.tobytes()
            texts = [raw[a:b].decode() for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]
            self.learn(fresh, word[at], texts)
            slot = self.find(h)
        many = self.size[slot].astype(np.int64)
        total = np.cumsum(many)
        ids = self.pool[np.repeat(self.at[slot] - (total - many), many) + np.arange(int(total[-1]))]
        return ids, np.diff(np.append(0, total)[np.append(first, len(start))])


def units(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and kind (a run of letters or not) of each unit of a slice, and the first unit of each text."""
    n = len(data)
    gap = _GAP[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    begin, last = ~gap, ~gap
    begin[1:] &= gap[:-1] | edge[1:n]
    last[:-1] &= gap[1:] | edge[1:n]
    start, end = np.flatnonzero(begin), np.flatnonzero(last) + 1
    letter = _LETTER[data]
    lead = data == 0xC3  # U+00C0 to U+00FF; a text never ends within a character
    if lead.any():
        follows = np.flatnonzero(lead) + 1
        follows = follows[(data[follows] != 0x97) & (data[follows] != 0xB7)]
        letter[follows] = letter[follows - 1] = True
    # the first byte of each piece that is no letter, and the first that is no punctuation after it
    others = np.flatnonzero(~letter)
    core = np.minimum(np.append(others, n)[np.searchsorted(others, start)], end)
    odd = np.flatnonzero(~_MARK[data])
    whole = (core == start) | (np.append(odd, n)[np.searchsorted(odd, core)] < end)
    tail = ~whole & (core < end)
    # a piece gives one unit, or two if punctuation follows the letters
    place = np.cumsum(1 + tail) - 1 - tail
    total = int(len(start) + tail.sum())
    unit_start, unit_end, word = np.empty(total, np.int64), np.empty(total, np.int64), np.zeros(total, bool)
    unit_start[place], unit_end[place], word[place] = start, np.where(whole, end, core), ~whole
    unit_start[place[tail] + 1], unit_end[place[tail] + 1] = core[tail], end[tail]
    return unit_start, unit_end, word, np.searchsorted(unit_start, off[:-1])


def parts(data: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """A long text cut at white space into parts of about limit bytes."""
    gaps, at = np.flatnonzero(_GAP[data]), 0
    while at < len(data):
        k = int(np.searchsorted(gaps, at + limit))
        end = int(gaps[k]) if k < len(gaps) else len(data)
        yield data[at:end]
        at = end


def coder(path: str) -> Coder:
    return held(f"coder {path}", lambda: Coder(path))


def encoded(column: pa.Array, path: str, end: int | None = END_ID) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, ids, offsets of each row's ids), with the end id after each text."""
    for i, j, data, off in slices(column, SLICE_BYTES):
        if j == i + 1 and len(data) > SLICE_BYTES:  # one text, whose temporary arrays would grow with it
            ids = np.concatenate([coder(path).encode(x, np.array([0, len(x)]))[0] for x in parts(data, SLICE_BYTES)])
            n = np.array([len(ids)])
        else:
            ids, n = coder(path).encode(data, off)
        if end is not None:
            ids = np.insert(ids, np.cumsum(n), end)
            n = n + 1
        yield i, j, ids, np.append(0, np.cumsum(n))


__all__ = ["Coder", "END_ID", "coder", "encoded", "parts", "units", "vocabulary_path", "vocabulary_size"]
