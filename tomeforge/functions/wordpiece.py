"""Word pieces of a text by a vocabulary that the caller gives: the longest piece that fits, again and again."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

#: Characters of a word beyond which it is one unknown piece; what pieces within a word begin with.
LONGEST, WITHIN = 100, "##"
#: Ranges of signs that are words of their own, as they are written without blanks between them.
IDEOGRAPHS = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))


def _is_mark(c: str) -> bool:
    """Punctuation, ASCII signs that are neither letters nor digits among it."""
    return (33 <= ord(c) <= 126 and not c.isalnum()) or unicodedata.category(c)[0] == "P"


def words(text: str, lower: bool = True) -> list[str]:
    """Words and marks: control signs go, white space parts, and each mark and ideograph stands alone. lower: also without accents."""
    out: list[str] = []
    held: list[str] = []
    if lower:
        text = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn").lower()
    for c in text:
        kind = unicodedata.category(c)
        if c.isspace() or kind == "Zs":
            alone = ""
        elif c in "\0�" or kind[0] == "C":
            continue
        elif _is_mark(c) or (ord(c) >= 0x3400 and any(a <= ord(c) <= b for a, b in IDEOGRAPHS)):
            alone = c
        else:
            held.append(c)
            continue
        if held:
            out.append("".join(held))
            held = []
        if alone:
            out.append(alone)
    return [*out, "".join(held)] if held else out


class Node:
    """A place in the trie of pieces: what follows, and whether a piece ends here."""

    __slots__ = ("ends", "next")

    def __init__(self) -> None:
        self.next: dict[str, Node] = {}
        self.ends = False


class WordPieces:
    """Counts and cuts by a vocabulary. Two tries, of pieces that begin a word and of those within one, are walked sign by sign."""

    def __init__(self, vocabulary: Iterable[str], lower: bool = True, within: str = WITHIN, unknown: str = "[UNK]"):
        self.lower, self.within, self.unknown = lower, within, unknown
        self.first, self.rest = Node(), Node()
        for piece in vocabulary:
            top, text = (self.rest, piece[len(within) :]) if piece.startswith(within) and len(piece) > len(within) else (self.first, piece)
            for c in text:
                top = top.next.setdefault(c, Node())
            top.ends = True
        self._known: dict[str, list[str]] = {}

    def of_word(self, word: str) -> list[str]:
        """The pieces of one word; it is unknown as a whole if any part of it is."""
        if word in self._known:
            return self._known[word]
        out: list[str] = []
        at = 0
        while at < len(word) <= LONGEST:
            node, end = self.rest if at else self.first, 0
            for i in range(at, len(word)):
                node = node.next.get(word[i])
                if node is None:
                    break
                end = i + 1 if node.ends else end
            if not end:
                break
            out.append((self.within if at else "") + word[at:end])
            at = end
        out = out if word and at == len(word) else [self.unknown]
        if len(self._known) < 1 << 16:
            self._known[word] = out
        return out

    def pieces(self, text: str) -> list[str]:
        return [p for w in words(text, self.lower) for p in self.of_word(w)]

    def __call__(self, text: str) -> int:
        """How many pieces a text has: a counter for `chunks`."""
        return sum(len(self.of_word(w)) for w in words(text, self.lower))
