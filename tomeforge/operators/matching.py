"""A search expression as a condition on how often each of its phrases stands in a document.

Phrases are words that follow one another, "in quotes", or joined by +; a word with * is a prefix; ^ wants the phrase at the
beginning. They combine by NOT, AND (or nothing) and OR, in this order, by brackets, NEAR(a b, n) and column filters
(name: x, {name snippet}: x, - name: x). Every phrase becomes one number per document, so all of the set algebra is one
condition on these numbers, after one grouping of the postings.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tomeforge.functions.words import words

_TOKEN = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([\w\u0080-\U0010ffff]+)|([(){}:*+^,-]))')
#: Fixed value: words that may lie between the phrases of a NEAR that names no number.
NEAR = 10


class BadExpression(ValueError):
    """The text is no search expression."""


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]
    prefix: bool = False
    first: bool = False
    fields: tuple[int, ...] | None = None


@dataclass
class Expression:
    """phrases; near: of each NEAR the numbers of its phrases and the words between; condition: on whether each phrase and each NEAR is there."""

    phrases: list[Phrase] = field(default_factory=list)
    near: list[tuple[tuple[int, ...], int]] = field(default_factory=list)
    condition: Callable[[list[Column], list[Column]], Column] = lambda p, n: F.lit(True)


class _Reader:
    def __init__(self, text: str, columns: tuple[str, ...]):
        self.columns, self.out, self.tokens, at = columns, Expression(), [], 0
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if m is None:
                raise BadExpression(f"unexpected sign at {at}")
            quoted, bare, sign = m.groups()
            self.tokens.append(("text", quoted.replace('""', '"')) if quoted is not None else ("word", bare) if bare else ("sign", sign))
            at = m.end()
        self.tokens.append(("end", ""))
        self.at = 0

    def peek(self, *wanted: tuple[str, str]) -> bool:
        return self.tokens[self.at] in wanted

    def take(self, *wanted: tuple[str, str]) -> bool:
        found = self.peek(*wanted)
        self.at += found
        return found

    def need(self, sign: str) -> None:
        if not self.take(("sign", sign)):
            raise BadExpression(f"{sign} expected")

    def whole(self) -> Expression:
        self.out.condition = self.either(None)
        if not self.peek(("end", "")):
            raise BadExpression(f"unexpected {self.tokens[self.at][1]}")
        return self.out

    def chain(self, inner: Callable, operator: str, join: Callable[[Column, Column], Column], fields: tuple[int, ...] | None) -> Callable:
        parts = [inner(fields)]
        while self.take(("word", operator)):
            parts.append(inner(fields))
        return lambda p, n: reduce(join, [c(p, n) for c in parts])

    def either(self, fields):
        return self.chain(self.both, "OR", lambda a, b: a | b, fields)

    def both(self, fields):
        return self.chain(self.without, "AND", lambda a, b: a & b, fields)

    def without(self, fields):
        return self.chain(self.together, "NOT", lambda a, b: a & ~b, fields)

    def together(self, fields):
        parts = [self.unit(fields)]
        while not self.peek(("end", ""), ("sign", ")"), ("word", "AND"), ("word", "OR"), ("word", "NOT")):
            parts.append(self.unit(fields))
        return lambda p, n: reduce(lambda a, b: a & b, [c(p, n) for c in parts])

    def unit(self, fields):
        if (own := self.filter()) is not None:
            fields = own if fields is None else tuple(f for f in own if f in fields)
            return self.unit(fields)
        if self.take(("sign", "(")):
            inner = self.either(fields)
            self.need(")")
            return inner
        if self.peek(("word", "NEAR")) and self.tokens[self.at + 1] == ("sign", "("):
            return self.near(fields)
        i = self.phrase(fields)
        return lambda p, n: p[i]

    def filter(self) -> tuple[int, ...] | None:
        """The numbers of the columns before a colon, if one stands here."""
        start, names = self.at, []
        other = self.take(("sign", "-"))
        if self.take(("sign", "{")):
            while not self.take(("sign", "}")):
                names.append(self.text())
        elif self.tokens[self.at][0] in ("word", "text"):
            names.append(self.text())
        if not names or not self.take(("sign", ":")):
            if other:
                raise BadExpression("a column expected after -")
            self.at = start
            return None
        if missing := [x for x in names if x not in self.columns]:
            raise BadExpression(f"no column {missing[0]}")
        return tuple(i for i, c in enumerate(self.columns) if (c in names) != other)

    def text(self) -> str:
        kind, text = self.tokens[self.at]
        if kind not in ("word", "text") or (kind == "word" and text in ("AND", "OR", "NOT")):
            raise BadExpression(f"a word expected, not {text or 'the end'}")
        self.at += 1
        return text

    def phrase(self, fields) -> int:
        first, found = self.take(("sign", "^")), []
        found += words(self.text())
        prefix = self.take(("sign", "*"))
        while self.take(("sign", "+")):
            found += words(self.text())
            prefix = self.take(("sign", "*"))
        self.out.phrases.append(Phrase(tuple(found), prefix, first, fields))
        return len(self.out.phrases) - 1

    def near(self, fields):
        self.at += 2
        numbers, gap = [], NEAR
        while not self.peek(("sign", ")"), ("sign", ","), ("end", "")):
            numbers.append(self.phrase(fields))
        if self.take(("sign", ",")):
            text = self.text()
            if not text.isdigit():
                raise BadExpression("a number expected")
            gap = int(text)
        self.need(")")
        if not numbers:
            raise BadExpression("a phrase expected")
        self.out.near.append((tuple(numbers), gap))
        i = len(self.out.near) - 1
        return lambda p, n: n[i]


def expression(text: str, columns: tuple[str, ...]) -> Expression:
    """The expression that a text spells; BadExpression if it is none."""
    return _Reader(text, columns).whole()


def literal(text: str) -> Expression:
    """The whole text as one phrase."""
    return Expression([Phrase(tuple(words(text)))], [], lambda p, n: p[0])


def any_prefix(terms: list[str]) -> Expression:
    return Expression([Phrase((t,), True) for t in terms], [], lambda p, n: reduce(lambda a, b: a | b, p))


def plain_words(e: Expression) -> bool:
    """Whether counts alone decide: single words, no places wanted."""
    return not e.near and all(len(p.words) == 1 and not p.first for p in e.phrases)


def shifted(places: Column, k: int) -> Column:
    return F.transform(places, lambda x: x - k)


def starts(p: Phrase, places: Callable[[str, bool], Column]) -> Column:
    """Where the phrase begins, from the places of each of its words (and whether it is a prefix)."""
    if not p.words:
        return F.array().cast("array<int>")
    last = len(p.words) - 1
    found = places(p.words[0], p.prefix and not last)
    for k in range(1, last + 1):
        found = F.array_intersect(found, shifted(places(p.words[k], p.prefix and k == last), k))
    return F.filter(found, lambda x: x == 0) if p.first else found


def is_near(begins: list[Column], lengths: list[int], gap: int) -> Column:
    """Whether all the phrases stand together: from one of them, the others begin within gap words of its end."""

    def from_here(i: int) -> Column:
        def close(x: Column) -> Column:
            others = [F.exists(b, lambda y: y.between(x, x + lengths[i] + gap)) for j, b in enumerate(begins) if j != i]
            return reduce(lambda a, b: a & b, others, F.lit(True))

        return F.exists(begins[i], close)

    return reduce(lambda a, b: a | b, map(from_here, range(len(begins))))


def restricted(p: Phrase, columns: int) -> tuple[int, ...]:
    return p.fields if p.fields is not None else tuple(range(columns))


__all__ = ["BadExpression", "Expression", "Phrase", "any_prefix", "expression", "is_near", "literal", "plain_words", "restricted", "shifted", "starts"]
