"""Documents to overlapping chunks with lineage.

A document within its budget is one row and never leaves the JVM; only longer ones go through Python, where paragraphs are
gathered up to a budget of characters or, for some types and where a counter is given, of tokens. Budgets are fixed values.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeforge.runtime import ship

#: Characters of a chunk and of the overlap, tokens of a chunk, characters of one where no counter is given.
BUDGET, OVERLAP, TOKENS, WITHOUT_COUNTER = 1024, 100, 400, 1000
#: Types whose chunks are measured in tokens.
TOKEN_TYPES = ("lorebook", "skillprofile", "leveling", "summary", "curated")
#: Characters of chunks that a task holds before it gives them out.
HELD = 1 << 20
_ENDS = (". ", "! ", "? ", "\n", ", ", " ")
Counter = Callable[[str], int]


def _paragraphs(text: str, mark: str) -> list[str]:
    return [p for p in map(str.strip, text.split(mark)) if p]


def _head(text: str, limit: int) -> tuple[str, str]:
    """The longest start of at most `limit` characters that ends well, if that is over half of it, and the rest."""
    if len(text) <= limit:
        return text, ""
    for end in _ENDS:
        at = text.rfind(end, 0, limit)
        if at > limit // 2:
            return text[: at + len(end)].rstrip(), text[at + len(end) :].lstrip()
    return text[:limit].rstrip(), text[limit:].lstrip()


def _gather(units: Iterable[str], size: Counter, budget: int, between: str, split: Callable[[str], list[str]], gap: int = 0) -> list[str]:
    """Units joined while they fit the budget; one that doesn't fit alone is split by itself. `gap` counts for what stands between."""
    out: list[str] = []
    held: list[str] = []
    used = 0
    for unit in units:
        n = size(unit)
        if used + n + gap <= budget:
            held.append(unit)
            used += n + gap
            continue
        if held:
            out.append(between.join(held))
        held, used = ([unit], n) if n <= budget else ([], 0)
        if not held:
            out += split(unit)
    return out + ([between.join(held)] if held else [])


def by_characters(text: str, limit: int) -> list[str]:
    """Paragraphs gathered up to `limit` characters; longer ones are cut where a sentence, line or word ends."""
    if limit <= 0:
        raise ValueError("a budget must be positive")

    def cut(unit: str) -> list[str]:
        out = []
        while unit:
            piece, unit = _head(unit, limit)
            out.append(piece)
        return out

    units = _paragraphs(text, "\n\n") if len(text) > limit else []
    return _gather(units, len, limit, "\n\n", cut, gap=2) if units else [text]


def _halved(word: str, budget: int, count: Counter) -> list[str]:
    """A word of too many tokens, cut in half until each part has few enough or is one character."""
    if count(word) <= budget or len(word) < 2:
        return [word]
    half = len(word) // 2
    return [*_halved(word[:half], budget, count), *_halved(word[half:], budget, count)]


def by_tokens(text: str, budget: int, count: Counter, whole_words: bool = True) -> list[str]:
    """Paragraphs, else lines, else words gathered up to `budget` tokens; a word of more stays whole, or is cut."""
    if budget <= 0:
        raise ValueError("a budget must be positive")
    if count(text) <= budget:
        return [text]
    words = lambda line: _gather((w for w in line.split(" ") if w), count, budget, " ", lambda w: [w] if whole_words else _halved(w, budget, count))
    rows = lambda unit: _gather(_paragraphs(unit, "\n") or [unit], count, budget, "\n", words)
    return _gather(_paragraphs(text, "\n\n"), count, budget, "\n\n", rows)


def within_window(chunks: list[str], overlap: int, window: int, count: Counter) -> list[str]:
    """The chunks, each with as much overlap as leaves it in a window of tokens; a chunk that doesn't fit alone is cut first."""
    cut = [p for c in chunks for p in by_tokens(c, window, count, whole_words=False)]
    out = []
    for alone, with_overlap in zip(cut, overlapping(cut, overlap), strict=True):
        tail = with_overlap[: len(with_overlap) - len(alone)].split()
        while tail and count(" ".join([*tail, alone])) > window:
            tail = tail[1 + len(tail) // 8 :]
        out.append(" ".join([*tail, alone]) if tail and alone != with_overlap else alone if not tail else with_overlap)
    return out


def overlapping(chunks: list[str], overlap: int = OVERLAP) -> list[str]:
    """Each chunk after the first begins with the last characters of the one before it, from a word's start."""
    out = chunks[:1]
    for before, own in zip(chunks, chunks[1:], strict=False):
        tail = before[-overlap:] if overlap else ""
        blank = tail.find(" ")
        out.append(f"{tail[blank + 1 :] if blank > 0 else tail} {own}" if overlap else own)
    return out


def split(text: str, kind: str = "", count: Counter | None = None, budget: int = BUDGET, overlap: int = OVERLAP, tokens: int = TOKENS, window: int | None = None) -> list[str]:
    """The chunks of a document of a type; with a counter no chunk of several words has more than `tokens` tokens before its overlap,
    and with a window none has more than that with it."""
    if kind in TOKEN_TYPES:
        chunks = by_tokens(text, tokens, count) if count else by_characters(text, WITHOUT_COUNTER)
    else:
        chunks = by_characters(text, budget)
    if count:
        chunks = [part for c in chunks for part in by_tokens(c, tokens, count)]
        if window:
            return within_window(chunks, overlap, window, count)
    return overlapping(chunks, overlap)


def words_and_marks(text: str) -> int:
    """A simple counter: words and single signs."""
    return len(re.findall(r"\w+|[^\w\s]", text))


def chunked(docs: DataFrame, key: str, text: str, kind: str | None = None, count: Counter | None = None, budget: int = BUDGET, window: int | None = None) -> DataFrame:
    """id, parent_id (null for a document in one piece, which keeps its id), chunk_index, chunk_count, text.

    count: how many tokens a text has, as `wordpiece.WordPieces` tells; a character has one at most. window: the most that a chunk may have.
    A null text is an empty one and gives one empty chunk. Only documents that may need more than one chunk are sent to Python.
    """
    own = docs.select(F.col(key).cast("string").alias("id"), F.coalesce(F.col(kind) if kind else F.lit(""), F.lit("")).alias("kind"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # a token has a character at least, and characters are counted alike on both sides
    tokens = min(TOKENS, window or TOKENS)
    least = F.when(F.col("kind").isin(*TOKEN_TYPES), F.lit(tokens if count else WITHOUT_COUNTER)).otherwise(F.lit(min(budget, tokens) if count else budget))
    short = own.filter(F.length("text") <= least).select("id", F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("chunk_index"), F.lit(1).alias("chunk_count"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for ident, of, body in zip(*batch.columns, strict=True):  # texts become Python's one by one
                ident, parts = ident.as_py(), split(body.as_py(), of.as_py(), count, budget, window=window)
                whole = len(parts) == 1
                rows += [(ident if whole else f"{ident}_chunk_{i}", None if whole else ident, i, len(parts), p) for i, p in enumerate(parts)]
                held += sum(map(len, parts))
                if held > HELD:
                    yield out(rows)
                    rows, held = [], 0
            if rows:
                yield out(rows)
                rows, held = [], 0

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["id", "parent_id", "chunk_index", "chunk_count", "text"])

    ship(docs.sparkSession)
    long = own.filter(F.length("text") > least).mapInArrow(run, "id string, parent_id string, chunk_index int, chunk_count int, text string")
    return short.unionByName(long)
