"""Words of texts as search sees them: letters and digits of any script, lowered, without accents."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def _without_marks() -> dict[int, str | None]:
    """Letters that are a base and marks, to the base; marks of their own, to nothing. Made from the Unicode tables."""
    out: dict[int, str | None] = dict.fromkeys(range(0x300, 0x370))
    for c in (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)):
        base, *marks = unicodedata.normalize("NFD", chr(c))
        if marks and all(unicodedata.category(m) == "Mn" for m in marks):
            out[c] = base
    return out


_BARE = _without_marks()
#: Postings that a task holds before it gives them out.
HELD = 1 << 15


def folded(text: str) -> str:
    text = text.lower()
    if not text.isascii():
        for c in set(text):  # a text has few different letters, and each is replaced at once
            if ord(c) in _BARE:
                text = text.replace(c, _BARE[ord(c)] or "")
    return text


def words(text: str | None) -> list[str]:
    if not text:
        return []
    text = folded(text)
    for c in set(text):
        if not c.isalnum():
            text = text.replace(c, " ")
    return text.split()


def _places(found: list[str]) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for i, w in enumerate(found):
        out.setdefault(w, []).append(i)
    return out


def postings(docs: DataFrame, key: str, *columns: str, places: bool = True) -> DataFrame:
    """(key, term, field, tf, dl, places): a row for each word of each column of each row of docs.

    field is the column's number, tf how often the word stands there, places (if wanted) where, from 0 on, dl the number of words of
    all the row's columns. A row's words are counted in the row itself, so nothing is shuffled; keys that repeat give rows that repeat.
    """
    names = [key, "term", "field", "tf", "dl", *["places"] * places]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[list] = [[] for _ in names]
            for r in range(batch.num_rows):
                found = [words(batch.column(i + 1)[r].as_py()) for i in range(len(columns))]  # texts become Python's one by one
                total = sum(map(len, found))
                for f, own in enumerate(found):
                    of = _places(own) if places else Counter(own)
                    n = len(of)
                    values = [[r] * n, of, [f] * n, map(len, of.values()) if places else of.values(), [total] * n, *[of.values()] * places]
                    for column, more in zip(held, values, strict=True):
                        column.extend(more)
                if len(held[0]) > HELD:
                    yield out(batch, held)
                    held = [[] for _ in names]
            yield out(batch, held)

    def out(batch: pa.RecordBatch, held: list[list]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
        rest = [pa.array(column, kind) for column, kind in zip(held[1:], kinds, strict=False)]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(held[0], pa.int64())), *rest], names=names)

    kind = docs.select(key).schema[0].dataType.simpleString()
    texts = docs.selectExpr(f"`{key}`", *(f"cast(`{c}` as string) as `_c{i}`" for i, c in enumerate(columns)))
    return texts.mapInArrow(run, f"`{key}` {kind}, term string, field int, tf long, dl long" + ", places array<int>" * places)


def sized(docs: DataFrame, *columns: str) -> DataFrame:
    """docs with _words, the number of words of the columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [batch.column(batch.schema.get_field_index(c)).cast(pa.string()) for c in columns]
            n = [sum(len(words(t.as_py())) for t in row) for row in zip(*texts, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=[*batch.schema.names, "_words"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, _words long")


def prefix_counts(docs: DataFrame, key: str, text: str, prefixes: list[str]) -> DataFrame:
    """(key, dl, f0, f1, …): the words of each text, and how many of them begin with each prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dl, hits = [], [[] for _ in prefixes]
            for t in batch.column(1):
                found = words(t.as_py())
                dl.append(len(found))
                line = " " + " ".join(found)
                for own, p in zip(hits, prefixes, strict=True):
                    own.append(line.count(" " + p))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dl, pa.int64()), *(pa.array(h, pa.int64()) for h in hits)], names=[key, "dl", *(f"f{i}" for i in range(len(prefixes)))])

    kind = docs.select(key).schema[0].dataType.simpleString()
    return docs.selectExpr(f"`{key}`", f"cast(`{text}` as string) as _t").mapInArrow(run, f"`{key}` {kind}, dl long" + "".join(f", f{i} long" for i in range(len(prefixes))))
