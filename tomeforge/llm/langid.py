"""Language identification by prediction by partial matching.

For each language a tree of byte contexts of up to ORDER bytes (A-Z lowered) is counted. A byte's probability is its
share in the longest context in which it was seen, times the escape probability of each longer
context (escape count: distinct bytes seen there, method C); below the empty context all 256 bytes are alike. The statistics are
frozen after training, so a text's exact code length under a language is a sum over its bytes of a value that depends on the
byte and the ORDER bytes before it. These values are kept for what was seen in any language, by order; a byte unseen in its
context adds the context's escape and looks one order lower.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeforge.llm.bytesops import FOLD, Lookup, flat, held, settle, slices
from tomeforge.llm.common import ship

ORDER = 3
#: Texts a language that the trees are counted on, about; each is taken whole.
SAMPLE_TEXTS = 400
#: A text is accepted if its best code is shorter than its bytes themselves, with so many bits to spare for short texts.
SPARE_BITS = 64
#: Bytes whose costs are looked up at once.
CHUNK = 1 << 20
UNDETERMINED = "und"
_COUNTS = "lang string, code long, n long"


def codes(data: np.ndarray, off: np.ndarray, a: int, b: int) -> np.ndarray:
    """Of each of the bytes a to b: it and the ORDER before it as one number; blanks stand before a text."""
    out = FOLD[data[a:b]].astype(np.uint32)
    heads = off[:-1]
    heads = heads[(heads > a - ORDER) & (heads < b)]
    for k in range(1, ORDER + 1):
        before = np.full(b - a, 32, np.uint32)
        skip = max(0, k - a)
        before[skip:] = FOLD[data[a + skip - k : b - k]]
        for j in range(k):  # bytes of the text before
            at = heads + j - a
            before[at[(at >= 0) & (at < b - a)]] = 32
        out |= before << np.uint32(8 * k)
    # a text shorter than ORDER ends before its head's shadow does: what follows is a head of its own
    return out


class Model:
    """languages (sorted), and of each the (code, count) pairs of the longest contexts."""

    def __init__(self, counts: dict[str, dict[int, int]]):
        self.languages = sorted(counts)
        self.seen = []
        for lang in self.languages:
            code = np.array(sorted(counts[lang]), np.uint32)
            self.seen.append((code, np.array([counts[lang][int(c)] for c in code], np.int64)))

    def digest(self) -> str:
        parts = [repr(self.languages).encode(), *(a.tobytes() for pair in self.seen for a in pair)]
        return hashlib.sha256(b"".join(parts)).hexdigest()

    def tables(self) -> list[tuple[Lookup, np.ndarray, Lookup, np.ndarray]]:
        """By order: the codes seen in any language and their bits, the contexts and the bits of their escape, under each language."""
        out, lower_codes, lower = [], np.zeros(1, np.uint32), np.full((1, len(self.languages)), 1 / 256)
        for k in range(ORDER + 1):
            mask = np.uint32((1 << 8 * (k + 1)) - 1)
            union = np.unique(np.concatenate([c & mask for c, _ in self.seen]))
            n = np.zeros((len(union), len(self.languages)))
            for x, (code, count) in enumerate(self.seen):
                np.add.at(n[:, x], np.searchsorted(union, code & mask), count)
            context, at = np.unique(union >> np.uint32(8) if k else np.zeros(len(union), np.uint32), return_inverse=True)
            total, kinds = np.zeros((2, len(context), len(self.languages)))
            np.add.at(total, at, n)
            np.add.at(kinds, at, n > 0)
            known = total + kinds
            escape = np.where(known > 0, kinds / np.maximum(known, 1), 1.0)
            # a code of this order is longer by one byte in front than one of the order below; the context's first byte goes
            below = lower[np.searchsorted(lower_codes, union & np.uint32(mask >> 8)) if k else np.zeros(len(union), np.int64)]
            p = np.where(n > 0, n / np.maximum(known[at], 1), escape[at] * below)
            out.append((Lookup(union), -np.log2(p).astype(np.float32), Lookup(context), -np.log2(escape).astype(np.float32)))
            lower_codes, lower = union, p
        return out

    def bits(self, tables, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Exact code lengths of each text under each language."""
        total = np.zeros((len(off) - 1, len(self.languages)))
        for a in range(0, len(data), CHUNK):
            b = min(a + CHUNK, len(data))
            code = codes(data, off, a, b)
            cost, todo = np.zeros((b - a, len(self.languages)), np.float32), np.arange(b - a)
            for k in range(ORDER, -1, -1):
                known, bits, contexts, escape = tables[k]
                now = code[todo] & np.uint32((1 << 8 * (k + 1)) - 1)
                at = known.find(now)
                hit = at >= 0
                cost[todo[hit]] += bits[at[hit]]
                todo, now = todo[~hit], now[~hit]
                if not len(todo):
                    break
                at = contexts.find(now >> np.uint32(8) if k else np.zeros(len(now), np.uint32))
                cost[todo[at >= 0]] += escape[at[at >= 0]]
            cost[todo] += 8  # below the empty context
            inner = off[(off > a) & (off < b)]
            first = np.unique(np.append(a, inner))
            np.add.at(total, np.searchsorted(off, first, "right") - 1, np.add.reduceat(cost, first - a, axis=0, dtype=np.float64))
        return total


def _predict(shared, token: str):
    names = ["lang_pred", "score", "accepted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        tables = held(f"languages {token}", model.tables) if model.languages else None
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            letter = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            for i, j, data, off in slices(column):
                if tables is None:
                    best, score, good = [UNDETERMINED] * (j - i), np.zeros(j - i), np.zeros(j - i, bool)
                else:
                    bits = model.bits(tables, data, off)
                    k = bits.argmin(1)
                    score = 1 / np.exp2(-np.minimum(bits - bits.min(1, keepdims=True), 1000)).sum(1)
                    best = [model.languages[x] if y else UNDETERMINED for x, y in zip(k.tolist(), letter[i:j].tolist(), strict=True)]
                    score = np.where(letter[i:j], score, 0.0)
                    good = letter[i:j] & (bits.min(1) < 8 * np.diff(off) + SPARE_BITS)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(best, pa.string()), pa.array(score), pa.array(good)], names=[*batch.schema.names[:-1], *names])

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, code, n) of a task's texts."""
    settle()
    found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        lang = batch.column(0).to_pylist()
        for i, _, data, off in slices(batch.column(1), 1):  # one text at a time
            for a in range(0, len(data), CHUNK):
                found.setdefault(lang[i], []).append(np.unique(codes(data, off, a, min(a + CHUNK, len(data))), return_counts=True))
    for lang, parts in found.items():
        code, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        n = np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code)), pa.array(code.astype(np.int64)), pa.array(n)], names=["lang", "code", "n"])


def held_out(key: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))


def train(documents: DataFrame, folds: int = 4, fold: int = 2, texts: int = SAMPLE_TEXTS, text: str = "text", key: str = "doc_id", lang: str = "lang") -> Model:
    """From at most about `texts` texts of each language, drawn by a hash of the key from all outside the held-out fold. Their bytes are
    counted where they are; what reaches the driver is one row for each seen code of each language."""
    spark = documents.sparkSession
    ship(spark)
    rows = documents.filter(~held_out(F.col(key), folds, fold) & F.col(text).isNotNull() & F.col(lang).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}  # one row for each language
    if not counts:
        return Model({})
    step = F.create_map(*[F.lit(x) for pair in ((k, max(1, n // texts)) for k, n in counts.items()) for x in pair])
    drawn = rows.filter(F.pmod(F.xxhash64(F.col(key)), F.element_at(step, F.col(lang))) == 0)
    drawn = drawn.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    found: dict[str, dict[int, int]] = {}
    for name, code, n in drawn.mapInArrow(_count, _COUNTS).groupBy("lang", "code").agg(F.sum("n")).collect():
        found.setdefault(name, {})[code] = n
    return Model(found)


def identify(documents: DataFrame, model: Model, columns: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """The given columns and lang_pred, score, accepted of each row.

    lang_pred is the language of the shortest code (ties: the first by name), score its share of 2 ** -bits over all
    languages; accepted says whether that code is shorter than the text itself (SPARE_BITS), which noise is not. A null text, or one
    without any letter, is `und` with score 0 and not accepted, as is every text without trained languages.
    Repeated rows are judged each for itself; an empty table gives no rows.
    """
    spark = documents.sparkSession
    ship(spark)
    own = documents.select(*columns, F.col(text).alias("__text"))
    schema = ", ".join([*(f"`{c}` {t}" for c, t in own.dtypes[:-1]), "lang_pred string, score double, accepted boolean"])
    token = model.digest()
    return own.mapInArrow(_predict(spark.sparkContext.broadcast(model), token), schema)


def language_id(documents: DataFrame, folds: int = 4, fold: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted of each row of documents, by a model trained on the rows that aren't held out.

    A null doc_id isn't held out. Other edge cases are those of identify.
    """
    model = train(documents, folds, fold)
    named = documents.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "text")
    return identify(named, model, ("doc_id", "held_out"))


__all__ = ["Model", "flat", "identify", "language_id", "train"]
