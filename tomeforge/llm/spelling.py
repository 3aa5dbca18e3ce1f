"""Spelling variants by symmetric deletes.

Every word emits itself and each distinct text that is left when one of its code points is deleted, as a 64-bit key with the places
whose deletion gives it. Two words differ by exactly one code point if and only if they share a key either as a word and a
deletion, or as two deletions at one place. So an equi-join on the key finds every such pair once; the pairs' texts are then
compared exactly, as keys are hashes. A key has few words: those that have it differ in one code point of it, so there are at most
(length + 1) x (number of letters) of them, however large the corpus is.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeforge.llm.bytesops import FOLD, SLICE_BYTES, bounds, byte_class, cut_long, distinct, mix, settle, slices
from tomeforge.llm.common import Workspace

_ASCII = byte_class((0x41, 0x5A), (0x61, 0x7A))
#: Runs up to so many bytes have their checksum computed side by side, byte by byte.
SIDE_BY_SIDE = 48


def letters(data: np.ndarray) -> np.ndarray:
    """True for the bytes of A-Z, a-z and U+00C0 to U+00FF (0xC3 and any byte after it)."""
    inside = _ASCII[data]
    lead = np.flatnonzero(data == 0xC3)
    inside[lead] = inside[lead + 1] = True
    return inside


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


def checksums(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each range of bytes as it goes on from the crc32 in before."""
    state, size = before.astype(np.uint32) ^ np.uint32(0xFFFFFFFF), end - start
    todo, k = np.flatnonzero(size <= SIDE_BY_SIDE), 0
    while len(todo := todo[size[todo] > k]):
        state[todo] = _CRC[(state[todo] ^ data[start[todo] + k]) & np.uint32(0xFF)] ^ (state[todo] >> np.uint32(8))
        k += 1
    state ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > SIDE_BY_SIDE).tolist():
        state[i] = zlib.crc32(data[start[i] : end[i]].tobytes(), int(before[i]))
    return state.astype(np.int64)


def _counted(low: np.ndarray, off: np.ndarray, before: np.ndarray, inside: np.ndarray, spoil: int | None, least: int) -> pa.RecordBatch:
    start, end, row = bounds(inside, off)
    points = end - start
    wide = np.append(0, np.cumsum(low == 0xC3))
    points = points - (wide[end] - wide[start])
    counts: Counter[str] = Counter()
    if spoil:
        start, end, row, points = (x[points >= least] for x in (start, end, row, points))
        h = checksums(low, start, end, before[row])
        hit = h % spoil == 0
        for i in np.flatnonzero(hit & (points > least)).tolist():
            word, at = low[start[i] : end[i]].tobytes().decode(), int(h[i] % points[i])
            counts[word[:at] + word[at + 1 :]] += 1
        start, end = start[~hit], end[~hit]
    else:
        start, end = start[points >= least], end[points >= least]
    first, number = distinct(low, start, end)
    raw = low.tobytes()
    words = [raw[a:b].decode() for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
    n = np.bincount(number, minlength=len(first)).tolist()
    return pa.RecordBatch.from_arrays([pa.array([*words, *counts], pa.string()), pa.array([*n, *counts.values()], pa.int64())], names=["word", "n"])


def _counts(spoil: int | None, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for batch in batches:
            before = np.array([zlib.crc32(f"{'' if x is None else x}:".encode()) for x in batch.column("key").to_pylist()], np.uint32)
            for i, j, data, off in slices(batch.column("text")):
                low, inside = FOLD[data], letters(data)
                if len(data) <= SLICE_BYTES:
                    yield _counted(low, off, before[i:j], inside, spoil, least)
                    continue
                at = 0
                for end in cut_long(inside):  # one long text, piece by piece
                    yield _counted(low[at:end], np.array([0, end - at]), before[i:j], inside[at:end], spoil, least)
                    at = end

    return run


def word_counts(documents: DataFrame, least: int = 5, spoil: int | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(word, n): the maximal runs of letters of whole texts with A-Z lowered, of at least `least` code points, and how often each occurs.

    Where spoil divides h = crc32 of `<doc_id>:<run>`, the run's code point number h % length is deleted before it is counted, so that the
    corpus holds known variants. A null text has no words; a null doc_id is written as nothing before the colon; repeated rows count again.
    Texts over SLICE_BYTES are worked through in pieces that end between runs.
    """
    from tomeforge.runtime import ship

    ship(documents.sparkSession)
    docs = documents.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    return docs.mapInArrow(_counts(spoil, least), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def deletions(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word's place, key, low, high): a row for each word itself (low = high = -1) and for each distinct text that one deletion leaves;
    deleting any code point from low to high gives that text."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    point = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    n, first = len(point), np.cumsum(size) - size
    owner = np.repeat(np.arange(len(words)), size)
    at = np.arange(n) - first[owner]
    powers = np.multiply.accumulate(np.append(np.uint64(1), np.full(int(size.max(initial=1)), 0x9E3779B97F4A7C15 | 1, np.uint64)))
    value = mix(point * np.uint64(0xE7037ED1A0B428DB))
    # prefix sums of the points where they stand, and one place further left; mod 2**64 differences of running sums are exact
    here = np.append(np.uint64(0), np.cumsum(value * powers[at]))
    left = np.append(np.uint64(0), np.cumsum(value * powers[np.maximum(at - 1, 0)]))
    whole = here[first + size] - here[first]
    begin = np.append(True, (point[1:] != point[:-1]) | (owner[1:] != owner[:-1]))[:n]
    low = np.flatnonzero(begin)
    high = np.append(low[1:], n)[: len(low)] - 1
    own = owner[low]
    stop = (first + size)[own]
    gone = (here[low] - here[first[own]]) + (left[stop] - left[low + 1])
    tag = lambda h, length: mix(h ^ (length.astype(np.uint64) * np.uint64(0x8EBC6AF09C88C6E3)))
    none = np.full(len(words), -1, np.int64)
    return (
        np.append(np.arange(len(words)), own),
        np.append(tag(whole, size), tag(gone, size[own] - 1)).view(np.int64),
        np.append(none, low - first[own]),
        np.append(none, high - first[own]),
    )


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, at = batch.column("word").to_pylist(), 0
        ids, n = batch.column("id").to_numpy(), batch.column("n").to_numpy()
        while at < len(words):
            end, points = at + 1, len(words[at])
            while end < len(words) and points + len(words[end]) <= SLICE_BYTES // 4:
                points += len(words[end])
                end += 1
            owner, key, low, high = deletions(words[at:end])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[at:end][owner]), pa.array(n[at:end][owner]), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], names=["key", "id", "n", "low", "high"])
            at = end


def spelling_variants(counts: DataFrame, least: int = 3, ratio: int = 2) -> DataFrame:
    """One row per word of counts (word, n) that occurs `least` times or more: word, form, root, n, n_near, form_n.

    Near words differ by exactly one inserted, deleted or replaced code point; n_near counts them. form is the near word of largest n
    (ties: the smallest in code-point order) if its n is at least ratio times the word's own, form_n its n; both null otherwise. root is
    the last word that following forms leads to, the word itself if it has none. Null words are left out; rows of one word are
    summed; an empty table gives no rows. A word of any length takes some 40 bytes a code point as keys.
    """
    spark = counts.sparkSession
    ws = Workspace(spark, "spelling")
    words = counts.filter("word is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n")).filter(F.col("n") >= least)
    # ids in the order of the words, so that the smallest id is the smallest word
    words = ws.save(words.repartitionByRange("word").sortWithinPartitions("word").select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    keys = ws.save(words.mapInArrow(_keys, "key long, id long, n long, low int, high int"), "keys")
    a, b = keys.alias("a"), keys.alias("b")
    one_deleted = (F.col("a.low") < 0) != (F.col("b.low") < 0)
    one_place = (F.col("a.low") >= 0) & (F.col("b.low") >= 0) & (F.col("a.low") <= F.col("b.high")) & (F.col("b.low") <= F.col("a.high"))
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")) & (one_deleted | one_place))
    pairs = pairs.select(F.col("a.id").alias("a"), F.col("a.n").alias("a_n"), F.col("b.id").alias("b"), F.col("b.n").alias("b_n"))
    text = lambda c: words.select(F.col("id").alias(c), F.col("word").alias(f"{c}_word"))
    pairs = pairs.join(text("a"), "a").join(text("b"), "b").filter(F.levenshtein("a_word", "b_word", 1) == 1)
    ways = F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("near"), F.col("b_n").alias("m")), F.struct(F.col("b").alias("id"), F.col("a").alias("near"), F.col("a_n").alias("m"))))
    near = pairs.select(ways.alias("x")).select("x.*").groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), F.max(F.struct(F.col("m"), (-F.col("near")).alias("near"))).alias("best"))
    is_form = F.col("best.m") >= ratio * F.col("n")
    facts = words.join(near, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, -F.col("best.near")).alias("form_id"), F.when(is_form, F.col("best.m")).alias("form_n"))
    facts = ws.save(facts, "facts")
    # n doubles with each step, so paths are short and have no cycles; each round doubles how far a word sees
    hops, step = ws.save(facts.filter("form_id is not null").select("id", F.col("form_id").alias("to")), "hops-0"), 0
    while True:
        onward = hops.select(F.col("id").alias("to"), F.col("to").alias("further"))
        step += 1
        after = ws.save(hops.join(onward, "to", "left").select("id", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")), f"hops-{step}")
        moved = after.filter("moved").limit(1).count()
        hops = after.select("id", "to")
        if not moved:
            break
    named = lambda c: words.select(F.col("id").alias(f"{c}_id"), F.col("word").alias(c))
    out = facts.join(hops.withColumnRenamed("to", "root_id"), "id", "left").join(named("form"), "form_id", "left").join(named("root"), "root_id", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
