"""Benchmark decontamination by a prefix-filtered set join.

An item's window (13 consecutive words; a shorter item is one window) is a set of word shingles. A text that
holds the window holds all its shingles, so one necessary prefix token is enough: the window's rarest
shingle over all documents. A first pass joins all documents with the benchmark's shingles, counts
them, and keeps the texts of the few documents that have any. A second pass over those joins the
prefix tokens only; the token's place in its window fixes where the window would lie, the window must
fit in the text (positional and length bounds), and the words are then compared byte for byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeforge.llm.bytesops import ALNUM, FOLD, Words, flat, settle, slices, window_hashes
from tomeforge.llm.common import Workspace

WINDOW, SHINGLE = 13, 8
#: Benchmark text in one index; a larger benchmark is joined index by index.
INDEX_BYTES = 16 << 20


def joined(words: Words, doc: int) -> tuple[bytes, np.ndarray]:
    """A doc's words, lowered, each with a blank after it, and their offsets."""
    a, n = int(words.first[doc]), int(words.count[doc])
    s, e = words.start[a : a + n], words.end[a : a + n]
    size = e - s + 1
    off = np.append(0, np.cumsum(size))
    out = np.full(int(off[-1]), 32, np.uint8)
    at = np.arange(int(off[-1])) - np.repeat(off[:-1], size)
    inside = at < np.repeat(size - 1, size)
    out[inside] = FOLD[words.data[(np.repeat(s, size) + at)[inside]]]
    return out.tobytes(), off


class Index:
    """The distinct windows of a block of items, and their shingles."""

    def __init__(self, items: list[tuple[str, str | None]]):
        found: dict[bytes, set[str]] = {}
        column = pa.array([t for _, t in items], pa.string())
        data, off = flat(column)
        words = Words(data[off[0] : off[-1]], off - off[0], ALNUM)
        for d, (name, _) in enumerate(items):
            n = int(words.count[d])
            if n:
                text, at = joined(words, d)
                w = min(n, WINDOW)
                for i in range(n - w + 1):
                    found.setdefault(text[at[i] : at[i + w]], set()).add(name)
        self.windows = list(found)
        self.items = [sorted(found[x]) for x in self.windows]
        data, off = flat(pa.array([x.decode() for x in self.windows], pa.string()))
        words = Words(data, off, ALNUM)
        h = words.hashes()
        self.size = words.count
        self.shingles: dict[int, np.ndarray] = {}  # of each shingle size: the sorted distinct hashes
        rows = {}
        for w, (a, n) in enumerate(zip(words.first.tolist(), words.count.tolist(), strict=True)):
            s = min(n, SHINGLE)
            rows.setdefault(s, []).append((w, window_hashes(h[a : a + n], s)))
        self.rows = rows
        for s, r in rows.items():
            self.shingles[s] = np.unique(np.concatenate([x for _, x in r]))

    def prefixes(self, counts: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each shingle size: sorted prefix tokens, with the window and the place in it of each."""
        out = {}
        for s, rows in self.rows.items():
            token, window, place = [], [], []
            for w, x in rows:
                rank = counts[s][np.searchsorted(self.shingles[s], x)]
                p = int(np.lexsort((x, rank))[0])
                token.append(x[p])
                window.append(w)
                place.append(p)
            order = np.argsort(np.array(token, np.uint64), kind="stable")
            out[s] = (np.array(token, np.uint64)[order], np.array(window)[order], np.array(place)[order])
        return out


class Member:
    """Which hashes are in a sorted array; a bit table of the low bits goes first."""

    def __init__(self, keys: np.ndarray):
        self.keys, bits = keys, max(16, int(len(keys) * 16).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.table = np.zeros(1 << bits, bool)
        self.table[keys & self.mask] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in h, places in keys)."""
        at = np.flatnonzero(self.table[h & self.mask])
        p = np.searchsorted(self.keys, h[at])
        good = (p < len(self.keys)) & (self.keys[np.minimum(p, len(self.keys) - 1)] == h[at]) if len(self.keys) else np.zeros(0, bool)
        return at[good], p[good]


def _scan(index):
    names = ["row", "doc_id", "n_words", "hits", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        members = {s: Member(k) for s, k in index.value.shingles.items()}
        for batch in batches:
            for i, j, data, off in slices(batch.column(2)):
                words = Words(data, off, ALNUM)
                h, last = words.hashes(), words.first + words.count
                pairs = []
                for s, member in members.items():
                    at, key = member.find(window_hashes(h, s))
                    doc = words.doc[at] if len(at) else at
                    inside = at + s <= last[doc]
                    pairs.append(np.unique(np.stack([doc[inside], np.full(int(inside.sum()), s), key[inside]], 1), axis=0))
                found = np.concatenate(pairs) if pairs else np.zeros((0, 3), np.int64)
                found = found[np.argsort(found[:, 0], kind="stable")]
                edge = np.searchsorted(found[:, 0], np.arange(j - i + 1))
                hits = [found[a:b, 1:].astype("<i8").tobytes() if b > a else None for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                part = batch.column(2).slice(i, j - i)
                text = pa.array([t.as_py() if x is not None else None for t, x in zip(part, hits, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(words.count), pa.array(hits, pa.binary()), text], names=names)

    return run


def _tally(index):
    """Documents that have each shingle, by (shingle size, place in the index)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {s: np.zeros(len(k), np.int64) for s, k in index.value.shingles.items()}
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                pairs = np.frombuffer(raw, "<i8").reshape(-1, 2)
                for s in np.unique(pairs[:, 0]).tolist():
                    total[s][pairs[pairs[:, 0] == s, 1]] += 1
        for s, n in total.items():
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), s)), pa.array(used), pa.array(n[used])], names=["s", "at", "n"])

    return run


def _verify(index, prefixes):
    names = ["row", "doc_id", "n_words", "spans", "items"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {s: (Member(np.unique(t)), t, w, p) for s, (t, w, p) in prefixes.value.items()}
        own = index.value
        for batch in batches:
            for i, j, data, off in slices(batch.column(3)):
                words = Words(data, off, ALNUM)
                h, spans, items, text = words.hashes(), [[] for _ in range(j - i)], [set() for _ in range(j - i)], {}
                for s, (member, token, window, place) in table.items():
                    at, key = member.find(window_hashes(h, s))
                    a, b = np.searchsorted(token, member.keys[key], "left"), np.searchsorted(token, member.keys[key], "right")
                    many = b - a
                    entry = np.repeat(a - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
                    at = np.repeat(at, many)
                    doc = words.doc[at] if len(at) else at
                    start = at - place[entry]
                    w = window[entry]
                    fits = (start >= words.first[doc]) & (start + own.size[w] <= words.first[doc] + words.count[doc])
                    for d, x, k in zip(doc[fits].tolist(), start[fits].tolist(), w[fits].tolist(), strict=True):
                        if d not in text:
                            text[d] = joined(words, d)
                        raw, o = text[d]
                        x -= int(words.first[d])
                        n = int(own.size[k])
                        if raw[o[x] : o[x + n]] == own.windows[k]:
                            spans[d].append((x, x + n))
                            items[d].update(own.items[k])
                flat_spans = [[y for x in merged(s) for y in x] for s in spans]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(flat_spans, pa.list_(pa.int64())), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], names=names)

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans and items of all index blocks of a document together."""
    for batch in batches:
        spans = [[y for x in merged([(p[k], p[k + 1]) for p in lists for k in range(0, len(p), 2)]) for y in x] for lists in batch.column(2).to_pylist()]
        items = [sorted({x for p in lists for x in p}) for lists in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], names=["doc_id", "n_words", "spans", "items"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [x or [] for x in batch.column("items").to_pylist()]
        spans = [x or [] for x in batch.column("spans").to_pylist()]
        n = batch.column("n_words").to_pylist()
        hit = [sum(s[1::2]) - sum(s[::2]) for s in spans]
        sha = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in ids]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array(sha), pa.array([h > 0 and 20 * h >= m for h, m in zip(hit, n, strict=True)])], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


SPANS = "doc_id long, n_words long, spans array<long>, items array<string>"


def contamination_spans(documents: DataFrame, benchmark: DataFrame, index_bytes: int = INDEX_BYTES, text: str = "text", key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """One row per row of documents: doc_id, n_words, spans (from, to, from, to … of the words inside any window's occurrence) and items.

    A null, empty or wordless text has no words, spans or items; an item without words has no window; the id of an item
    with a null id is the empty string; repeated items count once, repeated rows of documents each for themselves. An
    empty table of documents gives no rows, an empty benchmark no spans. Other columns are ignored.
    """
    spark = documents.sparkSession
    ws, sc = Workspace(spark, "decontaminate"), spark.sparkContext
    tests = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text"))
    volume = tests.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = int(volume // index_bytes) + 1
    docs = documents.select(F.lit(0).cast("long").alias("row"), F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    if blocks > 1:  # results of several indexes are put together by row
        docs = ws.save(docs.withColumn("row", F.monotonically_increasing_id()), "docs")
    results = []
    for b in range(blocks):
        own = tests if blocks == 1 else tests.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b)
        index = Index([tuple(r) for r in own.distinct().collect()])  # of index_bytes on average
        shared = sc.broadcast(index)
        seen = ws.save(docs.mapInArrow(_scan(shared), "row long, doc_id long, n_words long, hits binary, text string"), f"seen-{b}")
        hit = seen.filter("hits is not null")
        counts = {s: np.zeros(len(k), np.int64) for s, k in index.shingles.items()}
        tally = hit.select("hits").mapInArrow(_tally(shared), "s long, at long, n long").groupBy("s", "at").agg(F.sum("n"))
        for s, at, n in tally.collect():  # at most one row for each shingle of the index
            counts[s][at] = n
        prefixes = sc.broadcast(index.prefixes(counts))
        checked = hit.select("row", "doc_id", "n_words", "text").mapInArrow(_verify(shared, prefixes), "row long, " + SPANS)
        empty = seen.filter("hits is null").select("row", "doc_id", "n_words", F.array().cast("array<long>").alias("spans"), F.array().cast("array<string>").alias("items"))
        results.append(ws.save(checked.unionByName(empty), f"result-{b}"))
        ws.drop(f"seen-{b}")
    if blocks == 1:
        return results[0].drop("row")
    every = results[0]
    for r in results[1:]:
        every = every.unionByName(r)
    every = every.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))
    return every.drop("row").mapInArrow(_merge, SPANS)


def contamination(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and 20 * n_hit >= n_words); edge cases as in contamination_spans."""
    found = contamination_spans(documents, benchmark, **options)
    return found.mapInArrow(_digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
