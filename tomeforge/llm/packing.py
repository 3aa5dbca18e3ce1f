"""Packing of token pieces into sequences by cutting-stock column generation.

Documents are tokenised once. Each is cut into whole sequences and one remainder, and piece lengths are
rounded up to UNIT tokens, so a histogram of at most length / UNIT classes, counted over all pieces,
states the whole problem whatever the number of documents. The linear program over patterns
(multisets of classes that fit a sequence) is solved on the driver; a knapsack by dynamic programming
prices new patterns. Rounded-down patterns, and first-fit-decreasing patterns for the few pieces
that rounding leaves, are dealt to the pieces by their rank within their class.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomeforge.llm.common import Workspace
from tomeforge.llm.tokens import END_ID, encoded, vocabulary_path

UNIT = 16
#: The program stops when no pattern can lower the number of sequences by more than this share.
GAP = 1e-3


def best_pattern(price: np.ndarray, weight: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of classes of the highest total price whose weights fit (unbounded knapsack)."""
    value, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(weight)
    w, p = weight[order], price[order]
    for c in range(1, capacity + 1):
        value[c] = value[c - 1]
        n = int(np.searchsorted(w, c, "right"))
        if n:
            got = p[:n] + value[c - w[:n]]
            best = int(np.argmax(got))
            if got[best] > value[c] + 1e-12:
                value[c], taken[c] = got[best], best
    out, c = np.zeros(len(weight), np.int64), capacity
    while c > 0:
        if taken[c] < 0:
            c -= 1
        else:
            out[order[taken[c]]] += 1
            c -= int(w[taken[c]])
    return float(value[capacity]), out


def cutting_stock(weight: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """(times, pieces of each class) patterns that hold the demand exactly."""
    m = len(weight)
    out: list[tuple[int, np.ndarray]] = []
    left = demand.astype(np.int64).copy()
    if m:
        basis = np.diag((capacity // weight).astype(float))
        amount = np.linalg.solve(basis, demand.astype(float))
        for _ in range(50 * m + 100):
            price = np.linalg.solve(basis.T, np.ones(m))
            value, pattern = best_pattern(price, weight, capacity)
            if value <= 1 + GAP:  # total / value bounds the optimum from below
                break
            step = np.linalg.solve(basis, pattern.astype(float))
            ratio = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
            leave = int(np.argmin(ratio))
            amount = amount - ratio[leave] * step
            amount[leave] = ratio[leave]
            amount = np.maximum(amount, 0)
            basis[:, leave] = pattern
        for times, pattern in zip(np.floor(amount + 1e-7).astype(np.int64), np.rint(basis.T).astype(np.int64), strict=True):
            used = pattern > 0
            times = min(int(times), int((left[used] // pattern[used]).min())) if used.any() else 0
            if times > 0:
                left -= times * pattern
                out.append((times, pattern))
    while left.any():
        pattern, room = np.zeros(m, np.int64), capacity
        for c in np.argsort(-weight):
            pattern[c] = min(left[c], room // weight[c])
            room -= int(pattern[c] * weight[c])
        used = pattern > 0
        times = int((left[used] // pattern[used]).min())
        left -= times * pattern
        out.append((times, pattern))
    return out


def _pieces(length: int, path: str):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "part", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(-(-length // UNIT) + 1, np.int64)
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            valid = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for i, j, ids, off in encoded(batch.column(1), path):
                total = np.diff(off)
                many = -(-total // length)
                doc = np.repeat(np.arange(j - i), many)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)) * length
                size = np.minimum(total[doc] - start, length)
                raw = memoryview(ids.astype("<u4").tobytes())
                at = off[doc] + start
                crc = np.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + size).tolist(), strict=True)], np.int64)
                kind = -(-size // UNIT)
                order = np.argsort(kind, kind="stable")
                counts = np.bincount(kind, minlength=len(seen))
                place = np.empty(len(kind), np.int64)
                place[order] = np.arange(len(kind)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(seen, counts)
                seen += counts
                at = i + doc
                yield pa.RecordBatch.from_arrays([pa.array(keys[at].astype(np.int64) if valid.all() else [int(keys[x]) if valid[x] else None for x in at], pa.int64()), *map(pa.array, (start, size, crc, total[doc], kind, np.full(len(doc), part), place))], names=names)

    return run


def _deal(plan: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    """plan: of each class the first rank, pieces a sequence and first sequence of its share of each pattern."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, rank = batch.column("class").to_numpy(), batch.column("rank").to_numpy()
            sequence = np.zeros(len(kind), np.int64)
            for c in np.unique(kind).tolist():
                first, each, base = plan[c]
                own = kind == c
                p = np.searchsorted(first, rank[own], "right") - 1
                sequence[own] = base[p] + (rank[own] - first[p]) // each[p]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence)], names=[*batch.schema.names[:5], "sequence_id"])

    return run


def pack(documents: DataFrame, length: int = 2048, tokenizer: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document's ids, END_ID after them, lie in exactly one piece each; a sequence holds at most
    `length` ids. A null or empty text is END_ID alone. Repeated rows are packed each for itself, a null doc_id
    stays null, an empty table gives no rows, other columns are ignored. Pieces of one class are
    ranked by input partition and place in it.
    """
    spark = documents.sparkSession
    ws, path = Workspace(spark, "packing"), tokenizer or vocabulary_path()
    docs = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = ws.save(docs.mapInArrow(_pieces(length, path), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class long, part long, place long"), "pieces")
    counts = ws.save(pieces.groupBy("part", "class").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {r[0]: r[1] for r in counts.groupBy("class").agg(F.sum("n")).collect()}  # at most length / UNIT rows
    kinds = sorted(histogram)
    patterns = cutting_stock(np.array(kinds, np.int64), np.array([histogram[c] for c in kinds], np.int64), length // UNIT)
    base = np.cumsum([0, *(t for t, _ in patterns)])
    plan = {}
    for i, c in enumerate(kinds):
        used = [p for p, (_, pattern) in enumerate(patterns) if pattern[i]]
        each = np.array([patterns[p][1][i] for p in used])
        share = each * np.array([patterns[p][0] for p in used])
        plan[c] = (np.cumsum(share) - share, each, base[used])
    before = F.coalesce(F.sum("n").over(Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("part", "class", before.alias("before"))
    ranked = pieces.join(offsets, ["part", "class"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", (F.col("before") + F.col("place")).alias("rank"))
    dealt = ranked.mapInArrow(_deal(plan), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long")
    within = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0)))


__all__ = ["END_ID", "best_pattern", "cutting_stock", "pack"]
