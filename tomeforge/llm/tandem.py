"""Periodic runs of words by branching tandem repeats (Stoye and Gusfield).

The suffix tree of every text's word sequence is held as suffix array, common prefixes and rank; its inner nodes are the intervals
between smaller common prefixes. For each node of depth D and each leaf i below any child but the largest, i + D and
i - D are looked up below the node: as only the smaller halves are listed, this takes n log n steps. Each hit whose next word differs is a
branching tandem repeat, which ends where its run ends. Per end, the shortest repeat is rotated to the left as far as the words
allow, which gives the whole run; longer repeats that lie in the run with a multiple of its period are the same run, and the others go on.
All trees of a slice of texts are built and searched at once with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeforge.llm.bytesops import NON_SPACE, Words, distinct, joined, settle, slices
from tomeforge.runtime import ship

#: Entries of one leaf list, or of one block of comparisons, that are in memory at once.
AT_ONCE = 1 << 20


def suffix_order(text: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffixes in order, their ranks, common prefix of each with the one before it) of every text's words.

    text and number: of each word its text and the number of the word. Suffixes of different texts have nothing in common."""
    n = len(number)
    key = text * np.int64(number.max(initial=0) + 1) + number
    order = np.argsort(key, kind="stable")
    fresh = np.append(True, key[order][1:] != key[order][:-1])[:n]
    group = np.flatnonzero(fresh)[np.cumsum(fresh) - 1] if n else np.zeros(0, np.int64)
    rank = np.empty(n + 1, np.int32)
    rank[order], rank[n] = group, -1
    ends = np.append(np.flatnonzero(text[1:] != text[:-1]) + 1, n)
    stop = ends[np.searchsorted(ends, np.arange(n), "right")] if n else np.zeros(0, np.int64)
    levels, step = [rank.copy()], 1
    active = np.flatnonzero(np.bincount(rank[:n], minlength=n)[rank[:n]] > 1)
    while len(active):
        later = active + step
        second = np.where(later < stop[active], rank[np.minimum(later, n)], -1).astype(np.int64)
        both = rank[active].astype(np.int64) * (n + 1) + second + 1
        by = np.argsort(both, kind="stable")
        both, active = both[by], active[by]
        old = rank[active]
        head = np.append(True, old[1:] != old[:-1])
        place = old + np.arange(len(active)) - np.maximum.accumulate(np.where(head, np.arange(len(active)), 0))
        fresh = np.append(True, both[1:] != both[:-1])
        new = place[np.maximum.accumulate(np.where(fresh, np.arange(len(active)), 0))].astype(np.int32)
        rank[active] = new
        several = ~(fresh & np.append(fresh[1:], True))
        levels.append(rank.copy())
        active, step = active[several], 2 * step
    suffix = np.empty(n, np.int64)
    suffix[rank[:n]] = np.arange(n)
    # common prefixes of neighbours, from the ranks by the first 2**k words
    common = np.zeros(n, np.int64)
    at = np.flatnonzero(levels[0][suffix[1:]] == levels[0][suffix[:-1]]) + 1 if n else np.zeros(0, np.int64)
    i, j = suffix[at - 1], suffix[at]
    gone = np.zeros(len(at), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        gone += np.where(level[i + gone] == level[j + gone], 1 << k, 0)
    common[at] = gone
    return suffix, rank[:n], common


def previous_smaller(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each place in at the last place before it with a smaller value; values[0] must be smaller than all asked for."""
    floors = [values]
    while len(floors[-1]) > 1:
        low = floors[-1]
        low = np.append(low, low[-1]) if len(low) % 2 else low
        floors.append(np.minimum(low[::2], low[1::2]))
    value, block = values[at], at.copy()
    found, level = np.zeros(len(at), np.int64), np.full(len(at), -1)
    todo = np.arange(len(at))
    for k, floor in enumerate(floors):  # up until the block to the left has a smaller value
        b = block[todo]
        hit = (b % 2 == 1) & (floor[np.maximum(b - 1, 0)] < value[todo])
        found[todo[hit]], level[todo[hit]] = b[hit] - 1, k
        todo = todo[~hit]
        if not len(todo):
            break
        block[todo] >>= 1
    for k in range(int(level.max(initial=0)), 0, -1):  # and down to the last one within it
        down = np.flatnonzero(level >= k)
        right = 2 * found[down] + 1
        inside = right < len(floors[k - 1])
        is_right = inside & (floors[k - 1][np.minimum(right, len(floors[k - 1]) - 1)] < value[down])
        found[down] = 2 * found[down] + is_right
    return found


def _smaller_halves(common: np.ndarray) -> tuple[np.ndarray, ...]:
    """(depth, first and last leaf of the node, first and last leaf of the child) of every child that isn't its node's largest."""
    n = len(common)
    cut = np.flatnonzero(common)
    low = previous_smaller(common, cut)
    turned = np.append(0, common[::-1])
    high = n - previous_smaller(turned, n - cut)  # first place after with a smaller value
    depth = common[cut]
    order = np.lexsort((cut, depth, low))
    cut, low, high, depth = cut[order], low[order], high[order], depth[order]
    fresh = np.append(True, (low[1:] != low[:-1]) | (depth[1:] != depth[:-1]))
    head = np.flatnonzero(fresh)
    # a node's children begin at its first leaf and at each of its cuts
    start = np.insert(cut, head, low[head])
    node = np.insert(np.cumsum(fresh) - 1, head, np.arange(len(head)))
    depth, low, high, head = depth[head], low[head], high[head], head + np.arange(len(head))
    last = np.where(np.append(node[1:] != node[:-1], True), high[node], np.append(start[1:], n)) - 1
    size = last - start + 1
    top = np.flatnonzero(size == np.maximum.reduceat(size, head)[node])
    keep = np.ones(len(start), bool)
    keep[top[np.unique(node[top], return_index=True)[1]]] = False
    return depth[node][keep], low[node][keep], high[node][keep] - 1, start[keep], last[keep]


def branching_repeats(text: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(end, period) of each distinct branching tandem repeat, by end and then period."""
    n = len(number)
    suffix, rank, common = suffix_order(text, number)
    none = np.zeros(0, np.int64)
    if not common.any():
        return none, none
    depth, low, high, start, last = _smaller_halves(common)
    edges = np.append(np.flatnonzero(text[1:] != text[:-1]) + 1, n)
    stop = edges[np.searchsorted(edges, np.arange(n), "right")]
    begin = np.append(0, edges)[np.searchsorted(edges, np.arange(n), "right")]
    word = np.append(number, -1)
    total, ends, periods, a = np.cumsum(last - start + 1), [], [], 0
    while a < len(depth):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + AT_ONCE, "right")))
        many = (last - start + 1)[a:b]
        leaf = np.repeat(start[a:b] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        d, lo, hi = (np.repeat(x[a:b], many) for x in (depth, low, high))
        i = suffix[leaf]
        edge = stop[i]
        j = i + d
        there = rank[np.minimum(j, n - 1)]
        twice = np.minimum(j + d, n)
        hit = (j < edge) & (there >= lo) & (there <= hi) & ((j + d >= edge) | (word[np.minimum(j, n)] != word[twice]))
        ends.append((j + d)[hit])
        periods.append(d[hit])
        h = i - d
        there = rank[np.maximum(h, 0)]
        hit = (h >= begin[i]) & (there >= lo) & (there <= hi) & ((j >= edge) | (word[i] != word[np.minimum(j, n)]))
        ends.append(j[hit])
        periods.append(d[hit])
        a = b
    end, period = np.concatenate(ends), np.concatenate(periods)
    key = np.unique(end * np.int64(n + 1) + period)
    return key // (n + 1), key % (n + 1)


def rotated(number: np.ndarray, first: np.ndarray, begin: np.ndarray, period: np.ndarray) -> np.ndarray:
    """The place to which each repeat starting at first can be rotated to the left, not beyond begin."""
    first, todo, block = first.copy(), np.arange(len(first)), 16
    while len(todo):
        rest = []
        for part in np.array_split(todo, -(-len(todo) * block // AT_ONCE)):
            at = first[part][:, None] - 1 - np.arange(block)
            same = (at >= begin[part][:, None]) & (number[np.maximum(at, 0)] == number[np.maximum(at, 0) + period[part][:, None]])
            full = same.all(1)
            first[part] -= np.where(full, block, np.argmin(same, 1))
            rest.append(part[full])
        todo, block = np.concatenate(rest), min(2 * block, AT_ONCE)
    return first


def runs(text: np.ndarray, number: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, smallest period) of every maximal run of at least `least` words and two periods, by start and then period."""
    end, period = branching_repeats(text, number)
    edges = np.append(0, np.flatnonzero(text[1:] != text[:-1]) + 1)
    out: list[tuple[np.ndarray, ...]] = []
    while len(end):
        head = np.append(True, end[1:] != end[:-1])
        e, p = end[head], period[head]
        begin = edges[np.searchsorted(edges, e - 1, "right") - 1]
        s = rotated(number, e - 2 * p, begin, p)
        out.append((s, e, p))
        of = np.cumsum(head) - 1
        left = ~((period % p[of] == 0) & (end - 2 * period >= s[of]))
        end, period = end[left], period[left]
    if not out:
        return (np.zeros(0, np.int64),) * 3
    s, e, p = (np.concatenate(x) for x in zip(*out, strict=True))
    keep = e - s >= np.maximum(least, 2 * p)
    s, e, p = s[keep], e[keep], p[keep]
    order = np.lexsort((p, s))
    return s[order], e[order], p[order]


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _found(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for batch in batches:
            for i, j, data, off in slices(batch.column("text")):
                words = Words(data, off, NON_SPACE)
                _, number = distinct(data, words.start, words.end)
                s, e, p = runs(words.doc, number, least)
                of = words.doc[s]
                dropped = np.zeros(len(number) + 1, np.int64)
                np.add.at(dropped, s + p, 1)
                np.add.at(dropped, e, -1)
                kept = np.cumsum(dropped)[:-1] == 0
                out, place = joined(data, words.start[kept], words.end[kept])
                many = np.bincount(words.doc[kept], minlength=j - i)
                at = np.append(place, len(out))[np.append(0, np.cumsum(many))]
                raw = out.tobytes()
                texts = [raw[a : max(a, b - 1)].decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                flat = pa.StructArray.from_arrays([pa.array(s - words.first[of]), pa.array(e - s), pa.array(p)], names=["start", "length", "period"])
                listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(of, minlength=j - i))).astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], pa.array(words.count), listed, pa.array(texts, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(documents: DataFrame, least: int = 12, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period; by start, then period), collapsed.

    Words are runs of non-white-space, numbered from 0. A run is a stretch with smallest period q and at least max(least, 2 q) words
    that no neighbouring word extends. collapsed is the text of the words that no run holds after its first q words, with one blank
    between them. A null, empty or blank text has no words, no runs and an empty collapsed text; a null doc_id stays null; repeated rows are
    rows of their own; an empty table gives no rows; other columns are ignored. A long text is worked on whole, at some
    60 bytes of memory a byte and 4 more a word for each doubling of its longest repeat.
    """
    ship(documents.sparkSession)
    docs = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return docs.mapInArrow(_found(least), "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
