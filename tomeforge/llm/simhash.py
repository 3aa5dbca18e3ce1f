"""SimHash near-duplicates over a byte-position inverted index.

A fingerprint has eight bytes at eight positions. Two that differ in at most three bits differ in at most three bytes, so they share
at least five of their eight positional bytes, and hence at least three of the four in one half. The index lists fingerprints by
three positional bytes of one half: eight postings for each distinct fingerprint (copies cost nothing), 2**24 lists for each set of
positions. Within a list, each pair's shared positional bytes are counted over all eight positions; pairs with five or more are kept, and
their bits compared. What leaves a list is a spanning forest of its links, at most one row for each posting.

Lists longer than LIST are not compared pair by pair. Their fingerprints differ in the five other bytes alone; each emits every value
within two bits of it there (a centre). All fingerprints within two bits of a centre link with any one within one bit of it, so where there
is such a one they are tied to the smallest. Any two within three bits meet that way: of the way between them, one bit is
taken from the one and the others from the other. This takes 821 rows a fingerprint, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeforge.llm.bytesops import FOLD, NON_SPACE, SLICE_BYTES, Words, cut_long, joined, settle, slices
from tomeforge.llm.common import Workspace, connected_components, semi_join

SEED, BITS, WIDTH = 42, 3, 3
#: Most fingerprints of a list that are compared pair by pair.
LIST = 16_384
#: The sets of positions by which fingerprints are listed.
POSITIONS = [*combinations(range(4), WIDTH), *combinations(range(4, 8), WIDTH)]


def bit_counts(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(how many shingle hashes have each bit, number of shingles) of each text of a slice with A-Z lowered."""
    words = Words(data, off, NON_SPACE)
    out, place = joined(data, words.start, words.end)
    stop = place + words.end - words.start
    many = np.maximum(words.count - k + 1, np.minimum(words.count, 1))
    owner = np.repeat(np.arange(len(many)), many)
    begin = words.first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    end = np.minimum(begin + k, (words.first + words.count)[owner]) - 1
    raw = out.tobytes()
    h = np.fromiter((xxhash.xxh64_intdigest(raw[a:b], SEED) for a, b in zip(place[begin].tolist(), stop[end].tolist(), strict=True)), np.uint64, len(begin))
    sums = np.zeros((len(many), 64), np.int64)
    some = np.flatnonzero(many)
    if len(some):
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        sums[some] = np.add.reduceat(bits, (np.cumsum(many) - many)[some], axis=0, dtype=np.int64)
    return sums, many


def _print(sums: np.ndarray, many: np.ndarray) -> np.ndarray:
    return np.packbits(2 * sums > many[:, None], axis=1).view(">i8").ravel().astype(np.int64)


def _long_text(data: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """As bit_counts, piece by piece; each piece begins with the last k - 1 words of those before."""
    sums, many, before, at = np.zeros((1, 64), np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint8), 0
    for end in cut_long(NON_SPACE[data]):
        piece = np.concatenate([before, data[at:end]])
        words, at = Words(piece, np.array([0, len(piece)]), NON_SPACE), end
        if len(words.start) >= k:
            more, n = bit_counts(piece, np.array([0, len(piece)]), k)
            sums, many = sums + more, many + n
            piece = piece[words.start[len(words.start) - k + 1] :] if k > 1 else piece[:0]
        before = np.append(piece, np.uint8(0x20))
    return (sums, many) if many[0] else bit_counts(before, np.array([0, len(before)]), k)


def _prints(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for batch in batches:
            for i, j, data, off in slices(batch.column("text")):
                low = FOLD[data]
                sums, many = bit_counts(low, off, k) if len(data) <= SLICE_BYTES else _long_text(low, k)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], pa.array(_print(sums, many))], names=["doc_id", "print"])

    return run


def fingerprints(documents: DataFrame, k: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, print): the SimHash of every row's k-word shingles, repeats included, as a signed 64-bit number.

    Words are runs of non-white-space with A-Z lowered; a text of fewer than k words is one shingle; a null text or one without words has
    print 0. A bit is set if more than half of the shingles' XXH64 hashes (seed 42) have it.
    """
    from tomeforge.runtime import ship

    ship(documents.sparkSession)
    docs = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return docs.mapInArrow(_prints(k), "doc_id long, print long")


def _byte(p: int) -> F.Column:
    return F.shiftrightunsigned("print", 8 * (7 - p)).bitwiseAND(F.lit(255))


def _posting(positions: tuple[int, ...], number: int) -> F.Column:
    value = F.lit(number).cast("long")
    for p in positions:
        value = value * 256 + _byte(p)
    return value


def linked(prints: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (print, smallest print of its tree in the list) of the links within each list; lists: sorted."""
    n = len(prints)
    bytes_ = prints.astype(np.int64).view(np.uint8).reshape(-1, 8)
    size = np.diff(np.append(np.flatnonzero(np.append(True, lists[1:] != lists[:-1])[:n]), n))
    room = np.repeat(np.cumsum(size), size) - np.arange(n)  # entries of the list from this one on
    one, two = [], []
    for step in range(1, int(size.max(initial=1))):
        a = np.flatnonzero(room > step)
        shared = (bytes_[a] == bytes_[a + step]).sum(1)
        a = a[shared >= 8 - BITS]
        a = a[np.bitwise_count((prints[a] ^ prints[a + step]).view(np.uint64)) <= BITS]
        one.append(a)
        two.append(a + step)
    if not one:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    one, two = np.concatenate(one), np.concatenate(two)
    label = np.arange(n)
    while True:
        least = label.copy()
        np.minimum.at(least, one, label[two])
        np.minimum.at(least, two, label[one])
        least = least[least]
        if (least == label).all():
            break
        label = least
    hit = np.flatnonzero(label != np.arange(n))
    return prints[hit], prints[label[hit]]


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by list and print; a list that a batch doesn't end is carried on."""
    lists, prints = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        lists, prints = np.append(lists, batch.column("list").to_numpy()), np.append(prints, batch.column("print").to_numpy())
        end = int(np.searchsorted(lists, lists[-1])) if len(lists) else 0
        a, b = linked(prints[:end], lists[:end])
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        lists, prints = lists[end:], prints[end:]
    a, b = linked(prints, lists)
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _centres(numbers: np.ndarray, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(difference from the print, number of bits) of each centre of a list's fingerprints, for each set of positions."""
    for number in np.unique(numbers).tolist():
        free = [8 * (7 - p) + b for p in range(8) if p not in POSITIONS[number] for b in range(8)]
        masks = [0, *(1 << x for x in free), *((1 << x) | (1 << y) for x, y in combinations(free, 2))]
        for mask in masks:
            yield number, np.uint64(mask).view(np.int64), mask.bit_count()


def _within_two(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists, prints = batch.column("list").to_numpy(), batch.column("print").to_numpy()
        numbers = lists >> 24
        for number, mask, bits in _centres(numbers, prints):
            own = numbers == number
            yield pa.RecordBatch.from_arrays([pa.array(lists[own]), pa.array(prints[own] ^ mask), pa.array(prints[own]), pa.array(np.full(int(own.sum()), bits <= 1))], names=["list", "centre", "print", "near"])


def near_fingerprints(prints: DataFrame, ws: Workspace, list_limit: int = LIST) -> DataFrame:
    """(node, root) of every fingerprint of the distinct ones in prints (print) that links with another: the smallest one reachable.

    Two link if they differ in at most BITS bits."""
    posted = prints.select(F.posexplode(F.array(*(_posting(p, i) for i, p in enumerate(POSITIONS)))).alias("number", "list"), "print").select("list", "print")
    posted = ws.save(posted, "postings")
    sizes = ws.save(posted.groupBy("list").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "sizes")
    long_lists = sizes.filter(F.col("n") > list_limit).select("list")
    n_long = long_lists.count()
    short = posted.join(sizes.filter(F.col("n") <= list_limit).select("list"), "list", "left_semi")
    edges = short.repartition("list").sortWithinPartitions("list", "print").mapInArrow(_lists, "a long, b long")
    if n_long:
        long = semi_join(posted, long_lists, "list", n_long)
        around = ws.save(long.mapInArrow(_within_two, "list long, centre long, print long, near boolean"), "around")
        least = ws.save(around.filter("near").groupBy("list", "centre").agg(F.min("print").alias("least")), "least")
        edges = edges.unionByName(around.join(least, ["list", "centre"]).filter("print <> least").select(F.col("print").alias("a"), F.col("least").alias("b")))
    edges = ws.save(edges.distinct(), "edges")
    return connected_components(ws, edges, "prints")


def near_duplicates(documents: DataFrame, k: int = 3, text: str = "text", key: str = "doc_id", list_limit: int = LIST) -> DataFrame:
    """One row per row of documents: doc_id, print (signed 64-bit fingerprint), component_id (smallest doc_id reachable by links).

    Rows link if their fingerprints differ in at most three bits, equal ones among them; rows without words have fingerprint 0 and link
    like any other. Rows that repeat a doc_id, or have none, count as documents of their own; a component of null doc_ids alone has
    null. An empty table gives no rows; other columns are ignored. A long text is worked through in pieces.
    """
    ws = Workspace(documents.sparkSession, "simhash")
    rows = ws.save(fingerprints(documents, k, text, key), "rows")
    prints = ws.save(rows.groupBy("print").agg(F.min("doc_id").alias("least")), "distinct")
    roots = near_fingerprints(prints.select("print"), ws, list_limit)
    prints = ws.save(prints.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print")), "rooted")
    names = prints.groupBy("root").agg(F.min("least").alias("component_id"))
    named = ws.save(prints.join(names, "root").select("print", "component_id"), "named")
    return rows.join(named, "print").select("doc_id", "print", "component_id")
