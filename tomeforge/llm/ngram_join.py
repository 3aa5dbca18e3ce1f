"""N-gram Jaccard self-join by vertical partitioning.

The global order of all n-grams is the order of their 64-bit hashes; it is cut into fragments, and each distinct set
of n-grams (a node; copies cost nothing after the first step) into segments, one per fragment.

1. Support. If S links with T, at most (1 - t) |S| n-grams of S are missing from T, so at most that many of any part of
   the order are in no other set. The n-grams of the lower half of the order go to buckets by hash; each bucket counts, for
   each set, its n-grams that another set has, and Spark sums these counts per set. Sets with too few can't link and
   go. A 32-bit clash within a bucket only keeps a set that might have gone.
2. Candidates. Two sets of at most u n-grams and Jaccard at least t differ in at most
   D = 2u(1-t)/(1+t) n-grams. The order is cut into groups of SUBS segments; of G = D // 2 + 1 + spare groups at least spare + 1
   hold one differing n-gram at most, so that all their segments but one are equal (spare = D // SPARE_EACH grows with
   the number of empty segments to expect). Sets of like size are cut into the same G groups, and the join is on (size
   window, group, segment left out, hash of the group's other segments). No frequency limit is needed. A set of which more than
   `spare` groups have nothing but one segment is cut once more in another order of the n-grams, and a set for
   which that holds in every order also joins by what is empty: nothing is lost. Each key's sets are tied by a star to the
   smallest one, never as all pairs; the connected parts of that graph hold every link. Its vertices are (set, size window).
3. Counting. A part's sets are dealt to blocks, and the order is cut into FRAGMENTS ranges. Each (block pair,
   fragment) gets the sets' segments of that range alone and counts the partial overlaps of its pairs; they travel as one
   table of two bytes a pair. Spark brings the fragments of a block pair together, sums them per pair and keeps
   the links, as a spanning forest and a number of links for each set.

Every group that a task gets is bounded: a bucket by the volume, a cell by two blocks. What grows with the square is the number
of pairs of distinct texts within one part, two bytes a pair and fragment, as each set's links are counted exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeforge.llm.bytesops import LONG_SLICE_BYTES, NON_SPACE, Words, mix, settle, shingle_sets, slices
from tomeforge.llm.common import BROADCAST_ROWS, Workspace, connected_components

SUBS, SPARE_EACH, ORDERS = 3, 12, 3
#: Sets in a block; the ranges of the order in which overlaps are counted one by one (a power of two).
BLOCK, FRAGMENTS = 256, 4
#: The share of the order on which support is counted is one in SUPPORT; bytes of text of which a bucket holds the n-grams, and least buckets.
SUPPORT, BUCKET_BYTES, BUCKETS = 2, 64 << 20, 12


def size_windows(percent: int, top: int = 1 << 31) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping ranges of set sizes; any two sizes s <= t with 100 s >= percent t share one."""
    low, high, a = [], [], 1
    while a < top:
        b = max(100 * a // percent, int(a * (100 / percent) ** 2))
        low.append(a)
        high.append(b)
        a = max(a + 1, b * percent // 100 + 1)
    return np.array(low), np.array(high)


def signatures(sets: list[np.ndarray], nodes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, vertex) of each group of segments, leaving out one at a time, of each set in each of its size windows."""
    low, high = size_windows(percent)
    sizes = np.array([len(s) for s in sets], np.int64)
    keys, owners = [], []
    with np.errstate(over="ignore"):
        todo = [(i, w) for i, n in enumerate(sizes.tolist()) if n for w in range(int(np.searchsorted(high, n, "left")), int(np.searchsorted(low, n, "right")))]
        width = 2 * high * (100 - percent) // (100 + percent)  # most n-grams in which two sets of a window differ
        todo = [(i, w) for i, w in todo if width[w]]  # else only equal sets, which are one node
        for order in range(ORDERS):
            if not todo:
                break
            doc = np.array([i for i, _ in todo])
            window = np.array([w for _, w in todo])
            spare = width[window] // SPARE_EACH
            groups = width[window] // 2 + 1 + spare
            cuts = groups * SUBS
            parts = [sets[i] for i in doc] if not order else [np.sort(mix(sets[i] + np.uint64(order * 0x9FB21C651E98DF25 & (1 << 64) - 1))) for i in doc]
            lengths = sizes[doc]
            token = np.concatenate(parts)
            fragment = ((token >> np.uint64(32)) * np.repeat(cuts, lengths).astype(np.uint64)) >> np.uint64(32)
            place = np.repeat(np.cumsum(cuts) - cuts, lengths) + fragment.astype(np.int64)
            first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
            total, filled = np.zeros(int(cuts.sum()), np.uint64), np.zeros(int(cuts.sum()), np.int64)
            total[place[first]] = np.add.reduceat(mix(token), first)
            filled[place[first]] = np.diff(np.append(first, len(token)))
            total, filled = total.reshape(-1, SUBS), filled.reshape(-1, SUBS)
            where = np.repeat(np.arange(len(todo)), groups)
            group = np.arange(len(where)) - np.repeat(np.cumsum(groups) - groups, groups)
            vertex = (nodes[doc] ^ (window * VERTEX))[where]
            rest, left = total.sum(1)[:, None] - total, filled.sum(1)[:, None] - filled
            odd = np.bincount(where[(left == 0).any(1)], minlength=len(todo)) > spare
            for out in range(SUBS):
                tag = mix(window[where].astype(np.uint64) * np.uint64(1 << 32) + (group * SUBS + out).astype(np.uint64) * np.uint64(ORDERS) + np.uint64(order))
                some = left[:, out] > 0
                keys.append(mix(mix(rest[some, out]) ^ tag[some] ^ (left[some, out].astype(np.uint64) << np.uint64(40))))
                owners.append(vertex[some])
                if order == ORDERS - 1:
                    none = ~some & odd[where]
                    keys.append(mix(tag[none] ^ np.uint64(0x6A09E667F3BCC909)))
                    owners.append(vertex[none])
            todo = [todo[t] for t in np.flatnonzero(odd).tolist()]
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(owners)


#: A set's vertex in a size window is node ^ (window * VERTEX); windows are fewer than 256.
VERTEX = 0x1B873593CC9E2D | 1


def node_of(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def pack_keys(keys: np.ndarray, owners: np.ndarray, buckets: int, width: int = 6) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """(bucket, keys, owners, runs) for each bucket: a key's quotient by the number of buckets in `width` bytes (longer hashes the more
    buckets there are; keys that meet by chance only add candidates), each owner once, and how many keys it has, 255 at most."""
    if not len(keys):
        return
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((owners, bucket))
    short, owners, bucket = (keys // np.uint64(buckets))[order], owners[order], bucket[order]
    short = np.ascontiguousarray(short.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    for a, b in zip(cut.tolist(), np.append(cut[1:], len(bucket)).tolist(), strict=True):
        own = owners[a:b]
        start = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        place = np.arange(b - a) - np.repeat(start, np.diff(np.append(start, b - a)))
        start = np.flatnonzero(place % 255 == 0)
        runs = np.diff(np.append(start, b - a)).astype(np.uint8)
        yield int(bucket[a]), short[a:b].tobytes(), own[start].tobytes(), runs.tobytes()


def unpack_keys(keys: bytes, owners: bytes, runs: bytes, width: int = 6) -> tuple[np.ndarray, np.ndarray]:
    short = np.frombuffer(keys, np.uint8).reshape(-1, width)
    wide = np.zeros((len(short), 8), np.uint8)
    wide[:, :width] = short
    return wide.view("<u8").ravel(), np.repeat(np.frombuffer(owners, np.int64), np.frombuffer(runs, np.uint8))


_PACKED = "bucket long, keys binary, owners binary, runs binary"


def _packed(keys: np.ndarray, owners: np.ndarray, buckets: int, width: int) -> pa.RecordBatch:
    packed = list(pack_keys(keys, owners, buckets, width))
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in packed], pa.int64()), *[pa.array([p[c] for p in packed], pa.binary()) for c in (1, 2, 3)]], names=["bucket", "keys", "owners", "runs"])


def _unpacked(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    return unpack_keys(*(b"".join(table[c].to_pylist()) for c in ("keys", "owners", "runs")), width)


def lower_part(s: np.ndarray) -> int:
    """How many n-grams of a sorted set lie in the first of the order's SUPPORT parts."""
    return int(np.searchsorted(s, np.uint64((1 << 64) // SUPPORT)))


def _sets(k: int):
    """(doc_id, mark, n, low, node) of each document; low: its n-grams in the part of the order on which support is counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for batch in batches:
            for i, j, data, off in slices(batch.column(2), LONG_SLICE_BYTES):
                sets = shingle_sets(Words(data, off, NON_SPACE), k)
                n = [len(s) for s in sets]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns[:2], pa.array(n, pa.int64()), pa.array([lower_part(s) for s in sets], pa.int64()), pa.array([node_of(s) if len(s) else None for s in sets], pa.int64())], names=["doc_id", "mark", "n", "low", "node"])

    return run


def _support_keys(k: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        seen: set[int] = set()  # copies within a task send their n-grams once
        for batch in batches:
            for _, _, data, off in slices(batch.column(0), LONG_SLICE_BYTES):
                keys, owners, sizes = [], [], []
                for s in shingle_sets(Words(data, off, NON_SPACE), k):
                    if len(s) and (node := node_of(s)) not in seen:
                        if len(seen) >= 1_000_000:
                            seen.clear()
                        seen.add(node)
                        keys.append(s[: lower_part(s)])
                        owners.append(node)
                        sizes.append(len(keys[-1]))
                if keys:
                    yield _packed(mix(np.concatenate(keys)), np.repeat(np.array(owners, np.int64), sizes), buckets, 4)

    return run


def _support(table: pa.Table) -> pa.Table:
    """(node, shared): how many of its n-grams in this bucket another set has."""
    keys, owners = _unpacked(table, 4)
    order = np.lexsort((owners, keys))
    keys, owners = keys[order], owners[order]
    fresh = np.append(True, (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])) if len(keys) else np.zeros(0, bool)
    keys, owners = keys[fresh], owners[fresh]
    same = keys[1:] == keys[:-1]
    shared = np.append(same, False) | np.append(False, same) if len(keys) else fresh
    node, n = np.unique(owners[shared], return_counts=True)
    return pa.table([pa.array(node), pa.array(n.astype(np.int64))], names=["node", "shared"])


def _grams(k: int, percent: int):
    """(node, n, copies, first and last size window, grams) of the wanted documents; a text that only shares a doc_id and a mark
    with a wanted one is left out, and rows that repeat give one row a task."""
    lows, highs = size_windows(percent)
    names = ["node", "n", "copies", "first", "last", "grams"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        seen: set[int] = set()
        for batch in batches:
            for i, j, data, off in slices(batch.column(3), LONG_SLICE_BYTES):
                part, keep = batch.slice(i, j - i), []
                sets = shingle_sets(Words(data, off, NON_SPACE), k)
                for s, x in zip(sets, part.column(0).to_pylist(), strict=True):
                    keep.append(x not in seen and len(s) > 0 and node_of(s) == x)
                    if keep[-1]:
                        seen.add(x)
                n = part.column(1).to_numpy()
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(np.searchsorted(highs, n, "left")), pa.array(np.searchsorted(lows, n, "right") - 1), pa.array([s.tobytes() for s in sets], pa.binary())], names=names).filter(pa.array(keep, pa.bool_()))

    return run


def _candidate_keys(percent: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            for i, j, data, off in slices(batch.column(1), LONG_SLICE_BYTES):
                grams, at = np.ascontiguousarray(data).view(np.uint64), off // 8
                sets = [grams[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield _packed(*signatures(sets, nodes[i:j], percent), buckets, 6)

    return run


def _tie(table: pa.Table) -> pa.Table:
    """Of the sets that share a key, each is tied to the smallest."""
    keys, owners = _unpacked(table, 6)
    order = np.argsort(keys, kind="stable")
    keys, owners = keys[order], owners[order]
    pair = np.zeros((2, 0), np.int64)
    if len(keys):
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        least = np.repeat(np.minimum.reduceat(owners, first), np.diff(np.append(first, len(keys))))
        pair = np.unique(np.stack([owners, least])[:, owners != least], axis=1)
    return pa.table([pa.array(pair[0]), pa.array(pair[1])], names=["a", "b"])


def segments(s: np.ndarray) -> list[np.ndarray]:
    """A sorted set cut into the FRAGMENTS ranges of the order."""
    edges = np.array([f * ((1 << 64) // FRAGMENTS) for f in range(1, FRAGMENTS)], np.uint64)
    return np.split(s, np.searchsorted(s, edges))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with its set's segment of every fragment in turn."""
    for batch in batches:
        cut = [segments(np.frombuffer(x, np.uint64)) for x in batch.column("grams").to_pylist()]
        rest = batch.drop_columns(["grams"])
        for f in range(FRAGMENTS):
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(np.full(len(cut), f, np.int32)), pa.array([c[f].tobytes() for c in cut], pa.binary())], names=[*rest.schema.names, "fragment", "segment"])


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all the segments of a cell."""
    token = np.concatenate(sets)
    out = np.zeros((len(sets), len(sets)), np.float32)
    if not len(token):
        return out.astype(np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    fresh = np.append(True, token[1:] != token[:-1])
    rank = np.cumsum(fresh) - 1
    shared = np.bincount(rank)[rank] > 1
    rank, owner = rank[shared], owner[shared]
    if len(rank):
        rank = np.cumsum(np.append(True, rank[1:] != rank[:-1])) - 1
        for f in range(0, int(rank[-1]) + 1, 4096):  # bounded matrices
            a, b = np.searchsorted(rank, [f, f + 4096])
            part = np.zeros((len(sets), int(rank[b - 1]) - f + 1), np.float32)
            part[owner[a:b], rank[a:b] - f] = 1
            out += part @ part.T
    return out.astype(np.int64)


def _cells(*columns: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The order that brings rows of one cell together, and each cell's range in it."""
    order = np.lexsort(columns[::-1])
    if not len(order):
        return order, []
    same = np.ones(len(order) - 1, bool)
    for c in columns:
        same &= c[order][1:] == c[order][:-1]
    cut = np.flatnonzero(np.append(True, ~same))
    return order, list(zip(cut.tolist(), np.append(cut[1:], len(order)).tolist(), strict=True))


_PARTIAL = "part long, window long, one long, two long, fragment int, sets binary, counts binary"


def _partial(table: pa.Table) -> pa.Table:
    """The partial overlaps of each cell (part, block pair, fragment): of the first block's sets (all, if there is one block) with the second's.

    sets: node, n, low, copies and block of each set in order of node; counts: a little-endian number of two bytes for each pair,
    or of four where a segment is longer.
    """
    cell = [table[c].to_numpy() for c in ("part", "one", "two", "fragment")]
    facts = np.stack([table[c].to_numpy() for c in ("node", "n", "first", "copies", "block", "window")], axis=1).astype(np.int64) if table.num_rows else np.zeros((0, 6), np.int64)
    segment, out = table["segment"], []
    order, cells = _cells(*cell)
    for a, b in cells:
        rows = order[a:b]
        rows = rows[np.unique(facts[rows, 0], return_index=True)[1]]  # a row that repeats brings its node again
        if len(rows) < 2:
            continue
        part, one, two, fragment = (int(c[rows[0]]) for c in cell)
        left, right = rows[facts[rows, 4] == one], rows[facts[rows, 4] == two]
        if not len(left) or not len(right):
            continue
        both = left if one == two else np.concatenate([left, right])
        found = overlaps([np.frombuffer(segment[int(i)].as_py(), np.uint64) for i in both])
        found = found if one == two else found[: len(left), len(left) :]
        wide = found.max(initial=0) >= 1 << 16
        out.append((part, int(facts[rows[0], 5]), one, two, fragment, facts[both, :5].tobytes(), found.astype("<u4" if wide else "<u2").tobytes()))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
    return pa.table([pa.array([x[c] for x in out], kind) for c, kind in enumerate(kinds)], names=["part", "window", "one", "two", "fragment", "sets", "counts"])


def _summed(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Sums the fragments of each block pair; (a, b, links): a's smallest set among those linked here, and how many documents a links with."""
        cell = [table[c].to_numpy() for c in ("part", "one", "two")]
        window, out_node, out_root, out_links = table["window"].to_numpy(), [], [], []
        order, cells = _cells(*cell)
        for a, b in cells:
            rows = order[a:b].tolist()
            one, two = int(cell[1][rows[0]]), int(cell[2][rows[0]])
            facts = np.frombuffer(table["sets"][rows[0]].as_py(), np.int64).reshape(-1, 5)
            is_left = facts[:, 4] == one
            left, right = (facts, facts) if one == two else (facts[is_left], facts[~is_left])
            common = np.zeros((len(left), len(right)), np.int64)
            for r in rows:
                raw = table["counts"][r].as_py()
                common += np.frombuffer(raw, "<u2" if len(raw) == 2 * common.size else "<u4").reshape(common.shape)
            linked = 100 * common >= percent * (left[:, 1][:, None] + right[:, 1][None, :] - common)
            linked &= np.maximum(left[:, 2][:, None], right[:, 2][None, :]) == window[rows[0]]  # once: in the first window of both
            if one == two:
                np.fill_diagonal(linked, False)
            if not linked.any():
                continue
            top, side = np.arange(len(left)), np.arange(len(right)) + (0 if one == two else len(left))
            node = np.concatenate([left[:, 0], right[:, 0]]) if one != two else left[:, 0]
            label = np.arange(len(node))
            while True:  # smallest label among the linked, to the end
                least = label.copy()
                least[top] = np.minimum(least[top], np.where(linked, label[side][None, :], len(node)).min(1))
                least[side] = np.minimum(least[side], np.where(linked, label[top][:, None], len(node)).min(0))
                least = least[least]
                if (least == label).all():
                    break
                label = least
            links = np.zeros(len(node), np.int64)
            links[top] += (linked * right[:, 3][None, :]).sum(1)
            if one != two:
                links[side] += (linked * left[:, 3][:, None]).sum(0)
            hit = np.flatnonzero(links)
            out_node.append(node[hit])
            out_root.append(node[label[hit]])
            out_links.append(links[hit])
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.table([pa.array(cat(out_node)), pa.array(cat(out_root)), pa.array(cat(out_links))], names=["a", "b", "links"])

    return run


def ngram_jaccard_join(documents: DataFrame, k: int = 4, percent: int = 85, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links), n_links, mark, component.

    Two documents link when 100 * |A & B| >= percent * |A | B| over their distinct k-word shingles
    (words: runs of non-white-space, A-Z lowered; a shorter text is one shingle). A null or empty text or
    one without words has no shingles, no links and itself as component. n_links counts linked documents, copies among
    them. Rows that repeat a doc_id, or have none, count as documents of their own; a component of null doc_ids alone has null as
    its id. mark is xxhash64 of the text, component the same for all rows of a component and for no others (null without shingles):
    with these, callers tell rows of one doc_id apart. An empty table gives no rows. Other columns are ignored.
    """
    spark = documents.sparkSession
    ws = Workspace(spark, "ngram_join")
    docs = documents.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("mark"), F.col(text).alias("text"))
    volume = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(tasks, int(volume // (20 << 20)) + 1)
    rows = ws.save(docs.mapInArrow(_sets(k), "doc_id long, mark long, n long, low long, node long"), "rows")
    sets = rows.filter("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "mark")).alias("of"), F.first("n").alias("n"), F.first("low").alias("low"), F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"))
    sets = ws.save(sets, "sets")
    counters = max(BUCKETS, int(volume // BUCKET_BYTES) + 1)  # a set sends a count from each at most, whatever the number of tasks
    shared = docs.select("text").mapInArrow(_support_keys(k, counters), _PACKED).groupBy("bucket").applyInArrow(_support, "node long, shared long")
    shared = shared.groupBy("node").agg(F.sum("shared").alias("shared"))
    missing = F.col("low") - F.coalesce("shared", F.lit(0))
    alive = sets.join(shared, "node", "left").filter(100 * missing <= (100 - percent) * F.col("n"))
    alive = ws.save(alive.select("node", "n", "copies", F.col("of.doc_id").alias("id"), F.col("of.mark").alias("its_mark")), "alive")
    n_alive = alive.count()
    wanted = F.broadcast(alive) if n_alive <= BROADCAST_ROWS else alive.hint("merge")
    fetched = docs.join(wanted, (F.col("mark") == F.col("its_mark")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("node", "n", "copies", "text")
    grams = ws.save(fetched.mapInArrow(_grams(k, percent), "node long, n long, copies long, first long, last long, grams binary"), "grams")
    ties = grams.select("node", "grams").mapInArrow(_candidate_keys(percent, buckets), _PACKED).groupBy("bucket").applyInArrow(_tie, "a long, b long")
    parts = ws.save(connected_components(ws, ws.save(ties, "ties"), "parts"), "parts")
    placed = grams.drop("grams").distinct().withColumn("window", F.explode(F.sequence("first", "last"))).withColumn("vertex", F.col("node").bitwiseXOR(F.col("window") * F.lit(VERTEX)))
    placed = placed.join(parts.select(F.col("node").alias("vertex"), F.col("root").alias("part")), "vertex")
    blocks = parts.groupBy(F.col("root").alias("part")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks"))
    placed = placed.join(blocks, "part").withColumn("block", F.pmod(F.xxhash64("node"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cells = ws.save(placed.select("node", "part", "window", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "first", "n", "copies", "block"), "cells")
    calls = max(tasks, FRAGMENTS * cells.count() // 4000)
    call = lambda *c: F.pmod(F.xxhash64(*c), F.lit(calls))
    cut = cells.join(grams.select("node", "grams"), "node").mapInArrow(_cut, "node long, part long, window long, one long, two long, first long, n long, copies long, block long, fragment int, segment binary")
    partial = cut.withColumn("call", call("part", "one", "two", "fragment")).groupBy("call").applyInArrow(_partial, _PARTIAL)
    counted = partial.withColumn("call", call("part", "one", "two")).groupBy("call").applyInArrow(_summed(percent), "a long, b long, links long")
    counted = ws.save(counted, "counted")
    roots = connected_components(ws, counted.select("a", "b"), "links")
    links = counted.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    nodes = sets.select("node", "copies", "least").join(links, "node", "left").join(roots, "node", "left").withColumn("component", F.coalesce("root", "node"))
    nodes = ws.save(nodes.select("node", "least", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links")), "nodes")
    least = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = nodes.join(least, "component").select("node", "component", "component_id", "n_links")
    out = rows.join(named, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "mark", "component")
    out = ws.save(out, "out")
    ws.drop("rows", "sets", "alive", "grams", "ties", "parts", "cells", "counted", "nodes")
    return out
