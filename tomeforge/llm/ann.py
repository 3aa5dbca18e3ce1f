"""Approximate nearest neighbours by cosine: an NN-descent graph and greedy search on it.

Equal vectors are one node, so a vector that very many rows share makes no hot group. The graph starts from a weak guess: nodes that
fall on the same side of random hyperplanes, in small groups. Then NN-descent: in each round a node's
neighbours and reverse neighbours meet ("a neighbour of a neighbour is likely a neighbour"), each keeps its
nearest, and pairs of edges that have met before don't meet again; rounds go on until one changes few edges. Queries walk the graph
from their own node, always expanding the nearest unexpanded nodes. The path is the same at every size. Vectors of
different lengths never meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomeforge.llm.bytesops import settle
from tomeforge.llm.common import Workspace

#: Edges of a node; reverse edges, new and old each, that take part in a round.
DEGREE, REVERSE = 20, 16
#: Random partitions that the graph starts from, and nodes of a group in them, about.
TREES, GROUP = 4, 48
#: Descent ends after a round that changed less than this share of the edges.
CHANGED = 0.003
#: Nodes that a query keeps; nodes that it expands in a step. A walk ends when no node that it keeps is unexpanded.
BEAM, EXPAND = 200, 80
#: Vectors that one call of a round holds, about.
CALL = 16_000

_EDGES = "node long, other long, near float"


def unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(1, keepdims=True)  # squares of very large or small components stay finite
    x = x / top
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def decoded(column: pa.Array, kind: str) -> np.ndarray:
    """The vectors of one length of a binary column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, kind).reshape(len(column), -1) if len(column) else np.zeros((0, 1), kind)


def _by_length(size: np.ndarray) -> Iterator[np.ndarray]:
    for n in np.unique(size):
        yield np.flatnonzero(size == n)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, dim, exact, unit): the vector as given and, of length one, in single precision."""
    for batch in batches:
        values = batch.column(1)
        size = np.diff(values.offsets.to_numpy())
        flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        first = np.cumsum(size) - size
        for own in _by_length(size):
            x = flat[first[own][:, None] + np.arange(size[own[0]])]
            u = unit(x).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), pa.array(size[own].astype(np.int32)), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in u], pa.binary())], names=["node", "dim", "exact", "unit"])


def _sides(bits: dict[int, int], trees: int, seed: int):
    """(node, tree, code) by the sides of random hyperplanes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for own in _by_length(dims):
                dim, n = int(dims[own[0]]), len(own)
                planes = np.random.default_rng([seed, dim]).normal(size=(dim, max(1, bits[dim] * trees))).astype(np.float32)
                side = decoded(batch.column(2).take(pa.array(own)), "<f4") @ planes > 0
                for t in range(trees):
                    code = side[:, t * bits[dim] : (t + 1) * bits[dim]] @ (1 << np.arange(bits[dim], dtype=np.int64)) if bits[dim] else np.zeros(n, np.int64)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, t, np.int64)), pa.array(code.astype(np.int64))], names=["node", "dim", "tree", "code"])

    return run


def _nearest(node: np.ndarray, other: np.ndarray, near: np.ndarray, k: int) -> np.ndarray:
    """Places of the k nearest distinct others of each node."""
    order = np.lexsort((other, -near, node))
    if not len(order):
        return order
    n, o = node[order], other[order]
    fresh = np.append(True, (n[1:] != n[:-1]) | (o[1:] != o[:-1]))
    order, n = order[fresh], n[fresh]
    first = np.flatnonzero(np.append(True, n[1:] != n[:-1]))
    rank = np.arange(len(n)) - np.repeat(first, np.diff(np.append(first, len(n))))
    return order[rank < k]


def _meet(k: int, first: bool):
    """Within each group: pairs with a new member that beat what a node has; at the start all pairs of the small groups."""

    def run(table: pa.Table) -> pa.Table:
        settle()
        group, node = table["group"].to_numpy(), table["node"].to_numpy()
        fresh = np.ones(len(node), bool) if first else table["fresh"].to_numpy(zero_copy_only=False)
        worst = np.full(len(node), -2.0, np.float32) if first else table["worst"].to_numpy().astype(np.float32)
        units, order = table["unit"].combine_chunks(), np.argsort(group, kind="stable")
        cut = np.flatnonzero(np.append(True, group[order][1:] != group[order][:-1])) if len(order) else np.zeros(0, np.int64)
        a, b, s = [], [], []
        for x, y in zip(cut.tolist(), np.append(cut[1:], len(order)).tolist(), strict=True):
            own = order[x:y]
            if len(own) < 2:
                continue
            vectors = decoded(units.take(pa.array(own)), "<f4")
            near = vectors @ vectors.T
            good = (node[own][:, None] != node[own][None, :]) & (near > worst[own][:, None]) & (fresh[own][:, None] | fresh[own][None, :])
            i, j = np.nonzero(good)
            a.append(node[own][i])
            b.append(node[own][j])
            s.append(near[i, j])
        if not a:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float32())], names=["node", "other", "near"])
        a, b, s = np.concatenate(a), np.concatenate(b), np.concatenate(s)
        keep = _nearest(a, b, s, k)
        return pa.table([pa.array(a[keep]), pa.array(b[keep]), pa.array(s[keep])], names=["node", "other", "near"])

    return run


def _keep(k: int):
    def run(table: pa.Table) -> pa.Table:
        node, other, near, fresh = (table[c].to_numpy(zero_copy_only=False) if c == "fresh" else table[c].to_numpy() for c in ("node", "other", "near", "fresh"))
        order = np.lexsort((fresh, other, node))  # an edge that was there before stays known as such
        n, o = node[order], other[order]
        order = order[np.append(True, (n[1:] != n[:-1]) | (o[1:] != o[:-1]))] if len(order) else order
        keep = order[_nearest(node[order], other[order], near[order], k)] if len(order) else order
        return pa.table([pa.array(node[keep]), pa.array(other[keep]), pa.array(near[keep]), pa.array(fresh[keep])], names=["node", "other", "near", "fresh"])

    return run


def _best(edges: DataFrame, k: int, calls: int) -> DataFrame:
    """The k nearest distinct others of each node."""
    keyed = edges.select("node", "other", "near", "fresh", F.pmod(F.xxhash64("node"), F.lit(calls)).alias("call"))
    return keyed.groupBy("call").applyInArrow(_keep(k), _EDGES + ", fresh boolean")


def build_graph(ws: Workspace, nodes: DataFrame, dims: dict[int, int], degree: int = DEGREE, changed: float = CHANGED, seed: int = 3) -> DataFrame:
    """(node, other, near): each node's nearest found; nodes: (node, dim, unit); dims: nodes of each length. Rounds go on as long as they
    change enough edges."""
    n, tasks = sum(dims.values()), int(ws.spark.conf.get("spark.sql.shuffle.partitions"))
    bits = {d: max(0, round(math.log2(m / GROUP))) for d, m in dims.items()}
    sides = ws.save(nodes.select("node", "dim", "unit").mapInArrow(_sides(bits, TREES, seed), "node long, dim int, tree long, code long"), "sides")
    sizes = sides.groupBy("dim", "tree", "code").agg(F.count(F.lit(1)).alias("size"))
    grouped = sides.join(sizes, ["dim", "tree", "code"])  # a crowded side is dealt into groups of bounded size
    grouped = grouped.select("node", F.xxhash64("dim", "tree", "code", F.pmod(F.xxhash64("node", "tree"), F.ceil(F.col("size") / (2 * GROUP)))).alias("group"))
    vectors = nodes.select("node", "unit")
    calls = max(tasks, n * TREES // CALL)
    met = grouped.join(vectors, "node").withColumn("call", F.pmod(F.xxhash64("group"), F.lit(calls))).groupBy("call").applyInArrow(_meet(degree, True), _EDGES)
    lists = max(tasks, n // 4000)
    edges = ws.save(_best(met.withColumn("fresh", F.lit(True)), degree, lists), "edges-0")
    calls = max(tasks, n * (degree + REVERSE) // CALL)
    for step in count(1):
        worst = edges.groupBy("node").agg(F.min("near").alias("worst"), F.count(F.lit(1)).alias("n"))
        held = vectors.join(worst, "node", "left").select("node", "unit", F.when(F.col("n") >= degree, F.col("worst")).otherwise(-2.0).cast("float").alias("worst"))
        sample = F.row_number().over(Window.partitionBy("group", "fresh").orderBy(F.xxhash64("node", "group", F.lit(step))))
        back = edges.select(F.col("other").alias("group"), "node", "fresh").withColumn("rank", sample).filter(F.col("rank") <= REVERSE).drop("rank")
        members = edges.select(F.col("node").alias("group"), F.col("other").alias("node"), "fresh").unionByName(back)
        members = members.groupBy("group", "node").agg(F.max("fresh").alias("fresh"))
        members = members.withColumn("any", F.max("fresh").over(Window.partitionBy("group"))).filter("any").drop("any")  # groups of some `degree` + 2 REVERSE rows
        met = members.join(held, "node").withColumn("call", F.pmod(F.xxhash64("group"), F.lit(calls))).groupBy("call").applyInArrow(_meet(degree, False), _EDGES)
        both = edges.withColumn("fresh", F.lit(False)).unionByName(met.withColumn("fresh", F.lit(True)))
        edges = ws.save(_best(both, degree, lists), f"edges-{step}")
        ws.drop(f"edges-{step - 1}")
        total, new = edges.agg(F.count(F.lit(1)), F.count_if("fresh")).first()
        if new <= changed * total:
            break
    return edges.select("node", "other", "near")


def walkable(graph: DataFrame, most: int = 2 * DEGREE) -> DataFrame:
    """(node, other): each edge both ways, the nearest `most` of a node, so that a walk also reaches nodes which are near to what it
    found but not among the nearest of it."""
    both = graph.unionByName(graph.select(F.col("other").alias("node"), F.col("node").alias("other"), "near"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("near"), "other"))
    return both.groupBy("node", "other").agg(F.max("near").alias("near")).withColumn("rank", rank).filter(F.col("rank") <= most).select("node", "other")


def _cosine(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = batch.column("from"), batch.column("vector")
            for own in _by_length(np.fromiter(map(len, one.to_pylist()), np.int64, len(one))):
                a, b = decoded(one.take(pa.array(own)), kind).astype(np.float64), decoded(two.take(pa.array(own)), kind).astype(np.float64)
                yield pa.RecordBatch.from_arrays([batch.column("query").take(pa.array(own)), batch.column("node").take(pa.array(own)), pa.array((unit(a) * unit(b)).sum(1))], names=["query", "node", "score"])

    return run


_SCORED = "query long, node long, score double"


def search_graph(ws: Workspace, graph: DataFrame, nodes: DataFrame, queries: DataFrame, beam: int = BEAM) -> DataFrame:
    """(query, node, score): the beam once all its nodes are expanded; queries: (query, from, node), node being where the walk starts."""
    vectors = nodes.select("node", F.col("unit").alias("vector"))
    scored = lambda pairs: pairs.join(queries.select("query", "from"), "query").join(vectors, "node").select("query", "node", "from", "vector").mapInArrow(_cosine("<f4"), _SCORED)
    seen = ws.save(scored(queries.select("query", "node")).withColumn("open", F.lit(True)), "walk-0")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("open"), F.desc("score"), "node"))
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "node"))
    for step in count(1):
        marked = seen.withColumn("expand", F.col("open") & (rank <= EXPAND))
        ahead = marked.filter("expand").select("query", "node").join(graph.select("node", "other"), "node").select("query", F.col("other").alias("node")).distinct()
        ahead = ahead.join(seen.select("query", "node"), ["query", "node"], "left_anti")
        both = marked.select("query", "node", "score", (F.col("open") & ~F.col("expand")).alias("open")).unionByName(scored(ahead).withColumn("open", F.lit(True)))
        seen = ws.save(both.withColumn("best", best).filter(F.col("best") <= beam).drop("best"), f"walk-{step}")
        ws.drop(f"walk-{step - 1}")
        if not seen.filter("open").limit(1).count():
            break
    return seen.select("query", "node", "score")


def nearest_neighbours(vectors: DataFrame, queries_every: int = 50, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest rows found for each row whose key is divisible by queries_every.

    Nearest first, ties to the smaller key; score is the cosine in double precision of the vectors as given. A query's own row is no
    candidate, rows with equal vectors are. Vectors that are null, empty, all zero, or hold a null or non-finite component take no part;
    vectors of different lengths are no candidates of each other. A key that repeats counts once, with its first vector; a null key takes no
    part. An empty table gives no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    ws = Workspace(spark, "ann")
    sound = F.expr("vector is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vector, x -> x <> 0)")
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).filter("vec_id is not null").filter(F.coalesce(sound, F.lit(False)))
    rows = ws.save(rows.groupBy("vec_id").agg(F.min("vector").alias("vector")), "rows")
    # of rows with one vector only the k + 1 smallest keys can be among the k nearest; the limit is pushed before the shuffle
    place = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    members = rows.withColumn("place", place).filter(F.col("place") <= k + 1)
    members = ws.save(members.withColumn("node", F.min("vec_id").over(Window.partitionBy("vector"))), "members")
    nodes = ws.save(members.filter("place = 1").select("node", "vector").mapInArrow(_units, "node long, dim int, exact binary, unit binary"), "nodes")
    dims = {r[0]: r[1] for r in nodes.groupBy("dim").count().collect()}  # one row for each length
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    graph = ws.save(walkable(build_graph(ws, nodes, dims)), "graph")
    asked = rows.filter(F.col("vec_id") % queries_every == 0).join(members.filter("place = 1").select("vector", "node"), "vector")
    asked = ws.save(asked.select(F.col("vec_id").alias("query_id"), "node"), "asked")
    starts = asked.select("node").distinct().join(nodes, "node").select(F.col("node").alias("query"), F.col("unit").alias("from"), "node")  # equal queries walk once
    near = search_graph(ws, graph, nodes, ws.save(starts, "starts"))
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "node"))
    near = near.withColumn("best", best).filter(F.col("best") <= 2 * k + 6).select("query", "node")
    exact = nodes.select("node", "exact")
    near = near.join(exact.select(F.col("node").alias("query"), F.col("exact").alias("from")), "query").join(exact.withColumnRenamed("exact", "vector"), "node")
    near = near.select("query", "node", "from", "vector").mapInArrow(_cosine("<f8"), _SCORED)
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    found = near.join(members.select("node", "vec_id"), "node").withColumn("best", best).filter(F.col("best") <= k + 1).select("query", "vec_id", "score")
    answers = asked.select("query_id", F.col("node").alias("query")).join(found, "query").filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return ws.save(answers.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "answers")
