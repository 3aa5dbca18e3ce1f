"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), the pairwise part in linear time as
half of |sum v_i x_i|^2 - sum |v_i x_i|^2.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeforge.llm.bytesops import NON_SPACE, SLICE_BYTES, Words, byte_class, settle, slices
from tomeforge.llm.common import Workspace, ship
from tomeforge.llm.langid import held_out

BUCKETS, RANK, BINS = 1 << 15, 8, 12
#: Labelled texts to learn from, about, each taken whole: a text has a number of features that its length does not change beyond BUCKETS.
LEARN_TEXTS = 6000
#: Features of all these texts together, at most: what the driver holds (some 100 MB). Texts are taken in the order of a hash of doc_id.
LEARN_FEATURES = 8_000_000
EPOCHS, RATE, DECAY = 12, 0.08, 1e-5
_CLASSES = {
    "upper": byte_class((0x41, 0x5A)),
    "lower": byte_class((0x61, 0x7A)),
    "digit": byte_class((0x30, 0x39)),
    "stop": byte_class((0x2C, 0x2C), (0x2E, 0x2E)),
    "mark": byte_class((0x21, 0x2B), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)),
    "line": byte_class((0x0A, 0x0A)),
    "wide": byte_class((0x80, 0xFF)),
}
_KIND = np.zeros(256, np.uint8)
for _k, _lut in enumerate(_CLASSES.values(), 1):
    _KIND[_lut] = _k
STATS = [*_CLASSES, "bytes", "words", "word_length", "distinct", "commonest", "n_chars"]
FEATURES = BUCKETS + BINS * len(STATS)


def features(data: np.ndarray, off: np.ndarray, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, feature, value) triples in order of doc."""
    docs = len(off) - 1
    words = Words(data, off, NON_SPACE)
    pair, count = np.unique((words.doc.astype(np.int64) * BUCKETS) + (words.hashes() % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
    doc, value = pair // BUCKETS, np.log1p(count)
    value = value / np.sqrt(np.bincount(doc, value * value, docs))[doc]
    size = np.diff(off)
    kinds = np.zeros((docs, 8))
    for a in range(0, len(data), SLICE_BYTES):  # of a long text piece by piece
        owner = np.searchsorted(off, np.arange(a, min(a + SLICE_BYTES, len(data))), "right") - 1
        kinds += np.bincount(owner * 8 + _KIND[data[a : a + SLICE_BYTES]], minlength=docs * 8).reshape(docs, 8)
    kinds = kinds[:, 1:] / np.maximum(size, 1)[:, None]
    n = words.count
    top = np.zeros(docs)
    np.maximum.at(top, doc, count)
    scale = lambda x: np.floor(np.log2(np.maximum(x, 1)) * 0.7).astype(np.int64)
    share = lambda x: np.ceil(np.sqrt(x) * (BINS - 1)).astype(np.int64)
    stats = [*(share(kinds[:, k]) for k in range(kinds.shape[1])), scale(size), scale(n), np.round(size / np.maximum(n, 1)).astype(np.int64), share(np.bincount(doc, minlength=docs) / np.maximum(n, 1)), share(top / np.maximum(n, 1)), np.where(n_chars < 0, BINS - 1, np.minimum(scale(n_chars), BINS - 2))]
    place = np.stack([BUCKETS + k * BINS + np.clip(s, 0, BINS - 1) for k, s in enumerate(stats)], 1)
    every = np.concatenate([doc, np.repeat(np.arange(docs), len(stats))])
    feature = np.concatenate([pair % BUCKETS, place.reshape(-1)])
    amount = np.concatenate([value, np.full(place.size, 0.5)])
    order = np.argsort(every, kind="stable")
    return every[order], feature[order], amount[order].astype(np.float32)


class Machine:
    def __init__(self, seed: int = 11):
        self.bias = np.float32(0)
        self.weight = np.zeros(FEATURES, np.float32)
        self.factor = np.random.default_rng(seed).normal(0, 0.02, (FEATURES, RANK)).astype(np.float32)

    def parts(self, first: np.ndarray, feature: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        vx = self.factor[feature] * value[:, None]
        total = np.add.reduceat(vx, first, axis=0)
        z = self.bias + np.add.reduceat(self.weight[feature] * value, first) + 0.5 * (total**2 - np.add.reduceat(vx * vx, first, axis=0)).sum(1)
        return z, total

    def score(self, docs: int, doc: np.ndarray, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        z, _ = self.parts(np.searchsorted(doc, np.arange(docs)), feature, value)
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -40, 40)))

    def fit(self, rows: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 5) -> Machine:
        """Logistic loss by AdaGrad; rows: (label, features, values)."""
        y = np.array([r[0] for r in rows], np.float32)
        if not len(rows):
            return self
        p = np.clip(y.mean(), 0.02, 0.98)
        self.bias = np.float32(np.log(p / (1 - p)))
        if len(np.unique(y)) < 2:
            self.factor[:] = 0
            return self
        rng, gw, gv, gb = np.random.default_rng(seed), np.full(FEATURES, 1e-6, np.float32), np.full((FEATURES, RANK), 1e-6, np.float32), 1e-6
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for a in range(0, len(rows), 64):
                own = order[a : a + 64]
                feature = np.concatenate([rows[i][1] for i in own])
                value = np.concatenate([rows[i][2] for i in own])
                size = np.array([len(rows[i][1]) for i in own])
                first = np.cumsum(size) - size
                z, total = self.parts(first, feature, value)
                d = np.repeat((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[own]) / len(own), size)
                used, at = np.unique(feature, return_inverse=True)
                step = np.bincount(at, d * value, len(used)).astype(np.float32) + DECAY * self.weight[used]
                gw[used] += step * step
                each = (d * value)[:, None] * (np.repeat(total, size, axis=0) - self.factor[feature] * value[:, None])
                self.weight[used] -= RATE * step / np.sqrt(gw[used])
                turn = np.argsort(at, kind="stable")
                grouped = np.add.reduceat(each[turn], np.searchsorted(at[turn], np.arange(len(used))), axis=0) + DECAY * self.factor[used]
                gv[used] += grouped * grouped
                self.factor[used] -= 0.5 * RATE * grouped / np.sqrt(gv[used])
                db = float((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[own]).mean())
                gb += db * db
                self.bias -= np.float32(RATE * db / np.sqrt(gb))
        return self


def _n_chars(column: pa.Array) -> np.ndarray:
    return np.array([-1 if x is None else x for x in column.to_pylist()], np.int64)


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    settle()
    for batch in batches:
        for i, j, data, off in slices(batch.column(3)):
            doc, feature, value = features(data, off, _n_chars(batch.column(2))[i:j])
            edge = np.searchsorted(doc, np.arange(j - i + 1)).tolist()
            cut = lambda x, kind: pa.array([x[a:b].astype(kind).tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())  # noqa: E731,B023
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), cut(feature, "<u4"), cut(value, "<f4"), pa.array(np.diff(edge))], names=["label", "draw", "feature", "value", "n"])


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        machine = shared.value
        for batch in batches:
            chars = _n_chars(batch.column(batch.num_columns - 2))
            for i, j, data, off in slices(batch.column(batch.num_columns - 1)):
                score = machine.score(j - i, *features(data, off, chars[i:j]))
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(score)], names=[*batch.schema.names[:-2], "score"])

    return run


def _chars(documents: DataFrame):
    return F.col("n_chars").try_cast("long") if "n_chars" in documents.columns else F.lit(None).cast("long")


def train(documents: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, texts: int = LEARN_TEXTS, most: int = LEARN_FEATURES) -> Machine:
    """From about `texts` labelled documents and `most` features at most, drawn by a hash of doc_id from all outside the held-out fold.

    A doc_id with several labels counts with the smallest; rows that repeat a doc_id are texts of their own."""
    spark = documents.sparkSession
    ws = Workspace(spark, "quality")
    known = labels.filter(~held_out(F.col("doc_id"), folds, fold) & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    step = max(1, known.count() // texts)
    drawn = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0)  # some `texts` rows
    rows = documents.select("doc_id", _chars(documents).alias("n_chars"), "text").join(F.broadcast(drawn), "doc_id")
    found = ws.save(rows.select("label", F.xxhash64("doc_id", F.lit(7)).alias("draw"), "n_chars", "text").mapInArrow(_featurise, "label int, draw long, feature binary, value binary, n long"), "features")
    total, last = 0, None
    for r in found.groupBy("draw").agg(F.sum("n").alias("n")).orderBy("draw").collect():  # some `texts` rows of two numbers
        total += r.n
        if total > most and last is not None:
            break
        last = r.draw
    taken = found.filter(F.col("draw") <= last).select("label", "feature", "value").collect() if last is not None else []
    taken.sort(key=lambda r: (r[0], bytes(r[1])))  # the order of arrival is no part of the model
    ws.drop("features")
    return Machine().fit([(r[0], np.frombuffer(r[1], "<u4").astype(np.int64), np.frombuffer(r[2], "<f4")) for r in taken])


def score(documents: DataFrame, machine: Machine, columns: tuple[str, ...] = ()) -> DataFrame:
    """The given columns and score (0 to 1) of each row.

    A null text is scored as an empty one, by its structure statistics alone; a missing n_chars has a bin of its own.
    Repeated rows are scored each for itself; an empty table gives no rows. Without labels all scores are 0.5 or nearly so.
    """
    spark = documents.sparkSession
    ship(spark)
    own = documents.select(*columns, _chars(documents).alias("__chars"), F.col("text").alias("__text"))
    schema = ", ".join([*(f"`{c}` {t}" for c, t in own.dtypes[:-2]), "score double"])
    return own.mapInArrow(_score(spark.sparkContext.broadcast(machine)), schema)


def quality_scores(documents: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of documents; edge cases as in score."""
    machine = train(documents, labels, folds, fold)
    named = documents.withColumn("held_out", held_out(F.col("doc_id"), folds, fold))
    out = score(named, machine, ("doc_id", "held_out"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
