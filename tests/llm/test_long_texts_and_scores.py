"""Texts over a megabyte in the operators on words, quality scores by their definition, repeated labels."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tomeforge.llm import bytesops, common, decontaminate, ngram_join, quality


@pytest.fixture(scope="module")
def long():
    rng = random.Random(2)
    words = [f"w{i}é" for i in range(40_000)]
    text = " ".join(rng.choice(words) for _ in range(260_000))
    assert len(text.encode()) > 1_900_000
    return text


def flat(*texts):
    return bytesops.flat(pa.array(texts, pa.string()))


def test_word_hashes_do_not_depend_on_their_place(long, monkeypatch):
    data, off = flat("Xy " + long[:5000], "xy", "a" * 3000 + " b")
    words = bytesops.Words(data, off, bytesops.NON_SPACE)
    whole = words.hashes()
    for size in (1, 7, 100, 1 << 12):
        monkeypatch.setattr(bytesops, "SLICE_BYTES", size)
        assert (words.hashes() == whole).all()
    texts = [data[a:b].tobytes().lower() for a, b in zip(words.start.tolist(), words.end.tolist(), strict=True)]
    assert len(set(whole.tolist())) == len(set(texts)) and len({*zip(texts, whole.tolist(), strict=True)}) == len(set(texts))


def test_join_of_long_texts(spark, long):
    w = long.split(" ")
    near = [*w[:1000], "other", *w[1001:]]
    rows = [(1, long), (2, " ".join(near)), (3, " ".join(w[:130_000])), (4, long), (5, "short one")]
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    n = lambda x: len({tuple(x[i : i + 4]) for i in range(len(x) - 3)})
    assert out == {1: (n(w), 1), 2: (n(near), 1), 3: (n(w[:130_000]), 3), 4: (n(w), 1), 5: (1, 5)}


def test_contamination_of_long_texts(spark, long):
    w = long.split(" ")
    items = [("a", " ".join(w[200_000:200_020])), ("b", " ".join(w[-13:])), ("c", "never there")]
    out = decontaminate.contamination(spark.createDataFrame([(1, long), (2, long + " never there")], "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == {1: (260_000, 33, 2, sha("a,b"), False), 2: (260_002, 35, 3, sha("a,b,c"), False)}


def plain_features(text, n_chars):
    """The features of one text by their definition."""
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    bucket = lambda w: int(bytesops.Words(*flat(w.decode()), bytesops.NON_SPACE).hashes()[0] % np.uint64(quality.BUCKETS))
    counts: dict[int, int] = {}
    for w in words:
        counts[bucket(w)] = counts.get(bucket(w), 0) + 1
    norm = math.sqrt(sum(math.log1p(c) ** 2 for c in counts.values()))
    out = {b: math.log1p(c) / norm for b, c in counts.items()}
    kind = [sum(1 for b in raw if lut[b]) / max(1, len(raw)) for lut in quality._CLASSES.values()]
    share = lambda x: math.ceil(math.sqrt(x) * (quality.BINS - 1))
    scale = lambda x: math.floor(math.log2(max(x, 1)) * 0.7)
    n = len(words)
    stats = [*map(share, kind), scale(len(raw)), scale(n), round(len(raw) / max(n, 1)), share(len(counts) / max(n, 1)), share(max(counts.values(), default=0) / max(n, 1)), quality.BINS - 1 if n_chars is None else min(scale(n_chars), quality.BINS - 2)]
    return out | {quality.BUCKETS + k * quality.BINS + min(max(s, 0), quality.BINS - 1): 0.5 for k, s in enumerate(stats)}


def test_scores_by_their_definition(spark, monkeypatch):
    """Every pair of features in turn, against the sum-of-squares identity."""
    monkeypatch.setattr(quality, "RANK", 3)
    rng = random.Random(4)
    machine = quality.Machine(3)
    gen = np.random.default_rng(9)
    machine.bias, machine.weight, machine.factor = np.float32(0.3), gen.normal(0, 0.5, quality.FEATURES).astype(np.float32), gen.normal(0, 0.4, (quality.FEATURES, 3)).astype(np.float32)
    rows = [(i, " ".join(rng.choice(["Good", "bad,", "7", "é", "x" * 30, "the", "\n"]) for _ in range(rng.randint(0, 25))), rng.choice([None, 0, 5, 10**6])) for i in range(25)] + [(90, None, None), (91, "", 0), (91, "", 0), (None, "a b", 3)]
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.score) for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string, n_chars long"), machine, ("doc_id",)).collect()))
    want = []
    for i, text, n in rows:
        x = list(plain_features(text, n).items())
        z = float(machine.bias) + sum(float(machine.weight[f]) * v for f, v in x)
        z += sum(float(machine.factor[f].astype(float) @ machine.factor[g].astype(float)) * v * u for k, (f, v) in enumerate(x) for g, u in x[:k])
        want.append((i is None, i or 0, 1 / (1 + math.exp(-z))))
    assert [g[:2] for g in got] == [w[:2] for w in sorted(want)]
    assert np.allclose([g[2] for g in got], [w[2] for w in sorted(want)], atol=2e-5)


def test_features_of_a_long_text(long, monkeypatch):
    whole = quality.features(*flat(long), np.array([5]))
    monkeypatch.setattr(quality, "SLICE_BYTES", 1000)
    data, off = flat(long[:50_000], "", "x y")
    monkeypatch.setattr(bytesops, "SLICE_BYTES", 1000)
    parts = quality.features(data, off, np.array([5, -1, 2]))
    monkeypatch.undo()
    for a, b in zip(parts, quality.features(data, off, np.array([5, -1, 2])), strict=True):
        assert (a == b).all()
    assert len(whole[0]) > 20_000


def test_training_is_bounded_and_repeats_count_once(spark):
    docs = spark.createDataFrame([(i, ("good fine nice " if i % 2 else "bad spam junk ") * (1 + i % 5), 10) for i in range(300)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)] * 2 + [(None, 1, 0), (1, None, 0), (5, 7, 0)], "doc_id long, quality int, toxic int")
    a, b = quality.train(docs, labels), quality.train(docs, labels.distinct())
    assert np.array_equal(a.weight, b.weight) and np.array_equal(a.factor, b.factor)
    few = quality.train(docs, labels, most=200)
    assert np.count_nonzero(few.weight) and not np.array_equal(few.weight, a.weight)
    assert quality.train(docs, labels.limit(0)).bias == 0


def test_components_with_a_hub(spark):
    rng = random.Random(8)
    edges = [(0, i) for i in range(1, 400)] + [(i, i + 1) for i in range(1000, 1100)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)]
    root = {x: x for e in edges for x in e}
    for a, b in edges:
        x, y = sorted((root[a], root[b]))
        if x != y:
            root = {k: x if v == y else v for k, v in root.items()}
    got = {r.node: r.root for r in common.connected_components(common.Workspace(spark, "t"), spark.createDataFrame(edges, "a long, b long"), "c").collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {k: v for k, v in root.items() if k in linked}
