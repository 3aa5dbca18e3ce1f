"""The pipeline's stages against plain versions, with odd rows, and its whole run."""

import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tomeforge.llm import decontaminate, langid, quality, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, accepted boolean, mark long, component string, row string"
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def frame(spark, rows):
    """Documents with extra columns whose names the operators use too."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 0.5, "x", True, 7, "c", "r") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def words():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randrange(2, 9))) for _ in range(900)]
    return lambda n, seed: " ".join(random.Random(seed).choices(vocabulary, k=n))


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w)} if 0 < len(w) < corpus_pipeline.SHINGLE else {tuple(w[j : j + corpus_pipeline.SHINGLE]) for j in range(len(w) - corpus_pipeline.SHINGLE + 1)}


def test_one_of_each_group_of_near_copies_stays(spark, words):
    t, u = words(80, 1), words(60, 2)
    near = " ".join([*t.split()[:-1], "other"])
    rows = [(7, t), (7, t), (8, u), (8, t), (9, near), (None, t), (None, u), (None, None), (None, None), (3, ""), (3, ""), (4, words(50, 3)), (11, words(70, 4))]
    out = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicate_stage(spark, frame(spark, rows), "").collect()]
    root = list(range(len(rows)))
    for a, (_, x) in enumerate(rows):
        for b, (_, y) in enumerate(rows):
            p, q = shingles(x), shingles(y)
            if p and 100 * len(p & q) >= corpus_pipeline.PERCENT * len(p | q):
                lo, hi = sorted((root[a], root[b]))
                root = [lo if r == hi else r for r in root]
    want = []
    for r in sorted(set(root)):
        members = [rows[i] for i in range(len(rows)) if root[i] == r]
        want.append(min(members, key=lambda m: (m[0] is None, m[0] or 0)))
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert [x for x in sorted(out, key=key)] == sorted(want, key=key)


def test_contaminated_documents_go(spark, tmp_path, words):
    item = words(40, 10)
    spark.createDataFrame([(1, item), (2, "too short"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, item), (1, words(100, 11)), (2, words(100, 12) + " " + item), (2, words(900, 13) + " " + " ".join(item.split()[:13])), (None, item.upper()), (None, words(30, 14)), (5, None), (6, ""), (7, "too short"), (8, item), (8, item)]
    out = sorted((r.doc_id or 0, r.text or "") for r in corpus_pipeline.decontamination_stage(spark, frame(spark, rows), str(tmp_path)).collect())
    windows = {tuple(item.split()[i : i + 13]) for i in range(28)} | {("too", "short")}

    def dirty(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
        hit = {j for n in (13, 2) for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for j in range(i, i + n)}
        return len(hit) > 0 and 20 * len(hit) >= len(w)

    assert out == sorted((i or 0, t or "") for i, t in rows if not dirty(t))


def test_language_stage_drops_noise_and_keeps_clean_documents(spark, words):
    clean = [(i, words(120, 100 + i)) for i in range(60)]
    noise = "".join(random.Random(1).choices("QXZJVWKq0379#%", k=3000))
    out = corpus_pipeline.language_stage(spark, frame(spark, [*clean, (1001, None), (None, ""), (1002, "12 34"), clean[0]]).unionByName(frame(spark, [(1000, noise)]).withColumn("lang", F.lit(None).cast("string"))), "")
    assert sorted((r.doc_id, r.text) for r in out.collect()) == sorted([*clean, clean[0]]) and out.columns == frame(spark, clean).columns


def test_quality_stage_is_the_classifiers_verdict(spark, tmp_path, words):
    good = [(i, (words(80, 200 + i) + ". ").capitalize()) for i in range(60)]
    bad = [(100 + i, "BUY NOW!!! " * (10 + i % 5)) for i in range(60)]
    spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = frame(spark, [*good, *bad, (None, good[0][1]), (500, None)])
    out = corpus_pipeline.quality_stage(spark, docs, str(tmp_path))
    plain = docs.select("doc_id", "text", "n_chars")
    score = {(r.doc_id, r.text): r.score for r in quality.score(plain, quality.train(plain, spark.read.parquet(f"{tmp_path}/labels.parquet")), ("doc_id", "text")).collect()}
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=key) == sorted((k for k, s in score.items() if s >= 0.5), key=key)
    assert {i for i, _ in good} <= {r.doc_id for r in out.collect()} and not {i for i, _ in bad} & {r.doc_id for r in out.collect()}
    assert out.columns == docs.columns


def test_text_typed_n_chars_and_missing_columns(spark, words):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, words(20, 1), "many"), (2, None, "5")], "doc_id long, text string, n_chars string")
    assert quality.quality_scores(docs, none).count() == 2 and quality.quality_scores(docs.drop("n_chars"), none).count() == 2


def test_empty_tables(spark, tmp_path):
    docs = frame(spark, [])
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert langid.language_id(docs).count() == 0 and decontaminate.contamination(docs, spark.read.parquet(f"{tmp_path}/benchmark.parquet")).count() == 0


def test_shards_hold_sizes_and_checksums(spark, words):
    rows = [(i % 40 if i % 7 else None, None if i % 11 == 0 else words(i % 50, i)) for i in range(300)] + [(1, "same é")] * 50
    out = sharding.byte_shards(frame(spark, rows), shards=5).collect()
    size = lambda t: len((t or "").encode()) + 8
    own = sorted((i is None, i or 0, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in out) == own
    share, top = sum(size(t) for _, t in rows) / 5, max(size(t) for _, t in rows)
    for k in range(5):
        mine = [r for r in out if r.shard == k]
        assert abs(sum(r.size for r in mine) - share) <= top and sorted(r.slot for r in mine) == list(range(len(mine)))


def test_whole_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert out.columns[:5] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] and 0 < out.select("doc_id").distinct().count() < docs.count()
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048
