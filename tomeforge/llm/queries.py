"""The registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeforge.llm import ann, decontaminate, huffman, langid, licences, ngram_join, packing, quality, sharding, simhash, spelling, tandem, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(_table(spark, sf_dir, "documents"), k=4, percent=85)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(_table(spark, sf_dir, "pages"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(_table(spark, sf_dir, "embeddings"), queries_every=50, k=5)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), length=2048)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.byte_shards(_table(spark, sf_dir, "documents"), shards=24)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(_table(spark, sf_dir, "documents"))


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_notices(_table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.token_files(_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(spelling.word_counts(_table(spark, sf_dir, "documents"), least=5, spoil=97), least=3)


def replanted(documents: DataFrame) -> DataFrame:
    """The documents with periodic endings: each tenth one by h = crc32 of its doc_id has its words joined by blanks, and from word
    a on they repeat the p words that stand there. A null doc_id changes nothing."""
    h, n = F.crc32(F.col("doc_id").cast("string").cast("binary")), F.greatest(F.size("_words"), F.lit(1))
    g = F.floor(h / 10)
    split = documents.withColumn("_words", F.when(h % 10 == 0, F.expr(r"filter(split(text, '[ \\t-\\r]+'), x -> x <> '')")))
    placed = split.withColumn("_a", g % n).withColumn("_p", 1 + F.floor((n - F.col("_a")) / (3 + g % 8)))
    text = F.expr("array_join(transform(_words, (x, i) -> if(i < _a, x, _words[cast(_a + (i - _a) % _p as int)])), ' ')")
    return placed.withColumn("text", F.when(F.size("_words") > 0, text).otherwise(F.col("text"))).drop("_words", "_a", "_p")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tandem.periodic_runs(replanted(_table(spark, sf_dir, "documents")), least=12).withColumn("n_runs", F.size("runs").cast("long"))
    best = F.expr("array_max(transform(runs, r -> struct(r.length, -r.start as left, -r.period as short)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    out = found.withColumn("best", best).select("doc_id", "n_runs", (-F.col("best.left")).alias("start"), "best.length", (-F.col("best.short")).alias("period"), lines.alias("lines"), "collapsed")
    return out.select("doc_id", "n_runs", "start", "length", "period", F.expr("1000 * length div period").alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), k=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_ngram_jaccard_join, op2_url_filter, op3_nearest_neighbours, op4_packing, op5_decontamination, op6_sharding, op7_language_id, op8_licence_scan, op9_token_files, op10_quality, op11_spelling_variants, op12_periodic_runs, op13_simhash_near_dedup)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """None: SQL has no crc32, tokenizer or training, and set joins and windows over whole texts are too slow in it; tests use brute force."""
    return {}
