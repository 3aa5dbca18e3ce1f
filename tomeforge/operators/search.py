"""Full-text index as immutable segments, and BM25 over it.

A segment is two tables that are never changed: postings (a row for each word, document and column, with the places where it stands; sorted by
term, so a prefix reads a narrow range by the files' own statistics) and documents. What is searched is named by a manifest: the
segments, the tables of documents that have gone from them (tombstones) and the counts that BM25 wants. A change writes one new
segment and one table of tombstones, and then a manifest of the next number, put in place by one rename: until then, and if the job
is lost, readers have the old one. Segments of like size are merged when there are FAN of them.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeforge.functions import words as W
from tomeforge.functions.text import STOPWORDS
from tomeforge.operators import matching
from tomeforge.operators.matching import Expression
from tomeforge.runtime import ship
from tomeforge.sinks.versions import Versions

K1, B = 1.2, 0.75
#: Segments of one size class that are merged; each class holds segments FAN times as large as the one before.
FAN = 4
#: Characters of a hit that are shown, and hits at most, of a corpus search and an entity search.
SNIPPET, MOST, ENTITY_SNIPPET, ENTITIES = 2000, 20, 120, 20
#: Tables whose facts have columns of their own; the "tool" corpus leaves their documents out.
TOOL_TABLES = ("advancementtables", "ai", "attributes", "effects", "enums", "items", "itemuses", "landmarks", "mechanic", "playertitles", "schema", "sources_abilities", "sources_items", "sources_recipes", "storagevaults", "tsysclientinfo", "xptables")


def query_terms(question: str) -> list[str]:
    """Folded words without stopwords; a question of stopwords alone keeps them."""
    words = list(dict.fromkeys(W.words(question)))
    return [w for w in words if w not in STOPWORDS] or words


def postings(docs: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, term, tf, dl) over all the columns together."""
    ship(docs.sparkSession)
    rows = W.postings(docs, key, *columns, places=False)
    return rows.select(key, "term", "tf", "dl") if len(columns) == 1 else rows.groupBy(key, "term").agg(F.sum("tf").alias("tf"), F.max("dl").alias("dl"))


def bm25(tf: Column, dl: Column, df: Column, n: Column, avgdl: Column) -> Column:
    idf = F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(1e-6))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def _scored(counted: DataFrame, key: str, phrases: int, condition: Column, n: Column, avgdl: Column) -> DataFrame:
    """(key, score) of the rows of counted (key, dl, f0, …; a row for each document with any hit) that fulfil the condition, lower being better."""
    frequency = counted.agg(*[F.sum((F.col(f"f{i}") > 0).cast("double")).alias(f"df{i}") for i in range(phrases)])
    score = sum((bm25(F.col(f"f{i}").cast("double"), F.col("dl").cast("double"), F.col(f"df{i}"), n, avgdl) for i in range(phrases)), F.lit(0.0))
    return counted.crossJoin(F.broadcast(frequency)).filter(condition).select(key, (-score).alias("score"))  # frequency is one row


class Index:
    """The written index of a table of documents, whose keys are unique."""

    def __init__(self, spark: SparkSession, root: str, key: str):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key
        self._versions = Versions(spark, f"{self.root}/manifest")
        ship(spark)

    def manifest(self) -> dict:
        """number, segments (id: n documents), dead (table: its segments), columns, n and words of what is live."""
        number, found = self._versions.latest()
        return {"segments": {}, "dead": {}, "columns": [], "n": 0, "words": 0, **(found or {}), "number": number}

    def _commit(self, manifest: dict, old: dict) -> None:
        self._versions.commit(manifest, old["number"])

    # segments

    def _rows(self, name: str, manifest: dict, only: list[str] | None = None) -> DataFrame | None:
        """The live rows of postings or documents, with their segment."""
        segments = only if only is not None else list(manifest["segments"])
        if not segments:
            return None
        rows = self.spark.read.parquet(*(f"{self.root}/segments/{s}/{name}" for s in segments))
        dead = [t for t, of in manifest["dead"].items() if set(of) & set(segments)]
        if dead:
            rows = rows.join(self.spark.read.parquet(*(f"{self.root}/dead/{t}" for t in dead)), ["_segment", self.key], "left_anti")
        return rows

    def _write(self, postings_: DataFrame, documents: DataFrame) -> tuple[str, int, int]:
        """A new segment's id, documents and words."""
        name = uuid.uuid4().hex[:12]
        here = F.lit(name).alias("_segment")
        at = f"{self.root}/segments/{name}"
        rows = postings_.select(here, self.key, "term", "field", "tf", "dl", "places").repartitionByRange("term").sortWithinPartitions("term", self.key)
        rows.write.option("parquet.writer.version", "PARQUET_2_0").parquet(f"{at}/postings")  # its integers are delta-coded
        documents.select(here, *(c for c in documents.columns if c != "_segment")).write.parquet(f"{at}/documents")
        n, total = self.spark.read.parquet(f"{at}/documents").agg(F.count(F.lit(1)), F.coalesce(F.sum("_words"), F.lit(0))).first()
        return name, n, total

    def build(self, docs: DataFrame, *columns: str) -> Index:
        """Indexes the columns; all columns of docs can be shown. What was there before is no longer part of the index. Documents without a word
        are counted, as BM25 wants it."""
        old = self.manifest()
        name, n, total = self._write(W.postings(docs, self.key, *columns), W.sized(docs, *columns))
        self._commit({"segments": {name: n}, "dead": {}, "columns": list(columns), "n": n, "words": total}, old)
        return self

    def refresh(self, changed: DataFrame, gone: DataFrame | None = None) -> Index:
        """The index after rows of `changed` came or took the place of those of their key, and the keys of `gone` went.

        Writes a segment of the changed rows and the keys that are dead in others, and merges; a lost job leaves the index as it was."""
        old = self.manifest()
        columns, key = old["columns"], self.key
        new = {**old, "segments": dict(old["segments"]), "dead": dict(old["dead"])}
        keys = changed.select(key) if gone is None else changed.select(key).unionByName(gone.select(key))
        live = self._rows("documents", old)
        if live is not None:
            table = uuid.uuid4().hex[:12]
            live.join(keys.distinct(), key, "left_semi").select("_segment", key, "_words").write.parquet(f"{self.root}/dead/{table}")
            hit = self.spark.read.parquet(f"{self.root}/dead/{table}").groupBy("_segment").agg(F.count(F.lit(1)).alias("n"), F.sum("_words").alias("w")).collect()  # a row a segment
            if hit:
                new["dead"][table] = [r["_segment"] for r in hit]
                new["n"] -= sum(r.n for r in hit)
                new["words"] -= sum(r.w for r in hit)
        name, n, total = self._write(W.postings(changed, key, *columns), W.sized(changed, *columns))
        if n:
            new["segments"][name] = n
            new["n"] += n
            new["words"] += total
        self._commit(new, old)
        return self.merge()

    def merge(self) -> Index:
        """Puts FAN or more segments of one size class together, until no class has as many; the dead among them are left out for good."""
        while True:
            old, classes = self.manifest(), {}
            for s, n in old["segments"].items():
                level = 0
                while n >= FAN:
                    n, level = n // FAN, level + 1
                classes.setdefault(level, []).append(s)
            full = next((c for _, c in sorted(classes.items()) if len(c) >= FAN), None)
            if full is None:
                return self
            name, n, _ = self._write(self._rows("postings", old, full), self._rows("documents", old, full))
            segments = {s: k for s, k in old["segments"].items() if s not in full} | {name: n}
            dead = {t: left for t, of in old["dead"].items() if (left := [s for s in of if s in segments])}
            self._commit({**old, "segments": segments, "dead": dead}, old)

    def vacuum(self) -> int:
        """Removes what no reader of the newest manifest needs; how many folders went. Call it when nobody reads older ones."""
        now, gone, versions = self.manifest(), 0, self._versions
        versions.forget(now["number"])
        for folder in ("segments", "dead"):
            for name in versions.names(f"{self.root}/{folder}"):
                gone += name not in now[folder] and versions.delete(f"{self.root}/{folder}/{name}")
        return gone

    def documents(self) -> DataFrame:
        return self._rows("documents", self.manifest()).drop("_segment", "_words")

    # searching

    def counted(self, e: Expression, manifest: dict | None = None) -> DataFrame:
        """(key, dl, f0, …, near0, …): of each document with a word of the expression, how often each phrase and whether each NEAR stands in it."""
        manifest = manifest or self.manifest()
        columns = len(manifest["columns"])
        atoms = list(dict.fromkeys((w, p.prefix and k == len(p.words) - 1) for p in e.phrases for k, w in enumerate(p.words)))
        is_atom = lambda a: F.col("term").startswith(a[0]) if a[1] else F.col("term") == a[0]
        rows = self._rows("postings", manifest).filter(reduce(lambda a, b: a | b, map(is_atom, atoms), F.lit(False)))
        dl = F.max("dl").alias("dl")
        if matching.plain_words(e):
            inside = lambda p: F.col("field").isin(*matching.restricted(p, columns)) if p.fields is not None else F.lit(True)
            return rows.groupBy(self.key).agg(dl, *[F.sum(F.when(is_atom((p.words[0], p.prefix)) & inside(p), F.col("tf")).otherwise(0)).alias(f"f{i}") for i, p in enumerate(e.phrases)])
        together = [F.flatten(F.collect_list(F.when(is_atom(a), F.col("places")))).alias(f"a{i}") for i, a in enumerate(atoms)]
        each = rows.groupBy(self.key, "field").agg(dl, *together)
        places = lambda w, prefix: F.col(f"a{atoms.index((w, prefix))}")
        begins = [F.when(F.col("field").isin(*matching.restricted(p, columns)), matching.starts(p, places)).otherwise(F.array().cast("array<int>")).alias(f"b{i}") for i, p in enumerate(e.phrases)]
        each = each.select(self.key, "dl", *begins)
        near = [matching.is_near([F.col(f"b{i}") for i in numbers], [len(e.phrases[i].words) for i in numbers], gap).alias(f"near{k}") for k, (numbers, gap) in enumerate(e.near)]
        each = each.select(self.key, "dl", *[F.size(f"b{i}").cast("long").alias(f"f{i}") for i in range(len(e.phrases))], *near)
        return each.groupBy(self.key).agg(dl, *[F.sum(f"f{i}").alias(f"f{i}") for i in range(len(e.phrases))], *[F.max(f"near{k}").alias(f"near{k}") for k in range(len(e.near))])

    def scores(self, e: Expression) -> DataFrame:
        """(key, score), lower is better, of the documents that the expression matches."""
        manifest = self.manifest()
        condition = e.condition([F.col(f"f{i}") > 0 for i in range(len(e.phrases))], [F.col(f"near{k}") for k in range(len(e.near))])
        return _scored(self.counted(e, manifest), self.key, len(e.phrases), condition, F.lit(float(manifest["n"])), F.lit(manifest["words"] / max(1, manifest["n"])))

    def expression(self, text: str) -> Expression:
        """A search expression over this index's columns; a text that is none is one literal phrase."""
        try:
            return matching.expression(text, tuple(self.manifest()["columns"]))
        except matching.BadExpression:
            return matching.literal(text)

    def search(self, question: str, k: int = 10, keep: Column | None = None, shown: tuple[str, ...] = (), text: str = "text") -> DataFrame:
        """The k (1 to MOST) best documents with any word of the question, each a prefix: key, shown columns, snippet, score; keep: a condition
        on the documents' columns."""
        k, terms, docs = max(1, min(MOST, k)), query_terms(question), self.documents()
        if not terms:
            return docs.select(self.key, *shown, F.lit("").alias("snippet"), F.lit(0.0).alias("score")).limit(0)
        scored = self.scores(matching.any_prefix(terms))
        if keep is not None:
            scored = scored.join(docs.filter(keep).select(self.key), self.key, "left_semi")
        best = scored.orderBy("score", self.key).limit(k)
        return docs.select(self.key, *shown, F.substring(F.col(text), 1, SNIPPET).alias("snippet")).join(F.broadcast(best), self.key).orderBy("score", self.key)  # k rows


def entity_search(index: Index, query: str, kind: str | None = None) -> DataFrame:
    """name, type, snippet of the best ENTITIES rows (key, name, type, snippet) of the index that the search expression matches."""
    own = index.documents()
    e = index.expression(query)
    if not any(p.words for p in e.phrases):
        return own.select("name", "type", F.substring("snippet", 1, ENTITY_SNIPPET).alias("snippet")).limit(0)
    own = own if kind is None else own.filter(F.col("type") == kind)
    best = own.join(index.scores(e), index.key).orderBy("score", "name", index.key).limit(ENTITIES)
    return best.select("name", "type", F.substring("snippet", 1, ENTITY_SNIPPET).alias("snippet"))


def ranked(docs: DataFrame, key: str, text: str, question: str, k: int = 10) -> DataFrame:
    """The k best documents without an index: (key, score), best (lowest) first; each term is a prefix, terms are OR-ed.

    For texts that are searched once. A text is read and folded once; of it only its numbers leave the task, and the exchange of
    these serves both the statistics and the scores.
    """
    ship(docs.sparkSession)
    k, terms = max(1, min(MOST, k)), query_terms(question)
    counted = W.prefix_counts(docs, key, text, terms).repartition(key)
    stats = counted.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"f{i}") > 0).cast("double")).alias(f"df{i}") for i in range(len(terms))])
    score = sum((bm25(F.col(f"f{i}").cast("double"), F.col("dl").cast("double"), F.col(f"df{i}"), F.col("n"), F.col("avgdl")) for i in range(len(terms))), F.lit(0.0))
    # whatever has a term has a score; asked for after the join, so that both uses of the exchange stay the same
    return counted.crossJoin(F.broadcast(stats)).select(key, (-score).alias("score")).filter("score < 0").orderBy("score", key).limit(k)  # stats is one row


def reassembled(docs: DataFrame, wanted: str) -> DataFrame:
    """The parent of a chunk or parent id and all its chunks, the parent first, then by chunk number."""
    base = docs.filter(F.col("id") == wanted).select(F.coalesce("parent_id", "id").alias("base")).unionByName(docs.limit(1).select(F.lit(wanted).alias("base"))).distinct()
    found = docs.join(F.broadcast(base), F.coalesce("parent_id", "id") == F.col("base"), "left_semi")
    return found.orderBy(F.col("parent_id").isNotNull(), F.expr("try_cast(regexp_extract(id, '_chunk_([0-9]+)$', 1) as int)"))
