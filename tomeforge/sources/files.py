"""Keyed JSON tables, wiki pages, curated texts, log lines, JSONL and SQLite tables as DataFrames."""

from __future__ import annotations

import shutil
import sqlite3
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tomeforge.operators.sync import collision_suffix

_KEYED = "key string, id bigint, raw string"


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def listed(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(source_file, length, stamp) of the files of a folder, by name; stamp is the time of the last change. Contents are not read."""
    if not _exists(spark, f"{folder}/{pattern}"):
        return spark.createDataFrame([], "source_file string, length bigint, stamp string")
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return found.select(file_name(F.col("path")).alias("source_file"), "length", F.col("modificationTime").cast("string").alias("stamp"))


def numbered_key(key: Column) -> Column:
    """The number after a key's last underscore, or null."""
    return F.regexp_extract(key, "_([^_]*)$", 1).try_cast("bigint")


def _records(whole: DataFrame) -> DataFrame:
    """tbl, key, id, raw of texts that are an object by key, an object of lists by key (raw is the list), or a list (the key is its place)."""
    shaped = whole.withColumn("kind", F.substring(F.ltrim("value", F.lit(" \n\t\r﻿")), 1, 1))
    by_key = shaped.filter("kind = '{'").select("tbl", F.explode(F.from_json("value", "map<string,string>")).alias("key", "raw"))
    by_place = shaped.filter("kind = '['").select("tbl", F.posexplode(F.from_json("value", "array<string>")).alias("place", "raw")).select("tbl", F.col("place").cast("string").alias("key"), "raw")
    rows = by_key.unionByName(by_place)
    return rows.select("tbl", "key", numbered_key(F.col("key")).alias("id"), "raw")


def json_tables(spark: SparkSession, folder: str) -> DataFrame:
    """(tbl, key, id, raw) of every *.json file in a folder; tbl is the file's lower-case stem. No file gives no rows."""
    if not _exists(spark, f"{folder}/*.json"):
        return spark.createDataFrame([], f"tbl string, {_KEYED}")
    whole = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    return _records(whole.select(F.lower(F.regexp_replace(file_name(F.col("_metadata.file_path")), r"\.json$", "")).alias("tbl"), "value"))


def json_table(spark: SparkSession, path: str) -> DataFrame:
    """(key, id, raw) of one JSON file; a missing one gives no rows."""
    if not _exists(spark, path):
        return spark.createDataFrame([], _KEYED)
    return _records(spark.read.text(path, wholetext=True).select(F.lit("").alias("tbl"), "value")).drop("tbl")


def title_map(spark: SparkSession, path: str) -> DataFrame:
    """(filename, title) from a file that lists pages by title as {"pages": {title: {"filename": ...}}} or {title: filename};
    unreadable or missing gives no rows."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "filename string, title string")
    pages = F.coalesce(F.get_json_object("value", "$.pages"), F.col("value"))
    each = spark.read.text(path, wholetext=True).select(F.explode(F.from_json(pages, "map<string,string>")).alias("title", "of"))
    return each.select(F.coalesce(F.get_json_object("of", "$.filename"), F.col("of")).alias("filename"), "title").filter("filename is not null")


def wiki_pages(spark: SparkSession, path: str, titles: DataFrame | None = None) -> DataFrame:
    """Files named Title_<8hex>.txt as (filename, title, text): the title from the map, else from the name; of equal titles the second
    (by file name) gets _2."""
    if not _exists(spark, f"{path}/*.txt"):
        return spark.createDataFrame([], "filename string, title string, text string")
    pages = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True).select(file_name(F.col("_metadata.file_path")).alias("filename"), F.col("value").alias("text"))
    pages = pages.filter(F.col("filename").rlike("_[0-9a-f]{8}\\.txt$"))
    stem = F.translate(F.regexp_replace("filename", "_[0-9a-f]{8}\\.txt$", ""), "_", " ")
    pages = pages.withColumn("title", stem) if titles is None else pages.join(titles.select("filename", F.col("title").alias("known")), "filename", "left").withColumn("title", F.coalesce("known", stem)).drop("known")
    return collision_suffix(pages, "title", ["filename"]).select("filename", "title", "text")


def curated(spark: SparkSession, folder: str) -> DataFrame:
    """Files named *_curated.txt as documents (id, type, tbl, name, text)."""
    if not _exists(spark, f"{folder}/*_curated.txt"):
        return spark.createDataFrame([], "id string, type string, tbl string, name string, text string")
    stem = F.regexp_replace(file_name(F.col("_metadata.file_path")), r"\.txt$", "")
    found = spark.read.option("pathGlobFilter", "*_curated.txt").text(folder, wholetext=True).select(stem.alias("stem"), "value")
    name = F.initcap(F.translate(F.regexp_replace("stem", "_curated", ""), "_", " "))
    return found.select(F.concat(F.lit("curated_"), "stem").alias("id"), F.lit("curated").alias("type"), F.lit("curated").alias("tbl"), name.alias("name"), F.col("value").alias("text"))


def log_lines(spark: SparkSession, folder: str, pattern: str = "Chat-*.log") -> DataFrame:
    """(source_file, line_no, value) of every line of the log files of a folder, numbered from 1: the input of `chat.folded`.

    A file is split in one place, as numbers need it whole: logs of a day are bounded, and many are spread.
    """
    if not _exists(spark, f"{folder}/{pattern}"):
        return spark.createDataFrame([], "source_file string, line_no int, value string")
    whole = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True).select(file_name(F.col("_metadata.file_path")).alias("source_file"), "value")
    each = whole.select("source_file", F.posexplode(F.split(F.regexp_replace("value", "\r?\n$", ""), "\r?\n")).alias("place", "value"))
    return each.select("source_file", (F.col("place") + 1).alias("line_no"), "value")


def log_pieces(spark: SparkSession, folder: str, pattern: str = "Chat-*.log") -> DataFrame:
    """(source_file, piece, line_no, value) as log_lines, but of files that are read in pieces (spark.sql.files.maxPartitionBytes) by as
    many tasks; piece is where it begins in its file. Lines are counted in each piece, and a scan over the pieces gives their numbers."""
    if not _exists(spark, f"{folder}/{pattern}"):
        return spark.createDataFrame([], "source_file string, piece bigint, line_no bigint, value string")
    lines = spark.read.option("pathGlobFilter", pattern).option("lineSep", "\n").text(folder)
    lines = lines.select(file_name(F.col("_metadata.file_path")).alias("source_file"), F.col("_metadata.file_block_start").alias("piece"), F.monotonically_increasing_id().alias("_at"), F.regexp_replace("value", "\r$", "").alias("value"))
    own = lines.groupBy("source_file", "piece").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("source_file").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)  # over pieces
    own = own.select("source_file", "piece", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return lines.join(own, ["source_file", "piece"]).select("source_file", "piece", (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("line_no"), "value")


def jsonl(spark: SparkSession, path: str, schema: str, key: str | None = None) -> DataFrame:
    """Lines that parse; blank and truncated ones are dropped, and with a key those that lack it."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows if key is None else rows.filter(F.col(key).isNotNull())


def sqlite_tables(path: str) -> dict[str, list[tuple[str, str]]]:
    """The tables of a SQLite file and their (column, type)."""
    with _copied(path) as connection:
        names = [r[0] for r in connection.execute("select name from sqlite_master where type = 'table' and name not like 'sqlite_%' order by name")]
        return {n: [(c[1], c[2]) for c in connection.execute(f'pragma table_info("{n}")')] for n in names}


#: Rows of a SQLite table that one task reads, about.
SQLITE_ROWS = 200_000


def sqlite_table(spark: SparkSession, path: str, name: str, rows: int = SQLITE_ROWS) -> DataFrame:
    """A table of a SQLite file as texts, numbers and bytes by the columns' declared types.

    A copy of the file, its journal worked in, is given to the executors by Spark's own file server; each task reads a range of row numbers
    from the copy where it runs, so no row goes through the driver. A table without row numbers is read by one task.
    """
    kinds = {"INT": "bigint", "REAL": "double", "FLOA": "double", "DOUB": "double", "NUME": "double", "BLOB": "binary"}
    columns = sqlite_tables(path).get(name)
    if columns is None:
        raise ValueError(f"no table {name}")
    types = [next((v for k, v in kinds.items() if k in t.upper()), "string") for _, t in columns]
    made = [{"bigint": int, "double": float, "string": str, "binary": bytes}[t] for t in types]
    shipped = f"{uuid.uuid4().hex}.db"
    with _copied(path, shipped, keep=True) as connection:
        try:
            low, high = connection.execute(f'select min(rowid), max(rowid) from "{name}"').fetchone()
            asked = "where rowid between ? and ?"
        except sqlite3.OperationalError:
            low, high, asked = 0, 0, "where ? <= ?"
        connection.execute("pragma wal_checkpoint(truncate)")
        connection.execute("pragma journal_mode = delete")
        spark.sparkContext.addFile(connection.execute("pragma database_list").fetchone()[2])
    if low is None:
        return spark.createDataFrame([], ", ".join(f"`{c}` {t}" for (c, _), t in zip(columns, types, strict=True)))
    parts = max(1, (high - low) // rows + 1)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
        for batch in batches:
            for part in batch.column(0).to_pylist():
                first = low + part * rows
                with sqlite3.connect(f"file:{SparkFiles.get(shipped)}?mode=ro&immutable=1", uri=True) as own:
                    cursor = own.execute(f'select * from "{name}" {asked}', (first, first + rows - 1))
                    while found := cursor.fetchmany(10_000):
                        yield pa.RecordBatch.from_arrays([pa.array([None if v is None else f(v) for v in column], kind[t]) for f, t, column in zip(made, types, zip(*found, strict=True), strict=True)], names=[c for c, _ in columns])

    return spark.range(0, parts, 1, parts).mapInArrow(read, ", ".join(f"`{c}` {t}" for (c, _), t in zip(columns, types, strict=True)))


class _copied:
    """A connection to a copy of a SQLite file and of its write-ahead files, which may be in use."""

    def __init__(self, path: str, name: str = "copy.db", keep: bool = False):
        """keep: the copy stays, as tasks fetch it from the driver when they begin."""
        self.path, self.name, self.keep = Path(path), name, keep

    def __enter__(self):
        self.folder = Path(tempfile.mkdtemp(prefix="tomeforge-"))
        for end in ("", "-wal", "-shm"):
            if (own := Path(f"{self.path}{end}")).exists():
                shutil.copy(own, self.folder / f"{self.name}{end}")
        self.connection = sqlite3.connect(str(self.folder / self.name))
        return self.connection

    def __exit__(self, *_) -> None:
        self.connection.close()
        if not self.keep:
            shutil.rmtree(self.folder, ignore_errors=True)


def columns_of(df: DataFrame) -> Iterator[tuple[str, str]]:
    yield from df.dtypes
