"""Tables as Parquet folders that are written whole, by key, by file or from a mark on.

A table is a list of parts, folders that are never changed, and a state that names them together with the table's mark and stamp. Each
change writes a part and then one state, so data and mark hold together, readers see the old or the new table and never none,
and a job that is lost leaves the old one. Parts that neither the present state nor the one before it names are removed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tomeforge.sinks.versions import Versions

#: Parts of a table beyond which a change by file writes it whole.
PARTS = 16


class Store:
    """Tables by name in a folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _versions(self, name: str) -> Versions:
        return Versions(self.spark, f"{self.path(name)}/states")

    def state(self, name: str) -> dict | None:
        """parts (folder and values of a column that are gone from it), schema, mark and stamp."""
        return self._versions(name).latest()[1]

    def exists(self, name: str) -> bool:
        return self.state(name) is not None

    def _parts(self, name: str, state: dict) -> DataFrame:
        schema = StructType.fromJson(json.loads(state["schema"]))
        whole = [p["at"] for p in state["parts"] if not p.get("gone")]
        read = lambda *at: self.spark.read.schema(schema).parquet(*(f"{self.path(name)}/parts/{x}" for x in at))
        out = read(*whole) if whole else self.spark.createDataFrame([], schema)
        for p in state["parts"]:
            if p.get("gone"):
                out = out.unionByName(read(p["at"]).filter(F.coalesce(~F.col(p["by"]).isin(p["gone"]), F.lit(True))))
        return out

    def read(self, name: str) -> DataFrame:
        state = self.state(name)
        if state is None:
            raise ValueError(f"no table {name}")
        return self._parts(name, state)

    def _write(self, name: str, df: DataFrame) -> str:
        part = uuid.uuid4().hex[:16]
        df.write.parquet(f"{self.path(name)}/parts/{part}")
        return part

    def _commit(self, name: str, number: int, old: dict | None, state: dict) -> None:
        versions = self._versions(name)
        versions.commit(state, number)
        used = {p["at"] for s in (state, old or {"parts": []}) for p in s["parts"]}
        for part in versions.names(f"{self.path(name)}/parts"):
            if part not in used:
                versions.delete(f"{self.path(name)}/parts/{part}")
        versions.forget(number)

    def replace(self, name: str, df: DataFrame, mark: int | None = None, stamp: str | int | None = None) -> None:
        """The rows of df become the table, with this mark and stamp."""
        number, old = self._versions(name).latest()
        part = self._write(name, df)
        self._commit(name, number, old, {"parts": [{"at": part}], "schema": df.schema.json(), "mark": mark, "stamp": stamp})

    def upsert(self, name: str, df: DataFrame, keys: list[str]) -> None:
        """Rows of df replace those of the same key; of several rows of df with a key the last by all columns stays."""
        last = Window.partitionBy(*keys).orderBy(*(F.desc_nulls_last(c) for c in df.columns))
        new = df.withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r")
        self.replace(name, new.unionByName(self.read(name).join(new.select(*keys), keys, "left_anti")) if self.exists(name) else new)

    def replace_files(self, name: str, df: DataFrame, by: str = "source_file") -> None:
        """The rows of each file in df replace that file's rows; other files' rows stay as they are and are not read."""
        number, old = self._versions(name).latest()
        part = self._write(name, df)
        files = [r[0] for r in self.spark.read.schema(df.schema).parquet(f"{self.path(name)}/parts/{part}").select(by).distinct().collect()]  # the files of one change
        kept = [{"at": p["at"], "by": by, "gone": sorted({*p.get("gone", []), *files})} for p in (old or {"parts": []})["parts"]]
        self._commit(name, number, old, {"parts": [*kept, {"at": part}], "schema": (old or {}).get("schema", df.schema.json()), "mark": None, "stamp": None})
        if len(kept) >= PARTS:
            self.replace(name, self.read(name))

    def mark(self, name: str) -> int | None:
        """The id up to which a table has been loaded."""
        return (self.state(name) or {}).get("mark")

    def append_new(self, name: str, df: DataFrame, ident: str = "id") -> int:
        """Appends the rows whose id is beyond the mark; they and the new mark come into force together. How many there were."""
        number, old = self._versions(name).latest()
        mark = (old or {}).get("mark")
        new = df if mark is None else df.filter(F.col(ident) > mark)
        part = self._write(name, new.filter(F.col(ident).isNotNull()))
        top, n = self.spark.read.schema(df.schema).parquet(f"{self.path(name)}/parts/{part}").agg(F.max(ident), F.count(F.lit(1))).first()
        if n or old is None:
            state = old or {"parts": [], "schema": df.schema.json(), "stamp": None}
            self._commit(name, number, old, {**state, "parts": [*state["parts"], {"at": part}], "mark": mark if top is None else int(top)})
        return n

    def copy_if_newer(self, name: str, df: DataFrame, stamp: int | str) -> int:
        """The whole of df, if its stamp is not the stored one; how many rows were copied."""
        if (self.state(name) or {}).get("stamp") == stamp:
            return 0
        self.replace(name, df, stamp=stamp)
        return self.read(name).count()

    def converge(self, name: str, df: DataFrame) -> bool:
        """Whether the table's columns differ from df's; if so it is emptied, with df's columns, and its mark forgotten, to be loaded anew."""
        if self.exists(name) and self.read(name).dtypes == df.dtypes:
            return False
        self.replace(name, df.limit(0))
        return True


def changed_files(now: DataFrame, before: DataFrame, stamp: str = "stamp") -> DataFrame:
    """(source_file, change): new, modified or deleted files by their stamp (a time or a content hash)."""
    both = now.select("source_file", F.col(stamp).alias("n")).join(before.select("source_file", F.col(stamp).alias("b")), "source_file", "full")
    change = F.when(F.col("b").isNull(), "new").when(F.col("n").isNull(), "deleted").when(F.col("n") != F.col("b"), "modified")
    return both.select("source_file", change.alias("change")).filter("change is not null")


def content_stamps(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(source_file, stamp) with each file's MD5."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return raw.select(F.regexp_extract("path", "([^/]*)$", 1).alias("source_file"), F.md5("content").alias("stamp"))


def write_report(df: DataFrame, path: str) -> None:
    """One JSON object a line, the lines of df; many files, as Spark writes them."""
    df.write.mode("overwrite").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def report_text(facts: dict) -> str:
    return json.dumps(facts, ensure_ascii=False, indent=2, sort_keys=True)
