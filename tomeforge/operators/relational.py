"""Deduplication, windows and joins that recur in knowledge stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column], usable: Column | None = None) -> DataFrame:
    """The newest usable row of each key; unusable rows are dropped first, so an older good one wins."""
    df = df if usable is None else df.filter(usable)
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_place = 1").drop("_place")


def latest_bodies(rows: DataFrame, keys: tuple[str, str] = ("character", "server"), at: str = "ts", body: str = "report") -> DataFrame:
    """The newest row of each (character, server) whose body is that character's: a JSON object whose Character is the row's, blanks around
    it aside. Half-written, empty and foreign bodies are passed over for an older good one."""
    shown = F.try_parse_json(body)
    said = F.trim(F.try_variant_get(shown, "$.Character", "string"), F.lit(" \n\t\r"))
    own = F.schema_of_variant(shown).startswith("OBJECT") & F.schema_of_variant(F.try_variant_get(shown, "$.Character", "variant")).startswith("STRING") & (said != "") & (said == F.col(keys[0]))
    return latest(rows, list(keys), [F.desc(at), F.desc(body)], F.coalesce(own, F.lit(False)))


def fullest_batch(df: DataFrame, keys: list[str], batch: str, ident: str) -> DataFrame:
    """Of each key the rows of the batch with most rows, ties to the newest id."""
    sizes = df.groupBy(*keys, batch).agg(F.count(F.lit(1)).alias("_n"), F.max(ident).alias("_last"))
    best = latest(sizes, keys, [F.desc("_n"), F.desc("_last")]).select(*keys, batch)
    return df.join(best, [*keys, batch], "left_semi")


def runs(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of consecutive rows with one value: keys, value, first, last (of the first order column), n."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("_new", (~F.col(value).eqNullSafe(F.lag(value).over(w)) | F.lag(F.lit(1)).over(w).isNull()).cast("int"))
    marked = marked.withColumn("_run", F.sum("_new").over(w))
    return marked.groupBy(*keys, "_run", value).agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count(F.lit(1)).alias("n")).drop("_run")


def either_key_join(left: DataFrame, right: DataFrame, one: str, two: str, key: str, columns: list[str]) -> DataFrame:
    """left.one = key or left.two = key, as two equi-joins and a distinct union instead of a nested loop."""
    a = left.join(right, left[one] == right[key]).select(*columns)
    return a.unionByName(left.join(right, left[two] == right[key]).select(*columns)).distinct()


def recent_share(df: DataFrame, key: str, order: list[Column], flag: Column, n: int = 10) -> DataFrame:
    """Of each key's last n rows: how many, and the share of those with the flag."""
    w = Window.partitionBy(key).orderBy(*order)
    last = df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
    return last.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(flag.cast("double")).alias("share"))


def running_total(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(value).over(w))


def freshness(current: DataFrame, held: DataFrame, key: str, stamp: str) -> DataFrame:
    """(key, action): skip, download (new or changed) or purge (no longer there)."""
    a, b = current.select(key, F.col(stamp).alias("_now")), held.select(key, F.col(stamp).alias("_had"))
    action = F.when(F.col("_now").isNull(), "purge").when(F.col("_had").isNull() | (F.col("_had") < F.col("_now")), "download").otherwise("skip")
    return a.join(b, key, "full").select(key, action.alias("action"))
