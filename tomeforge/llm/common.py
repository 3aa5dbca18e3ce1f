"""Shared folder, written intermediate tables, size-checked broadcasts, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeforge.runtime import ship

#: Rows of one or two 8-byte columns that may be broadcast; beyond it a shuffled join is used.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one is set only where the setting is absent and Spark runs in one process (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master or ""):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tomeforge-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Workspace:
    """Tables written as Parquet to the shared folder and read again: lineage ends there, and an
    executor that is lost takes nothing with it."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)


def semi_join(df: DataFrame, ids: DataFrame, key: str, n_ids: int, how: str = "left_semi") -> DataFrame:
    """Keeps the rows of df whose key is in ids: by broadcast up to BROADCAST_ROWS ids, else by a shuffled join."""
    return df.join(F.broadcast(ids) if n_ids <= BROADCAST_ROWS else ids.hint("merge"), key, how)


def connected_components(ws: Workspace, edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node reachable.

    Alternates large-star and small-star steps (each a grouped minimum and an equi-join), with a
    table written after each; ends when the edge set no longer changes.
    """
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    digest = lambda e: e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
    now = ws.save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), f"{name}-0")
    seen, step = digest(now), 0
    while seen[0]:
        step += 1
        # large star: larger neighbours are linked to the smallest one
        least = both(now).groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both(now).filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = ws.save(large.filter("a <> b").distinct(), f"{name}-{step}-large")
        # small star: a node and its smaller neighbours are linked to the smallest one
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(down.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        last, now = f"{name}-{step - 1}", ws.save(small, f"{name}-{step}")
        after = digest(now)
        ws.drop(f"{name}-{step}-large", last)
        if after == seen:
            break
        seen = after
    roots = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
