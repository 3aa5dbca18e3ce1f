"""Contiguous shards of near equal bytes: global prefix sums from per-partition totals, cut at equal targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomeforge.llm.common import Workspace

#: Rows of a range partition, about.
ROWS = 2_000_000


def byte_shards(documents: DataFrame, shards: int = 24, overhead: int = 8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of documents: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The rows are put in ascending (doc_id, text_crc32, size) and dealt to range partitions; each partition's total
    gives the bytes before it, a running sum within it the bytes before each row. A row goes to
    the shard in whose equal share of all bytes its middle byte lies, so each shard is within one row's
    size of total / shards. slot numbers a shard's rows from 0.

    A null text has no bytes (size = overhead, crc32 0); a null doc_id sorts first; equal texts and repeated rows
    are rows of their own and aren't kept together, as one group may be larger than a shard; an empty
    table gives no rows; other columns are ignored. A text longer than a share may leave a shard empty.
    """
    spark = documents.sparkSession
    ws = Workspace(spark, "sharding")
    text_ = F.coalesce(F.col(text), F.lit(""))
    rows = documents.select(F.col(key).cast("long").alias("doc_id"), (F.octet_length(text_) + overhead).cast("long").alias("size"), F.crc32(text_.cast("binary")).alias("text_crc32"), F.rand(7).alias("salt"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2, documents.count() // ROWS + 1)
    # the salt lets rows that are the same in all else fall into several partitions
    ranged = ws.save(rows.repartitionByRange(parts, "doc_id", "text_crc32", "size", "salt").withColumn("part", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))  # one row for each partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ws.save(totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"), F.sum("bytes").over(Window.partitionBy()).alias("total")), "totals")
    within = Window.partitionBy("part").orderBy("doc_id", "text_crc32", "size", "salt")
    placed = (
        ranged.withColumn("upto", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("row", F.row_number().over(within) - 1)
        .join(totals, "part")
        .withColumn("row", F.col("row") + F.col("rows_before"))
        .withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"(2 * (bytes_before + upto) - size) * {shards} div (2 * total)")).cast("int"))
    )
    placed = ws.save(placed.select("doc_id", "size", "text_crc32", "shard", "row"), "placed")
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))  # at most `shards` rows
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
