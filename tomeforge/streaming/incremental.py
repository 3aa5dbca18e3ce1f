"""Incremental loads: what is new since the last run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def above_mark(df: DataFrame, ident: str, mark: int | None) -> tuple[DataFrame, int | None]:
    """Rows with an id above the mark, and the new mark."""
    new = df if mark is None else df.filter(F.col(ident) > mark)
    top = new.agg(F.max(ident)).first()[0]
    return new, mark if top is None else top


def append_new_files(spark: SparkSession, source: str, schema, target: str, checkpoint: str) -> None:
    """Appends the rows of files not seen before, once each; the checkpoint remembers them."""
    stream = spark.readStream.schema(schema).parquet(source)
    q = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
