"""What persons give for what: the trades of an item, written at the head of its documents.

An item is looked for in the cell of a table that says what is given. All items are looked for at once: each different text of such cells
emits its sequences of words up to the length of the longest name, each name is such a sequence, and the two meet by an equi-join; the text
of those that met is then compared exactly. The rows take the names of their texts, and meet the offers by (person, name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tomeforge.runtime import shared_folder

#: Tables that an item's trades are taken from, and requests of each that are named.
TABLES, REQUESTS = 2, 3


def word_list(text: Column) -> Column:
    """The words of a text (letters, digits and _), lowered."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def sequences(words: Column, longest: int) -> Column:
    """Every distinct sequence of 1 to `longest` words that follow one another, joined by blanks."""
    return F.array_distinct(F.array_compact(F.flatten(F.array(*[_runs(words, n) for n in range(1, longest + 1)]))))


def _runs(words: Column, n: int) -> Column:
    return F.transform(words, lambda _, i: F.when(i + n <= F.size(words), F.array_join(F.slice(words, i + 1, n), " ")))


def _saved(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The rows, written and read again: their size is known then, and a small table is sent to the tasks that join it."""
    folder = shared_folder(spark)
    rows.write.parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def trades(items: DataFrame, offers: DataFrame, rows: DataFrame, covers: DataFrame) -> DataFrame:
    """(item_key, trades): the lines on at most TABLES tables of an item, in the order of its offers and then of the tables.

    items: item_key, name. offers: item_key, place, person. rows: person, table_id, row, cells; the last of several cells is what is given, the
    others what is asked for. covers: table_id, text. A table counts for an item if some row gives it, as whole words; the first REQUESTS
    different requests of these rows are named. Items, tables and rows without a name, a text or a second cell have no trades.
    """
    spark = items.sparkSession
    names = items.filter("name is not null").select("item_key", "name").filter(F.size(word_list(F.col("name"))) > 0)
    longest = names.agg(F.max(F.size(word_list(F.col("name"))))).first()[0] or 1  # one number
    asked = F.array_join(F.slice("cells", F.lit(1), F.size("cells") - 1), " | ")
    given = rows.filter("size(cells) > 1").select("person", "table_id", "row", asked.alias("asked"), F.lower(F.element_at("cells", -1)).alias("_given"))
    # which names are in a text is found once for each text; rows take it from there, and their sequences are never dealt out
    told = given.select("_given").distinct().select("_given", F.explode(sequences(word_list(F.col("_given")), longest)).alias("_words"))
    exact = F.rlike(F.col("_given"), F.concat(F.lit(r"\b\Q"), F.lower("name"), F.lit(r"\E\b")))
    told = _saved(spark, told.join(names.select("name", F.array_join(word_list(F.col("name")), " ").alias("_words")).distinct(), "_words").filter(exact).select("_given", "name"))
    covers = _saved(spark, covers.filter("text <> ''").select("table_id", F.col("text").alias("options")))
    given = given.join(covers.select("table_id").distinct(), "table_id", "left_semi").join(told, "_given").drop("_given")
    wanted = offers.select("item_key", "place", "person").join(names, "item_key").repartition("person", "name")
    wanted = wanted.groupBy("person", "name", "item_key").agg(F.min("place").alias("place"))
    hits = given.join(wanted, ["person", "name"]).repartition("item_key")  # all that follows is dealt by it
    # of each item and table the first different requests; then of each item the first tables
    firsts = hits.groupBy("item_key", "name", "table_id", "asked").agg(F.min(F.struct("place", "person")).alias("at"), F.min("row").alias("row"))
    by_row = Window.partitionBy("item_key", "table_id").orderBy("row", "asked")
    firsts = firsts.withColumn("_r", F.row_number().over(by_row)).filter(F.col("_r") <= REQUESTS)
    groups = firsts.groupBy("item_key", "name", "table_id").agg(F.min("at").alias("at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "asked"))), lambda x: x["asked"]), ", ").alias("requests"))
    by_place = Window.partitionBy("item_key").orderBy("at.place", "at.person", "table_id")
    first = lambda x: x.withColumn("_g", F.row_number().over(by_place)).filter(F.col("_g") <= TABLES)
    groups = first(first(groups).drop("_g").join(covers, "table_id"))
    said = F.concat(F.lit("Barter: "), "at.person", F.lit(" gives "), "name", F.lit(" in exchange for "), "requests", F.lit(".\nBarter options at "), "at.person", F.lit(": "), "options")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_g", said.alias("said")))), lambda x: x["said"])
    return groups.groupBy("item_key").agg(F.array_join(listed, "\n").alias("trades"))


def with_trades(docs: DataFrame, found: DataFrame, item_key: str = "item_key") -> DataFrame:
    """The documents, those of items with trades with these before their text."""
    both = docs.join(found.select(F.col("item_key").alias(item_key), "trades"), item_key, "left")
    text = F.when(F.col("trades").isNull(), F.col("text")).otherwise(F.concat("trades", F.lit("\n\n"), F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+", "")))
    return both.withColumn("text", text).drop("trades").select(*docs.columns)
