"""Sorted, capped and counted listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows in the order."""
    return df.orderBy(*order).limit(n)


def numeric_prefix(key: Column) -> Column:
    """The number before a key's first underscore, else 0: what such keys are sorted by."""
    return F.coalesce(F.split_part(key, F.lit("_"), F.lit(1)).try_cast("int"), F.lit(0))


def ranked_list(df: DataFrame, group: str, name: str, level: str) -> DataFrame:
    """(group, n, listing): the names of each group numbered by falling level, then by name, one on a line."""
    each = F.array_sort(F.collect_list(F.struct((-F.col(level)).alias("down"), F.col(name).alias("name"))))
    line = lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["name"], F.lit(" (level "), (-x["down"]).cast("string"), F.lit(")"))
    return df.groupBy(group).agg(each.alias("_all")).select(group, F.size("_all").alias("n"), F.array_join(F.transform("_all", line), "\n").alias("listing"))


def highest_by_name(df: DataFrame, group: str, name: str, level: str) -> DataFrame:
    """(group, n, listing): each name once, at its highest level, by falling level, then by name."""
    return ranked_list(df.groupBy(group, name).agg(F.max(level).alias(level)), group, name, level)


def labelled(df: DataFrame, group: str, name: str, label: str, cap: int = 60) -> DataFrame:
    """(group, listing): the group's names in order with all their labels, the first `cap`, and how many more there are."""
    each = df.groupBy(group, name).agg(F.array_sort(F.collect_set(label)).alias("_labels"))
    text = F.concat(F.col(name), F.lit(" ("), F.array_join("_labels", ", "), F.lit(")"))
    listed = each.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(name).alias("name"), text.alias("text")))).alias("_all"))
    more = F.size("_all") - cap
    shown = F.array_join(F.transform(F.slice("_all", 1, cap), lambda x: x["text"]), "; ")
    return listed.select(group, F.concat(shown, F.when(more > 0, F.concat(F.lit("; +"), more.cast("string"), F.lit(" more"))).otherwise("")).alias("listing"))


def cross_tab(df: DataFrame, name: str, levels: dict[int, str], least: int = 2) -> DataFrame:
    """(level, n, listing) of columns by level: who contributes how much, most first; levels of fewer than `least` contributors go."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.col(c).cast("double").alias("value")) for k, c in levels.items())))
    rows = df.select(name, pairs.alias("_p")).select(name, "_p.*").filter("value > 0")
    shown = lambda x: F.concat(x["name"], F.lit(": "), F.when(-x["down"] == F.floor(-x["down"]), (-x["down"]).cast("bigint").cast("string")).otherwise((-x["down"]).cast("string")))
    each = F.array_sort(F.collect_list(F.struct((-F.col("value")).alias("down"), F.col(name).alias("name"))))
    return rows.groupBy("level").agg(each.alias("_all")).filter(F.size("_all") >= least).select("level", F.size("_all").alias("n"), F.array_join(F.transform("_all", shown), ", ").alias("listing"))


def within_budget(df: DataFrame, group: list[str], order: list[Column], text: str, budget: int, cap: int = 60) -> DataFrame:
    """Of each group the longest run of first rows, at most `cap`, whose texts, one on a line, have at most `budget` characters."""
    w = Window.partitionBy(*group).orderBy(*order)
    used = F.sum(F.length(text) + 1).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1
    return df.withColumn("_used", used).withColumn("_place", F.row_number().over(w)).filter((F.col("_used") <= budget) & (F.col("_place") <= cap)).drop("_used", "_place")


def price_tiers(df: DataFrame, keys: list[str], price: str, quantity: str) -> DataFrame:
    """keys, price, quantity: tiers of one price (to a thousandth) together; unpriced ones last by `place`."""
    tiers = df.groupBy(*keys, F.round(F.col(price) * 1000).alias("_milli")).agg(F.sum(quantity).alias(quantity))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_milli").asc_nulls_last()))
    return tiers.select(*keys, (F.col("_milli") / 1000).alias(price), quantity, place.alias("place"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(tbl, n) of each table."""
    out = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.lit(name).alias("tbl"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def status_report(df: DataFrame, group: list[str], status: str, missing: str) -> DataFrame:
    """For each group: rows, how many passed, failed and erred, and all that was missing."""
    count = lambda s: F.count_if(F.col(status) == s)
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), count("PASS").alias("passed"), count("FAIL").alias("failed"), count("ERROR").alias("erred"), F.coalesce(F.sum(missing), F.lit(0)).alias("missing"))


def chosen_ids(derived: DataFrame, manual: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(key, why): derived and manually listed keys, once each, derived first, if they are known at all."""
    both = derived.select(key, F.lit(0).alias("place")).unionByName(manual.select(key, F.lit(1).alias("place")))
    first = both.groupBy(key).agg(F.min("place").alias("place"))
    return first.join(known.select(key).distinct(), key, "left_semi").select(key, F.when(F.col("place") == 0, "derived").otherwise("manual").alias("why"))


def markdown_table(df: DataFrame, rows: int = 200, width: int = 200) -> str:
    """The first rows as a markdown table, with a note if there are more: for the edge of the system, where few rows are shown."""
    from tomeforge.functions.text import table_cell

    shown = df.select(*(table_cell(F.when(F.col(f"`{c}`") == F.floor(F.col(f"`{c}`")), F.col(f"`{c}`").cast("bigint").cast("string")).otherwise(F.col(f"`{c}`").cast("string")) if t in ("double", "float") else F.col(f"`{c}`"), width).alias(c) for c, t in df.dtypes))
    found = shown.limit(rows + 1).collect()
    if not found:
        return "0 rows.\n(no results)"
    head = ["| " + " | ".join(df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |"]
    body = ["| " + " | ".join(r) + " |" for r in found[:rows]]
    note = [f"…[truncated at {rows} rows]"] if len(found) > rows else []
    return "\n".join([f"{len(body)} rows.", *head, *body, *note])


#: Characters of a table of results that are shown, and what is kept back for the note.
TABLE, NOTE = 12_000, 60


def middle_out(rows: DataFrame, group: list[str], order: list[str], line: str, most: int = TABLE) -> DataFrame:
    """Of each group's rows the first and the last, whole, that fill half of `most` characters each (a line ends with one more); with n_left_out,
    how many rows between them are left out. A group that fits is whole.

    The lengths are summed from both ends by windows over one group, so a group is one result and not a table.
    """
    size = F.length(F.coalesce(F.col(line), F.lit(""))) + 1
    forth = Window.partitionBy(*group).orderBy(*order)
    back = Window.partitionBy(*group).orderBy(*[F.desc(c) for c in order])
    both = rows.withColumn("_size", size).withColumn("_a", F.sum("_size").over(forth.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_b", F.sum("_size").over(back.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(*group)
    both = both.withColumn("_all", F.sum("_size").over(whole)).withColumn("_keep", (F.col("_all") <= most) | (F.col("_a") <= most // 2) | (F.col("_b") <= most // 2))
    both = both.withColumn("n_left_out", F.count(F.when(~F.col("_keep"), 1)).over(whole))
    return both.filter("_keep").drop("_size", "_a", "_b", "_all", "_keep")


def middle_out_text(head: list[str], rows: list[str], most: int = TABLE) -> str:
    """The same for a result that the caller holds: head, then the rows that fit, and a note in the place of those that don't."""
    room = most - sum(len(x) + 1 for x in head) - NOTE
    if sum(len(x) + 1 for x in rows) <= room + NOTE:
        return "\n".join([*head, *rows])

    def fitting(lines: list[str]) -> int:
        used, n = 0, 0
        for x in lines:
            used += len(x) + 1
            if used > room // 2:
                break
            n += 1
        return n

    a = fitting(rows)
    b = fitting(rows[a:][::-1])
    return "\n".join([*head, *rows[:a], f"({len(rows) - a - b} rows in the middle are left out)", *rows[len(rows) - b :]])
