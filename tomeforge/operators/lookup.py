"""Finding rows by name, and naming what codes stand for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeforge.functions.text import name_like, squeezed


def same_name(column: Column, name: str) -> Column:
    return F.lower(column) == name.lower()


def shortest_match(df: DataFrame, column: str, query: str, n: int = 1) -> DataFrame:
    """The rows whose name holds the query (or its singular), shortest names first, then by name."""
    return df.filter(name_like(F.col(column), query)).orderBy(F.length(column), column).limit(n)


def exact_else_like(df: DataFrame, column: str, query: str) -> DataFrame:
    """The rows of just that name, whatever the case; if there are none, those whose name holds the query."""
    exact = same_name(F.col(column), query)
    found = df.filter(exact | name_like(F.col(column), query)).withColumn("_exact", exact)
    any_exact = found.agg(F.coalesce(F.max("_exact"), F.lit(False)).alias("_any"))  # one row
    return found.crossJoin(F.broadcast(any_exact)).filter("_exact or not _any").drop("_exact", "_any")


def prefix_family(df: DataFrame, column: str, prefixes: tuple[str, ...], query: str, cap: int = 40) -> DataFrame:
    """The rows whose name is a prefix, a blank and a text that holds the query: the first `cap` by name, each with the number of all."""
    name = F.lower(F.col(column))
    wanted = [query.lower()] + ([query[:-1].lower()] if len(query) > 2 and query[-1] in "sS" else [])
    one = lambda p: name.startswith(p.lower() + " ") & reduce(lambda a, b: a | b, (F.contains(name.substr(len(p) + 2, 1 << 20), F.lit(q)) for q in wanted))
    found = df.filter(reduce(lambda a, b: a | b, map(one, prefixes)))
    total = found.agg(F.count(F.lit(1)).alias("n_all"))  # one row
    return found.orderBy(column, *df.columns).limit(cap).crossJoin(F.broadcast(total))


def none_of(column: Column, values: tuple) -> Column:
    """Not among the values; a null is dropped too, as in SQL's NOT IN."""
    return ~column.isin(*values)


def named(df: DataFrame, code: str, names: DataFrame, kind: str, aliases: DataFrame | None = None, out: str = "name") -> DataFrame:
    """Adds what a code is called: its name, else its alias's name, else "Unknown kind (code)". names: code, name; aliases: code, name."""
    df = df.join(names.select(F.col("code").alias(code), F.col("name").alias("_name")), code, "left")
    found = [F.col("_name")]
    if aliases is not None:
        df = df.join(aliases.select(F.col("code").alias(code), F.col("name").alias("_alias")), code, "left")
        found.append(F.col("_alias"))
    return df.withColumn(out, F.coalesce(*found, F.concat(F.lit(f"Unknown {kind} ("), F.col(code).cast("string"), F.lit(")")))).drop("_name", "_alias")


def first_of_kinds(df: DataFrame, kinds: list[tuple[str, DataFrame]], out: str = "target") -> DataFrame:
    """Each entry's target: of its code columns, in order, the first that is not null, by its name in that kind's table (code, name) or,
    if the table does not have it, as the code itself. Entries without any code are dropped."""
    shown, taken = [], []
    for i, (column, names) in enumerate(kinds):
        own = names.select(F.col("code").alias(column), F.col("name").alias(f"_n{i}"))
        df = df.join(own, column, "left")
        shown.append((F.col(column), F.coalesce(F.col(f"_n{i}"), F.col(column).cast("string"))))
        taken.append(f"_n{i}")
    target = reduce(lambda rest, x: F.when(x[0].isNotNull(), x[1]).otherwise(rest), reversed(shown), F.lit(None).cast("string"))
    return df.withColumn(out, target).filter(F.col(out).isNotNull()).drop(*taken)


def pages_of(entities: DataFrame, pages: DataFrame, name: str = "name", title: str = "title") -> DataFrame:
    """Each page with the entity of the same name (case and white space aside): of several the one of the first table, then the smallest id.
    entities: place (of its table in the order of tables), id, name."""
    keyed = entities.withColumn("_key", squeezed(F.col(name)))
    first = Window.partitionBy("_key").orderBy("place", "id")
    keyed = keyed.withColumn("_r", F.row_number().over(first)).filter("_r = 1").select("_key", "place", "id")
    return pages.withColumn("_key", squeezed(F.col(title))).join(keyed, "_key").drop("_key")


def best_by_name(df: DataFrame, name: str, value: str, carry: str) -> DataFrame:
    """For each name (case and outer blanks aside) the largest value and what stands beside it: key, carry, value. Equal values: the smallest."""
    best = F.min_by(carry, F.struct(-F.col(value), F.col(carry)))
    return df.groupBy(F.lower(F.trim(F.col(name))).alias("key")).agg(best.alias(carry), F.max(value).alias(value))


def by_keyword(items: DataFrame, makers: DataFrame, keywords: str, needs: str, order: str) -> DataFrame:
    """Each item with, for each of its keywords, the last maker (by order) that needs the keyword."""
    last = makers.groupBy(F.col(needs).alias("keyword")).agg(F.max_by(F.struct(*makers.columns), order).alias("maker"))
    return items.withColumn("keyword", F.explode(F.array_distinct(keywords))).join(last, "keyword")


def unless_in(df: DataFrame, better: DataFrame, key: str) -> DataFrame:
    """better, and of df what better does not have."""
    return better.unionByName(df.join(better.select(key), key, "left_anti"), allowMissingColumns=True)


def both_differences(known: DataFrame, family: DataFrame, key: str) -> DataFrame:
    """(key, side): what only is known, and what only the family has."""
    a, b = known.select(key).distinct(), family.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("known")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("family")))


def closure(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, depth) of all nodes within `depth` steps of the seeds, each at its least depth; edges: parent, child."""
    found = seeds.select("node").distinct().withColumn("depth", F.lit(0))
    front = found
    for step in range(1, depth + 1):
        front = front.join(edges, F.col("node") == F.col("parent")).select(F.col("child").alias("node")).distinct()
        front = front.join(found.select("node"), "node", "left_anti").withColumn("depth", F.lit(step))
        found = found.unionByName(front)
    return found


def gifts(entries: DataFrame, items: DataFrame, npcs: DataFrame) -> DataFrame:
    """(npc, item) by name, once each; entries: npc_code, item_code; those of unknown npcs or items go."""
    found = entries.join(items.select(F.col("code").alias("item_code"), F.col("name").alias("item")), "item_code")
    return found.join(npcs.select(F.col("code").alias("npc_code"), F.col("name").alias("npc")), "npc_code").select("npc", "item").distinct()
