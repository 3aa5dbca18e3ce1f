"""Tool calls that stand in a text: JSON in fences and function markup. All in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a block that is no call; arguments that show best what a call is about; characters of that.
RAW, TELLING, PREVIEW = 200, ("query", "title", "name", "id", "sql"), 100
_CALL = "struct<place: int, name: string, args: map<string, string>, raw: string>"


def _fenced(text: Column) -> Column:
    """The blocks between a line of ```tool and the next ``` on a line's beginning or after the text."""
    blocks = F.regexp_extract_all(text, F.lit(r"```tool[ \t\r\f]*\n([\s\S]*?)\n?```"), F.lit(1))
    name = lambda b: F.get_json_object(b, "$.name")
    args = lambda b: F.from_json(F.get_json_object(b, "$.args"), "map<string, string>")
    return F.transform(blocks, lambda b, i: F.struct(i.alias("place"), F.when(_is_call(b), name(b)).alias("name"), F.when(_is_call(b), args(b)).alias("args"), F.when(~_is_call(b), F.substring(b, 1, RAW)).alias("raw")).cast(_CALL))


def _is_call(block: Column) -> Column:
    """Whether a block is one JSON object, with nothing after it, that has a name. As the only entry of a list nothing can follow it."""
    listed = F.concat(F.lit("["), block, F.lit("]"))
    whole = F.try_parse_json(listed).isNotNull() & (F.json_array_length(listed) == 1) & block.rlike(r"^\s*\{")
    return F.coalesce(whole & (F.get_json_object(block, "$.name") != ""), F.lit(False))


def _functions(text: Column, after: Column) -> Column:
    """<function=NAME><parameter=KEY>value</parameter>…</function>, counted on from `after`."""
    pieces = F.slice(F.split(text, "<function="), 2, 1 << 20)
    closed = F.filter(pieces, lambda p: p.rlike(r"^[\w.]+>") & F.contains(p, F.lit("</function>")))
    inner = lambda p: F.substring_index(p, "</function>", 1)
    of = lambda p, k: F.regexp_extract_all(inner(p), F.lit(r"<parameter=(\w+)>\s*([\s\S]*?)\s*</parameter>"), F.lit(k))
    plain = lambda v: F.when(v.rlike(r'^"([^"\\]|\\.)*"$'), F.get_json_object(F.concat(F.lit('{"v":'), v, F.lit("}")), "$.v")).otherwise(v)
    last = lambda p: F.map_from_entries(F.reverse(_last_of_each(F.reverse(F.arrays_zip(of(p, 1).alias("k"), of(p, 2).alias("v"))), plain)))
    return F.transform(closed, lambda p, i: F.struct((after + i).alias("place"), F.regexp_extract(p, r"^([\w.]+)>", 1).alias("name"), last(p).alias("args"), F.lit(None).cast("string").alias("raw")).cast(_CALL))


def _last_of_each(pairs: Column, plain) -> Column:
    """Pairs in reverse order, of those of a key the first."""
    keys = F.transform(pairs, lambda x: x["k"])
    own = F.filter(F.transform(pairs, lambda x, i: F.struct(x["k"].alias("k"), plain(x["v"]).alias("v"), (F.array_position(keys, x["k"]) == i + 1).alias("first"))), lambda x: x["first"])
    return F.transform(own, lambda x: F.struct(x["k"], x["v"]))


def tool_calls(texts: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """keys, place, name, args, raw: a row for each call in a text, fenced ones first.

    A fenced block is a call if it is a JSON object with a name; otherwise raw is how it begins. args holds an argument's text, or for other
    values its JSON. Parameters that repeat count as the last one. A null text has no calls.
    """
    fenced = _fenced(F.col(text))
    both = texts.withColumn("_f", F.coalesce(fenced, F.array().cast(f"array<{_CALL}>"))).withColumn("_m", F.coalesce(_functions(F.col(text), F.size("_f")), F.array().cast(f"array<{_CALL}>")))
    return both.select(*keys, F.explode(F.concat("_f", "_m")).alias("_c")).select(*keys, "_c.*")


def preview(args: Column) -> Column:
    """What a call is about, on one line: the first telling argument with any text, else all of them by name."""
    flat = lambda k: F.nullif(F.trim(F.regexp_replace(F.try_element_at(args, F.lit(k)), r"\s+", " ")), F.lit(""))
    every = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(args))))
    return F.substring(F.coalesce(*map(flat, TELLING), every, F.lit("")), 1, PREVIEW)
