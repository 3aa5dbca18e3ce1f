"""Chat log lines put together to rows: stamped lines begin one, lines without a stamp carry it on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Channels whose lines name a speaker.
SPEAKER_CHANNELS = ("Combat", "Nearby", "Trade", "Help", "Tell", "Party", "Guild", "Global")
#: What the game itself reports after two or more stars.
SYSTEM_EVENTS = ("Entering Area", "Logged In", "Logged Out")
_STAMP = "00-00-00 00:00:00"


def _stamp(value: Column) -> Column:
    """The time before the first tab, or null."""
    left = F.substring_index(value, "\t", 1)
    shaped = F.contains(value, F.lit("\t")) & (F.translate(left, "123456789", "000000000") == _STAMP)
    return F.when(shaped, left)


def _inner(x: Column) -> Column:
    """What stands between the first [ and the ] that follows, if x begins with [ and there is something between."""
    inner = F.substring_index(x.substr(F.lit(2), F.length(x)), "]", 1)
    return F.when(x.startswith("[") & F.contains(x, F.lit("]")) & (inner != ""), inner)


def _announces(x: Column) -> Column:
    """One pair of brackets around a text with a small letter or an apostrophe."""
    inner = x.substr(F.lit(2), F.length(x) - 2)
    lower = F.translate(inner, "abcdefghijklmnopqrstuvwxyz'", "") != inner
    return x.startswith("[") & x.endswith("]") & ~F.contains(inner, F.lit("]")) & lower


def _facts(x: Column) -> Column:
    """The names in [Item: ...] and [Recipe: ...] if x holds nothing else, else null; a name may hold brackets itself if they are balanced."""
    starts = F.replace(F.replace(x, F.lit("[Item: "), F.lit("\x01[Item: ")), F.lit("[Recipe: "), F.lit("\x01[Recipe: "))
    pieces = F.transform(F.split(starts, "\x01"), lambda p: F.trim(p))
    named = F.slice(pieces, 2, 1 << 20)
    level = lambda p, sign: F.length(p) - F.length(F.replace(p, F.lit(sign), F.lit("")))
    whole = F.forall(named, lambda p: p.endswith("]") & (level(p, "[") == level(p, "]")) & (F.length(p) > F.instr(p, ": ") + 2))
    name = F.transform(named, lambda p: p.substr(F.instr(p, ": ") + 2, F.length(p) - F.instr(p, ": ") - 2))
    return F.when((F.element_at(pieces, 1) == "") & (F.size(named) > 0) & whole, F.array_join(name, "; "))


def _loot(x: Column) -> Column:
    """The names in all [Item: ...] of x."""
    pieces = F.slice(F.split(x, r"\[Item: "), 2, 1 << 20)
    found = F.filter(pieces, lambda p: F.instr(p, "]") > 1)
    return F.array_join(F.transform(found, lambda p: F.substring_index(p, "]", 1)), "; ")


def classified(lines: DataFrame) -> DataFrame:
    """Adds kind, ts, channel, speaker, said to lines with a column `value`.

    kind: row (begins a row), facts (items only: carries a speaker's row on, else a row), more (carries any row on),
    blank, or lost (stamped, of no known shape).
    """
    value = F.rtrim(F.col("value"), F.lit("\r\n"))
    out = lines.withColumn("value", value).withColumn("stamp", _stamp(F.col("value")))
    out = out.withColumn("body", F.when(F.col("stamp").isNotNull(), F.col("value").substr(F.lit(len(_STAMP) + 2), F.length("value"))))
    out = out.withColumn("named", _inner(F.col("body"))).withColumn("listed", F.when(F.col("stamp").isNull(), _facts(F.col("value"))))
    rest = F.col("body").substr(F.length("named") + 3, F.length("body"))
    rest = F.when(rest.startswith(" "), rest.substr(F.lit(2), F.length(rest))).otherwise(rest)
    bare, loot, channelled = F.col("stamp").isNull(), F.contains("body", F.lit("[Item:")), F.col("named").isNotNull()
    speaks = channelled & ~loot & F.col("named").isin(*SPEAKER_CHANNELS) & F.contains(rest, F.lit(": "))
    after = F.ltrim(F.col("body"), F.lit("*"))
    system = F.col("body").startswith("**") & (after.startswith(" " + SYSTEM_EVENTS[0]) | after.startswith(" " + SYSTEM_EVENTS[1]) | after.startswith(" " + SYSTEM_EVENTS[2]))
    kind = (
        F.when(bare & (F.trim("value") == ""), "blank")
        .when(F.col("listed").isNotNull(), "facts")
        .when(bare & _announces(F.col("value")), "row")
        .when(bare, "more")
        .when(loot | channelled | system, "row")
        .otherwise("lost")
    )
    channel = F.when(F.col("listed").isNotNull(), "item").when(bare, "system").when(loot, "item").when(channelled, F.col("named")).otherwise("system")
    announced = ~bare & ~loot & _announces(F.col("body"))
    channel = F.when(announced & ~F.contains("body", F.lit("] ")) & (F.length("body") == F.length("named") + 2), F.lit("system")).otherwise(channel)
    speaker = F.when(speaks, F.substring_index(rest, ": ", 1))
    said = F.when(speaks, rest.substr(F.length(speaker) + 3, F.length(rest))).when(F.col("listed").isNotNull(), F.col("listed")).when(bare, F.col("value")).when(loot, _loot(F.col("body"))).when(channelled & (channel != "system"), rest).otherwise(F.col("body"))
    return out.select(*lines.columns, kind.alias("kind"), F.coalesce("stamp", F.lit("")).alias("ts"), channel.alias("channel"), speaker.alias("speaker"), said.alias("said"))


def folded(lines: DataFrame, file: str = "source_file", number: str = "line_no", piece: str | None = None) -> DataFrame:
    """(ts, channel, speaker, text, source_file, line_no) of each row of each file; lines: file, number, value and, if files come in pieces, piece.

    A facts-only line is joined to the row before it if that row has a speaker, else it is a row of its own, so whether it begins one
    depends on the last line that surely began one and on whether other such facts stand between: a facts line after a row without
    a speaker begins a row without one, and so do all facts after it up to the next sure beginning. Lines before a file's first row are dropped.

    A piece is a stretch of a file's lines; its number grows along the file. All that a piece needs from those before it is whether the
    last sure beginning had a speaker and how many rows began, and all that it gives is the same: two scans over the pieces' summaries
    carry it, and no task holds more than a piece (or a row) of a file. Without pieces each file is one.
    """
    cut = F.lit(0).cast("long") if piece is None else F.col(piece).cast("long")
    known = classified(lines.withColumn("_piece", cut)).filter(~F.col("kind").isin("blank", "lost"))
    sofar = Window.partitionBy(file, "_piece").orderBy(number).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(file).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)  # over summaries
    sure = F.when(F.col("kind") == "row", F.col("speaker").isNotNull())
    ends = known.groupBy(file, "_piece").agg(F.max_by(sure, F.when(sure.isNotNull(), F.col(number))).alias("_end"))
    carried = ends.select(file, "_piece", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    known = known.withColumn("_social", F.last(sure, ignorenulls=True).over(sofar)).join(carried, [file, "_piece"])
    social = F.coalesce("_social", "_carried", F.lit(False))
    marked = known.withColumn("begins", (F.col("kind") == "row") | ((F.col("kind") == "facts") & ~social)).drop("_social", "_carried")
    counts = marked.groupBy(file, "_piece").agg(F.sum(F.col("begins").cast("long")).alias("_n"))
    counts = counts.select(file, "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    marked = marked.withColumn("_row", F.sum(F.col("begins").cast("long")).over(sofar)).join(counts, [file, "_piece"])
    marked = marked.withColumn("row", F.col("_row") + F.col("_before")).filter("row > 0")
    part = F.struct(F.col(number).alias("at"), F.when(F.col("begins"), F.col("said")).otherwise(F.trim("value")).alias("said"))
    first = lambda c: F.min(F.when(F.col("begins"), F.col(c)))
    rows = marked.groupBy(file, "row").agg(first("ts").alias("ts"), first("channel").alias("channel"), first("speaker").alias("speaker"), F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["said"]), " ").alias("text"), first(number).alias("line_no"))
    return rows.select("ts", "channel", "speaker", "text", F.col(file).alias("source_file"), "line_no")
