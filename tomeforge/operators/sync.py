"""Which pages to fetch, keep or purge; stable file names; refined ledger actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: File names that some systems reserve.
RESERVED = ("CON", "NUL", "AUX", "PRN", "COM1", "COM2", "COM3", "COM4", "COM5", "COM6", "COM7", "COM8", "COM9", "LPT1", "LPT2", "LPT3", "LPT4", "LPT5", "LPT6", "LPT7", "LPT8", "LPT9")
LONGEST_NAME = 150


def stable_name(title: Column) -> Column:
    """Letters, digits, - and _ of a title (blanks as _), cut, and 8 hex digits of its SHA-256."""
    safe = F.translate(F.rtrim(F.regexp_replace(title, r"[^\p{L}\p{N} _-]", "")), " ", "_")
    stem = F.rtrim(F.substring(F.when(safe == "", "page").otherwise(safe), 1, LONGEST_NAME), F.lit(" ."))
    stem = F.when(F.upper(stem).isin(*RESERVED), F.concat(stem, F.lit("_"))).otherwise(stem)
    return F.concat(stem, F.lit("_"), F.substring(F.sha2(title.cast("binary"), 256), 1, 8), F.lit(".txt"))


def page_plan(current: DataFrame, known: DataFrame, files: DataFrame) -> DataFrame:
    """(title, action) for every current title: blocked, skip, adopt (a file that isn't known yet) or download.

    current: title, touched, blocked; known: title, touched; files: title of each that isn't empty. Titles are unique in each.
    """
    both = current.join(known.select("title", F.col("touched").alias("stored"), F.lit(True).alias("is_known")), "title", "left")
    both = both.join(files.select("title", F.lit(True).alias("has_file")), "title", "left")
    action = F.when(F.col("blocked"), "blocked").when(F.col("has_file") & F.col("stored").eqNullSafe(F.col("touched")), "skip").when(F.col("has_file") & F.col("is_known").isNull(), "adopt").otherwise("download")
    return both.select("title", action.alias("action"))


def purge_plan(current: DataFrame, known: DataFrame, disk: DataFrame) -> DataFrame:
    """(filename, reason) of files to delete: stale (known, of no current title) or orphan (on disk, not known)."""
    stale = known.join(current, "title", "left_anti").filter("filename is not null").select("filename", F.lit("stale").alias("reason"))
    orphan = disk.join(known, "filename", "left_anti").select("filename", F.lit("orphan").alias("reason"))
    return stale.unionByName(orphan).distinct()


def ordered_distinct(rows: DataFrame, key: str, place: str) -> DataFrame:
    """Each key at its first place."""
    return rows.groupBy(key).agg(F.min(place).alias(place))


#: The phrases of a stall's messages.
PAID, HIRING, TERMS = " paid ", " Councils to hire ", (" for 24 hours", " for another 24 hours")
NOTED, HID, HIDDEN, TAGGED = " sent a note to shop owner", " hid ", " from shoppers", " set shop tag to "


def _after(x: Column, phrase: str) -> Column:
    return x.substr(F.length(F.substring_index(x, phrase, 1)) + 1 + len(phrase), F.length(x))


def refined_actions(events: DataFrame) -> DataFrame:
    """Unknown actions named by what their message says; only the field that the message states is filled."""
    raw = F.coalesce(F.col("raw_message"), F.lit(""))
    fee, person = F.substring_index(_after(raw, PAID), HIRING, 1), _after(raw, HIRING)
    hired = F.contains(raw, F.lit(PAID)) & F.contains(raw, F.lit(HIRING)) & fee.rlike("^[0-9]+$") & (F.instr(person, TERMS[0]) + F.instr(person, TERMS[1]) > 1)
    item = F.substring_index(_after(raw, HID), HIDDEN, 1)
    kind = (
        F.when(F.col("action") != "unknown", None)
        .when(hired & (F.instr(raw, PAID) > 1), "hire_stall")
        .when(raw.endswith(NOTED) & (F.length(raw) > len(NOTED)), "visitor_note")
        .when((F.instr(raw, HID) > 1) & raw.endswith(HIDDEN) & (item != ""), "hid_item")
        .when((F.instr(raw, TAGGED) > 1) & (_after(raw, TAGGED) != ""), "shop_tag")
    )
    out = events.withColumn("kind", kind)
    take = lambda name, value: F.when(F.col("kind") == name, value)
    fields = {
        "price_total": F.coalesce(take("hire_stall", fee).cast(events.schema["price_total"].dataType), F.col("price_total")),
        "player": F.coalesce(take("visitor_note", F.substring_index(raw, NOTED, 1)), F.col("player")),
        "item": F.coalesce(take("hid_item", item), take("shop_tag", _after(raw, TAGGED)), F.col("item")),
        "action": F.coalesce("kind", "action"),
    }
    return out.withColumns(fields).drop("kind")


def collision_suffix(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The second of equal keys gets _2, the third _3."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn(key, F.when(n > 1, F.concat(F.col(key), F.lit("_"), n.cast("string"))).otherwise(F.col(key)))
