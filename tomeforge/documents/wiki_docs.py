"""Wiki pages as documents: sections and table rows, where creatures live, growing tables, and texts gathered by topic.

Pages are (title, text). Nested markup needs a parser, so a page is taken apart in Python, many pages an Arrow batch; all else is
column expressions. Headings and wordings are fixed values.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeforge.documents.builders import document, lines, optional
from tomeforge.documents.computed import HARVESTED_ON
from tomeforge.functions.text import article
from tomeforge.functions.wiki import cell_text, plain, prose
from tomeforge.operators.sync import collision_suffix
from tomeforge.runtime import ship
from tomeforge.sinks.tables import Store

#: Characters of a section at least, of a row's or a table's text at most, and of a creature's description.
LEAST, MOST, DESCRIPTION = 50, 950, 220
#: Topics and what a page says of them.
TOPICS = {"area_levels": ("level.*area", "area.*level", "zone.*level"), "skill_trainers": ("unlock.*level", "trains.*level", "teaches.*level"), "crafting_progressions": ("requires level", "skill level.*req")}


def cut_at_headings(text: str) -> list[tuple[str, str]]:
    """(heading, text) of the parts of a page; the part before the first heading has none."""
    out: list[tuple[str, list[str]]] = [("", [])]
    for line in text.split("\n"):
        bare = line.rstrip()
        level = len(bare) - len(bare.lstrip("="))
        if 2 <= level <= 6 and bare.endswith("=" * level) and len(bare) > 2 * level and "=" not in bare[level:-level]:
            out.append((plain(bare[level:-level].strip()).strip(), []))
        else:
            out[-1][1].append(line)
    return [(h, "\n".join(rows)) for h, rows in out]


def take_tables(text: str) -> tuple[str, list[list[list[str]]]]:
    """The text without its tables, and each table's data rows as cells; rows of headers alone are no data."""
    rest, tables, held = [], [], None
    for line in text.split("\n"):
        bare = line.strip()
        if held is None and bare.startswith("{|"):
            held = [[]]
        elif held is not None and bare.startswith("|}"):
            rows = [[cell_text(c) for _, c in row] for row in held if any(kind == "|" for kind, _ in row)]
            tables.append([r for r in rows if any(r) and not (len(r) == 1 and ("{{" in r[0] or not r[0]))])
            held = None
        elif held is None:
            rest.append(line)
        elif bare.startswith("|-"):
            held.append([])
        elif bare.startswith(("|+", "")) and bare[:1] in ("|", "!") and not bare.startswith("|+"):
            for cell in re.split(r"\|\||!!", bare[1:]):
                before, sign, after = cell.partition("|")
                held[-1].append((bare[0], after if sign and "[[" not in before and "{{" not in before else cell))
        elif held[-1]:
            kind, cell = held[-1][-1]
            held[-1][-1] = (kind, f"{cell}\n{line}")
    return "\n".join(rest), [t for t in tables if t]


def page_parts(title: str, text: str) -> Iterator[tuple[str, str, str, str]]:
    """(id, part, section, text) of a page's sections, and of its tables: what each covers, and its rows. Templates that carry facts
    become text first; as one may hold a heading or a table, the page is cut after that."""
    safe = "wiki_" + re.sub(r"[\W_]", "_", title)
    place = 0
    for heading, body in cut_at_headings(prose(text)):
        rest, tables = take_tables(body)
        for rows in tables:
            yield f"{safe}_table_{place}_coverage", "coverage", heading, f"{title} table covers: {', '.join(r[0] for r in rows if r[0])}"[:MOST]
            for i, r in enumerate(rows):
                yield f"{safe}_table_{place}_row_{i}", "row", heading, f"{title} table row: {' | '.join(r)}"[:MOST]
            place += 1
        said = re.sub(r"\s*\n\s*\n\s*", "\n\n", re.sub(r"<!--.*?(-->|$)", " ", plain(re.sub(r"<!--.*?(-->|$)", " ", rest, flags=re.S), title), flags=re.S)).strip()
        if len(said) >= LEAST:
            tail = re.sub(r"[ /]", "_", heading.replace("&", "and"))[:80]
            yield f"wiki_{title}_{tail}" if heading else f"wiki_{title}", "section", heading, said


_PARTS = "parts array<struct<id: string, part: string, section: string, text: string>>"


def parsed(pages: DataFrame) -> DataFrame:
    """Each row of pages (title, text and more) with its parts in place of its text: one row a page, so a page without parts is there too."""
    rest = [c for c in pages.columns if c != "text"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            parts = [[dict(zip(("id", "part", "section", "text"), p, strict=True)) for p in page_parts(t, x)] if t and x else [] for t, x in zip(f["title"], f["text"], strict=True)]
            yield f[rest].assign(parts=parts)

    ship(pages.sparkSession)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields if f.name != "text")
    return pages.select(*rest, "text").mapInPandas(run, f"{kinds}, {_PARTS}")


def as_documents(pages: DataFrame) -> DataFrame:
    """Documents of parsed pages (title, parts)."""
    parts = pages.select("title", F.posexplode("parts").alias("place", "p")).select("title", "place", "p.*")
    parts = collision_suffix(parts, "id", ["title", "place"])
    return document(parts, F.col("id"), "wiki", "wiki", F.col("title"), F.col("text"), section=F.col("section"), part=F.col("part"))


def page_documents(pages: DataFrame) -> DataFrame:
    """wiki_<title>[_<heading>], …_table_<i>_coverage and …_table_<i>_row_<r>; equal ids get _2, _3."""
    return as_documents(parsed(pages.select("title", "text")))


#: Fixed value: number of the way in which pages are parsed; pages that were parsed in another way are parsed again.
PARSER = 2


def cached_pages(store: Store, pages: DataFrame, parser: int = PARSER, name: str = "page_cache") -> DataFrame:
    """Parsed pages (title, stamp, parser, parts, fresh) of pages (title, text, stamp; titles are unique).

    A page whose title, stamp and parser the table `name` has is taken from it, and only the others are parsed (fresh). Then the
    table holds the present pages and no others. A null stamp says that nothing is known of a page, so it is parsed each time.
    """
    number = F.lit(parser)
    if store.exists(name):
        known = store.read(name).filter(F.col("parser") == number).drop("fresh", "parser")
        kept = known.join(pages.select("title", "stamp"), ["title", "stamp"]).select("title", "stamp", "parts", F.lit(False).alias("fresh"))
        left = pages.join(kept.select("title"), "title", "left_anti")
    else:
        kept, left = None, pages
    fresh = parsed(left.select("title", "stamp", "text")).withColumn("fresh", F.lit(True))
    now = fresh if kept is None else kept.unionByName(fresh)
    store.replace(name, now.select("title", "stamp", number.alias("parser"), "parts", "fresh"))
    return store.read(name)


def _template_values(name: str, value: str) -> Column:
    """The values of one parameter in all templates of a name, links shown as their text."""
    blocks = F.slice(F.split("text", r"\{\{" + name.replace(" ", "[ \\t]+")), 2, 1 << 20)
    inner = F.transform(blocks, lambda b: F.substring_index(F.regexp_replace(b, r"\[\[(?:[^\]|]*\|)?([^\]|]+)\]\]", "$1"), "}}", 1))
    found = F.transform(inner, lambda b: F.filter(F.split(b, r"\|"), lambda p: F.trim(F.substring_index(p, "=", 1), F.lit(" \n\t")) == value))
    return F.transform(F.flatten(found), lambda p: F.trim(F.regexp_replace(p.substr(F.instr(p, "=") + 1, F.length(p)), r"\s+", " ")))


def creatures(pages: DataFrame) -> DataFrame:
    """creature_<title>: the kind of a creature and the places where it lives, of pages that name any place."""
    marks = F.transform(F.slice(F.split("text", r"\[\[Category:"), 2, 1 << 20), lambda x: F.substring_index(x, "]]", 1))
    by_category = F.transform(F.filter(marks, lambda m: m.endswith(" Creatures")), lambda m: F.trim(F.substring_index(m, " Creatures", 1)))
    places = F.array_distinct(F.filter(F.concat(_template_values("MOB Location", "area"), by_category), lambda p: p != ""))
    lead = F.regexp_replace(F.regexp_replace("text", r"(?s)<!--.*?(-->|$)", " "), r"(?s)\{\{[^{}]*\}\}", " ")
    lead = F.regexp_replace(F.split_part(lead, F.lit("=="), F.lit(1)), r"\[\[Category:[^\]]*\]\]", " ")
    lead = F.regexp_replace(F.regexp_replace(lead, r"\[\[(?:[^\]|]*\|)?([^\]|]+)\]\]", "$1"), r"'''|__[A-Z]+__|[{}|]+", " ")
    lead = F.trim(F.substring(F.trim(F.regexp_replace(lead, r"\s+", " ")), 1, DESCRIPTION))
    rows = pages.select("title", places.alias("places"), F.coalesce(F.try_element_at(_template_values("MOB infobox", "type"), F.lit(1)), F.lit("")).alias("kind"), F.when(lead.rlike("[A-Za-z]{2}"), lead).otherwise("").alias("lead")).filter("size(places) > 0")
    where = F.array_join("places", ", ")
    last = F.when(F.col("kind") != "", F.concat("title", F.lit(" is "), article(F.col("kind")), F.lit(" "), "kind", F.lit(" creature. It can be found in "), where, F.lit("."))).otherwise(F.concat("title", F.lit(" can be found in "), where, F.lit(".")))
    body = F.concat(F.lit("Creature Locations: "), "title", optional("\nType: ", F.col("kind")), F.lit("\nLocations: "), where, optional("\nDescription: ", F.col("lead")), F.lit("\n"), last)
    return document(rows, F.concat(F.lit("creature_"), F.replace("title", F.lit(" "), F.lit("_"))), "wiki", "creatures", F.col("title"), body, creature_type=F.col("kind"), locations=F.array_join("places", " | "))


def growing(pages: DataFrame) -> DataFrame:
    """summary_wiki_growing_<title>: a line for each item of a page's growing table, whose cells are level, time and four grades."""
    rows = pages.filter(F.contains("text", F.lit("Growing Time"))).select("title", F.posexplode(F.split("text", "\n")).alias("place", "row")).filter(F.contains("row", F.lit("{{Item|")))
    cells = F.transform(F.split("row", r"\|\|"), lambda c: F.trim(c))
    item = F.trim(F.substring_index(F.substring_index(F.substring_index("row", "{{Item|", -1), "}}", 1), "|", 1))
    rows = rows.select("title", "place", item.alias("item"), cells.alias("c")).filter((F.size("c") >= 7) & (F.col("item") != "") & (F.array_join(F.slice("c", 2, 6), "") != ""))
    cell = lambda i, otherwise="": F.coalesce(F.nullif(F.element_at("c", i), F.lit("")), F.lit(otherwise))
    skill = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in HARVESTED_ON.items() for x in p)), F.col("title")), F.col("title"))
    line = F.concat(F.lit("- "), "item", F.lit(": "), skill, F.lit(" level "), cell(2, "N/A"), F.lit("; grows in "), cell(3, "unknown"), F.lit("; adequate substrate "), cell(4, "unknown"), F.lit("; very well in "), cell(5, "unknown"), F.lit("; moon phases: robust in "), cell(6), F.when(~cell(7).isin("", "-"), F.concat(F.lit(", poor in "), cell(7))).otherwise(""))
    listed = rows.groupBy("title").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]).alias("all"))
    ident = F.concat(F.lit("summary_wiki_growing_"), F.replace(F.lower("title"), F.lit(" "), F.lit("_")))
    return document(listed, ident, "summary", "summaries", F.concat("title", F.lit(" Growing Table Summary")), F.concat("title", F.lit(" growing table (per item, wiki):\n"), lines(F.col("all"))))


def topics(pages: DataFrame, least: int = 3, shown: int = 5) -> DataFrame:
    """(topic, n, text) of topics that enough files speak of: the starts of the first files by name. pages: filename, text."""
    found = [F.when(F.exists(F.array(*(F.lit(p) for p in patterns)), lambda p: F.rlike(F.lower("text"), p)), F.lit(t)) for t, patterns in TOPICS.items()]
    each = pages.select("filename", F.substring("text", 1, 200).alias("start"), F.explode(F.array_compact(F.array(*found))).alias("topic"))
    counts = each.groupBy("topic").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    ranked = each.withColumn("_r", F.row_number().over(Window.partitionBy("topic").orderBy("filename", "start"))).filter(F.col("_r") <= shown)
    listed = ranked.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("filename", "start"))).alias("first")).join(counts, "topic")
    first = F.transform("first", lambda x: F.concat(F.lit("Source: "), x["filename"], F.lit("\n"), x["start"], F.lit("\n\n")))
    head = F.concat(F.lit("=="), F.initcap(F.replace("topic", F.lit("_"), F.lit(" "))), F.lit("==\nAuto-generated from "), F.col("n").cast("string"), F.lit(" wiki sources.\n\n"))
    return listed.select("topic", F.col("n").cast("int").alias("n"), F.concat(head, F.array_join(first, "")).alias("text"))


def refresh_topics(store: Store, pages: DataFrame, name: str = "topics", **bounds: int) -> DataFrame:
    """(topic, change) of the topics that came, changed or went since the table `name` was written; it is written only if there are any."""
    now = topics(pages, **bounds)
    old = store.read(name) if store.exists(name) else now.limit(0)
    both = now.select("topic", F.col("text").alias("a")).join(old.select("topic", F.col("text").alias("b")), "topic", "full")
    change = F.when(F.col("b").isNull(), "created").when(F.col("a").isNull(), "gone").when(F.col("a") != F.col("b"), "updated")
    changes = both.select("topic", change.alias("change")).filter("change is not null")
    found = changes.collect()  # of a few topics
    if found or not store.exists(name):
        store.replace(name, now)
    return pages.sparkSession.createDataFrame(found, "topic string, change string")
