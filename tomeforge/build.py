"""The store from its sources, and from then on only what has changed.

The work is a graph of steps. A step's stamp is made of its own revision, of the files it reads (path, length, time) and of the stamps of
the steps it needs; a table comes into force together with its stamp. So a refresh runs a step only if something before it is not
what it was, and one that was cut off goes on with the first step that has not been finished.

    python -m tomeforge.build --store DIR [--tables DIR] [--wiki DIR] [--titles FILE] [--curated DIR] [--chat DIR]
"""

from __future__ import annotations

import argparse
import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeforge.documents import builders, computed, wiki_docs
from tomeforge.operators import chat, search
from tomeforge.sinks.tables import Store
from tomeforge.sources import files, game_tables

#: Files of records that have documents of their own kind, beside the mapped ones.
RECORDS = ("lorebooks", "directedgoals", "areas", "landmarks", "playertitles", "storagevaults", "ai", "tsysclientinfo", "abilitykeywords")
SOURCES = ("items", "recipes", "abilities")


@dataclass(frozen=True)
class Step:
    """make: the table from the build; needs: steps whose tables it reads; reads: (folder or file, pattern) of files it reads."""

    name: str
    make: Callable[[Build], DataFrame | None]
    needs: tuple[str, ...] = ()
    reads: tuple[tuple[str, str], ...] = ()
    revision: int = 1


@dataclass
class Build:
    """paths: where the sources are (tables, wiki, titles, curated, chat); what is not there gives no rows."""

    spark: SparkSession
    store: Store
    paths: dict[str, str] = field(default_factory=dict)

    def raw(self, name: str) -> DataFrame:
        """(key, id, raw) of a JSON table."""
        return files.json_table(self.spark, f"{self.paths.get('tables', '/nowhere')}/{name}.json")

    def table(self, name: str) -> DataFrame:
        return self.store.read(name)

    def index(self, name: str) -> search.Index:
        return search.Index(self.spark, self.store.path(f"{name}_index"), "id")

    def files_stamp(self, folder: str, pattern: str) -> str:
        """What the files are by path, length and time; their contents are not read."""
        found = files.listed(self.spark, folder, pattern)
        n, total = found.agg(F.count(F.lit(1)), F.sum(F.xxhash64("source_file", "length", "stamp").cast("decimal(38,0)"))).first()
        return f"{n}:{total}"

    def run(self, steps: list[Step]) -> list[str]:
        """The names of the steps that had to run, in the order in which they did."""
        by_name, stamps, ran = {s.name: s for s in steps}, {}, []

        def finish(name: str, above: tuple[str, ...] = ()) -> str:
            if name in above:
                raise ValueError(f"a step needs itself: {' > '.join([*above, name])}")
            if name not in stamps:
                s = by_name[name]
                before = [finish(n, (*above, name)) for n in s.needs]
                made_of = json.dumps([s.name, s.revision, [self.files_stamp(*r) for r in s.reads], before])
                stamp = hashlib.sha256(made_of.encode()).hexdigest()[:24]
                if (self.store.state(name) or {}).get("stamp") != stamp:
                    made = s.make(self)
                    # a step that keeps its own tables leaves a row that says so
                    self.store.replace(name, made if made is not None else self.spark.createDataFrame([(name,)], "step string"), stamp=stamp)
                    ran.append(name)
                stamps[name] = stamp
            return stamps[name]

        for s in steps:
            finish(s.name)
        return ran


def _documents(b: Build) -> DataFrame:
    raw = {n: b.raw(n) for n in (*game_tables.MAPPINGS, *RECORDS, *(f"sources_{k}" for k in SOURCES))}
    pages = b.table("wiki_pages")
    parts = [
        builders.items(raw["items"], raw["attributes"], raw["recipes"], computed.harvest_levels(pages)),
        builders.recipes(raw["recipes"], raw["items"]),
        builders.item_uses(raw["itemuses"], raw["items"]),
        computed.gift_lists(raw["items"], raw["sources_items"], raw["npcs"]),
        computed.skill_profiles(raw["skills"], raw["abilities"], raw["recipes"], raw["quests"], raw["npcs"], raw["xptables"], raw["advancementtables"]),
        computed.leveling_guides(raw["skills"], raw["recipes"], raw["xptables"]),
        computed.recipe_rankings(raw["recipes"]),
        computed.better_rankings(computed.gathering_rankings(raw["items"], raw["recipes"]), computed.harvest_rankings(pages)),
        computed.combat_xp(raw["advancementtables"]),
        wiki_docs.as_documents(b.table("pages_parsed")),
        wiki_docs.creatures(pages),
        wiki_docs.growing(pages),
    ]
    alone = {
        "skills": builders.skills, "quests": builders.quests, "abilities": builders.abilities, "npcs": builders.npcs, "effects": builders.effects, "lorebooks": builders.lorebooks,
        "directedgoals": builders.goals, "areas": builders.areas, "landmarks": builders.landmarks, "playertitles": builders.titles, "storagevaults": builders.vaults,
        "advancementtables": builders.advancement, "ai": builders.behaviours, "attributes": builders.attributes, "tsysclientinfo": builders.treasures, "xptables": builders.xp_tables,
        "abilitykeywords": builders.ability_keywords,
    }
    parts += [build(raw[n]) for n, build in alone.items()]
    parts += [builders.source_entries(raw[f"sources_{k}"], k, raw[k], raw["npcs"]) for k in SOURCES]
    wanted = ("id", "type", "tbl", "name", "text")
    every = [p.select(*wanted) for p in (*parts, b.table("curated"))]
    # an id that two builders give is one document: the first by text
    return builders.assembled(every).groupBy("id").agg(F.min(F.struct("text", "type", "tbl", "name")).alias("d")).select("id", "d.type", "d.tbl", "d.name", "d.text")


def _indexed(table: str, *columns: str) -> Callable[[Build], None]:
    """Brings the table's index to what the table is now: rows that came or changed are indexed, those that went are taken out."""

    def make(b: Build) -> None:
        now, index = b.table(table), b.index(table)
        if index.manifest()["number"] < 0:
            index.build(now, *columns)
            return
        same = lambda d: d.withColumn("_h", F.xxhash64(*sorted(c for c in now.columns if c != "id")))
        old = same(index.documents()).select("id", "_h")
        index.refresh(same(now).join(old, ["id", "_h"], "left_anti").drop("_h"), old.join(now.select("id"), "id", "left_anti").select("id"))

    return make


def _chat(b: Build) -> None:
    """Rows of log files that are new or not what they were take the place of those of before."""
    now = files.listed(b.spark, b.paths.get("chat", "/nowhere"), "Chat-*.log").select("source_file", "stamp", "length")
    known = b.table("chat_files") if b.store.exists("chat_files") else now.limit(0)
    changed = now.join(known, ["source_file", "stamp", "length"], "left_anti")
    lines = files.log_pieces(b.spark, b.paths.get("chat", "/nowhere")).join(changed.select("source_file"), "source_file", "left_semi")
    b.store.replace_files("chat_events", chat.folded(lines, piece="piece"))
    b.store.replace("chat_files", now)


def _names(b: Build) -> DataFrame:
    rows = game_tables.entity_names({n: b.table(n) for n in game_tables.MAPPINGS})
    # ids that stay the same from run to run; rows that are the same in all else are one
    return rows.distinct().withColumn("id", F.xxhash64("name", "type", "snippet")).select("id", "name", "type", "snippet")


def _pages(b: Build) -> DataFrame:
    titles = files.title_map(b.spark, b.paths["titles"]) if "titles" in b.paths else None
    return files.wiki_pages(b.spark, b.paths.get("wiki", "/nowhere"), titles)


def _parsed(b: Build) -> DataFrame:
    """Pages by title; only those whose text is not what it was are parsed."""
    pages = b.table("wiki_pages").select("title", "text", F.md5("text").alias("stamp"))
    return wiki_docs.cached_pages(b.store, pages).select("title", "parts")


def _counts(b: Build) -> DataFrame:
    parts = [b.table(n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("tbl"), "n") for n in (*game_tables.MAPPINGS, "documents", "entity_names", "wiki_pages")]
    return reduce(DataFrame.unionByName, parts)


def steps(paths: dict[str, str]) -> list[Step]:
    """All steps, those whose tables others need first."""
    one = lambda name: ((paths["tables"], f"{name}.json"),) if "tables" in paths else ()
    at = lambda key, pattern: ((paths[key], pattern),) if key in paths else ()
    mapped = tuple(game_tables.MAPPINGS)
    out = [Step(n, lambda b, n=n: game_tables.mapped(n, b.raw(n)), reads=one(n)) for n in mapped]
    out += [
        Step("recipe_ingredients", lambda b: game_tables.ingredients(b.raw("recipes")), reads=one("recipes")),
        Step("sources", lambda b: game_tables.sources({k: b.raw(f"sources_{k}") for k in SOURCES}), reads=tuple(r for k in SOURCES for r in one(f"sources_{k}"))),
        Step("xp_levels", lambda b: game_tables.xp_levels(b.table("xptables")), ("xptables",)),
        Step("wiki_pages", _pages, reads=(*at("wiki", "*.txt"), *((paths["titles"].rpartition("/")[::2],) if "titles" in paths else ()))),
        Step("pages_parsed", _parsed, ("wiki_pages",), revision=wiki_docs.PARSER),
        Step("curated", lambda b: files.curated(b.spark, b.paths.get("curated", "/nowhere")), reads=at("curated", "*_curated.txt")),
        Step("chat", _chat, reads=at("chat", "Chat-*.log")),
        Step("entity_names", _names, mapped),
        Step("documents", _documents, ("pages_parsed", "wiki_pages", "curated"), reads=at("tables", "*.json")),
        Step("documents_indexed", _indexed("documents", "text", "name"), ("documents",)),
        Step("names_indexed", _indexed("entity_names", "name", "snippet"), ("entity_names",)),
        Step("counts", _counts, ("documents", "entity_names", "wiki_pages", *mapped)),
    ]
    return out


def refresh(spark: SparkSession, store: str, **paths: str) -> list[str]:
    """Builds the store, or brings it up to date; the steps that ran."""
    own = {k: v.rstrip("/") for k, v in paths.items() if v}
    return Build(spark, Store(spark, store), own).run(steps(own))


def mirror(spark: SparkSession, store: Store, path: str, growing: dict[str, str], gated: dict[str, str], whole: tuple[str, ...] = ()) -> dict[str, int]:
    """Brings the store's copies of a SQLite file's tables up to date; how many rows each took (tables that the file lacks take none).

    growing: tables that only get new rows, and their id; gated: tables that change as a whole, and the column whose largest value says when;
    whole: tables that are copied each time. A table whose columns have changed is emptied and loaded anew.
    """
    there, taken = files.sqlite_tables(path), {}
    for name in (*growing, *gated, *whole):
        if name not in there:
            taken[name] = 0
            continue
        rows = files.sqlite_table(spark, path, name)
        if store.exists(name) and store.read(name).dtypes != rows.dtypes:
            store.converge(name, rows)
        if name in growing:
            taken[name] = store.append_new(name, rows, growing[name])
        elif name in gated:
            newest = rows.agg(F.max(gated[name]).cast("string")).first()[0]
            taken[name] = store.copy_if_newer(name, rows, newest or "")
        else:
            store.replace(name, rows)
            taken[name] = store.read(name).count()
    return taken


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--store", required=True)
    for name in ("tables", "wiki", "titles", "curated", "chat"):
        p.add_argument(f"--{name}", default="")
    args = vars(p.parse_args())
    ran = refresh(SparkSession.builder.getOrCreate(), args.pop("store"), **args)
    print("\n".join(ran) if ran else "nothing has changed")


if __name__ == "__main__":
    main()
