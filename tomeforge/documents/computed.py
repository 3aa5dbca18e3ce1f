"""Documents that are computed over whole tables: rankings, comparisons by level, gifts, skill profiles and leveling guides.

Each takes the (key, id, raw) rows of the tables it joins and gives documents as `builders` does. Headings and wordings are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeforge.documents.builders import document, entries, lines, objects, optional, said
from tomeforge.functions.text import spaced_words
from tomeforge.operators.relational import runs
from tomeforge.sources.game_tables import parsed, strings, text

#: How many recipes and quests a profile lists, how many recipes and characters a leveling guide has.
RECIPES, QUESTS, LADDER, GUIDE = 25, 25, 60, 8192
#: Skills by the first part of a numbered keyword, and by the wiki page of their harvest table.
GATHERED_BY, HARVESTED_ON = {"Mushroom": "Mycology", "Skin": "Tanning"}, {"Fishing": "Fishing", "Foraging": "Foraging", "Mining": "Mining", "Mycology": "Mycology", "Myconic": "Mycology"}
#: Keywords that say too little of a gift.
VAGUE = ("Loot", "Equipment", "Consumable", "Document", "Book", "MacGuffin", "QuestItem", "NotForSale", "Unusual", "Undeletable")
#: The table column that combat experience is in, and the highest level.
COMBAT_XP, TOP_LEVEL = "MONSTER_COMBAT_XP_VALUE", 200


def _snake(x: Column) -> Column:
    return F.replace(F.lower(x), F.lit(" "), F.lit("_"))


def _summary(rows: DataFrame, ident: Column, name: Column, body: Column) -> DataFrame:
    return document(rows, ident, "summary", "summaries", name, body)


def _ranking(rows: DataFrame, title: str) -> DataFrame:
    """(skill, body) of (skill, level, name): the names of each skill numbered by falling level, equal levels in the order of `place`."""
    each = F.array_sort(F.collect_list(F.struct((-F.col("level")).alias("down"), F.col("place"), F.col("name"))))
    line = lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["name"], F.lit(" ("), (-x["down"]).cast("string"), F.lit(")"))
    return rows.groupBy("skill").agg(each.alias("all")).select("skill", F.concat(F.col("skill"), F.lit(title), F.lit("\n"), lines(F.transform("all", line))).alias("body"))


def recipe_rankings(recipes: DataFrame) -> DataFrame:
    """summary_<skill>: all recipes of a skill by falling level."""
    rows = parsed(recipes).select(text("Skill").alias("skill"), F.coalesce(F.try_variant_get("v", "$.SkillLevelReq", "int"), F.lit(0)).alias("level"), F.col("id").alias("place"), said("Name", F.col("key")).alias("name")).filter("skill <> ''")
    return _summary(_ranking(rows, " recipes ranked by skill level:"), F.concat(F.lit("summary_"), _snake(F.col("skill"))), F.concat("skill", F.lit(" Summary")), F.col("body"))


def gathering_rankings(items: DataFrame, recipes: DataFrame) -> DataFrame:
    """summary_gathering_<skill>: items by the recipe that asks for one of their keywords; of several recipes the last by id."""
    asks = parsed(recipes).select(text("ItemMenuKeywordReq").alias("keyword"), text("Skill").alias("by"), F.coalesce(F.try_variant_get("v", "$.SkillLevelReq", "int"), F.lit(0)).alias("level"), "id").filter("keyword <> ''")
    asks = asks.groupBy("keyword").agg(F.max_by(F.struct("by", "level"), "id").alias("r")).select("keyword", "r.*")
    each = parsed(items).select(F.col("id").alias("place"), text("Name").alias("name"), F.explode(strings("Keywords")).alias("keyword")).filter("name <> ''").join(asks, "keyword")
    numbered, stem = F.col("keyword").rlike("^[A-Za-z]+[0-9]+$"), F.regexp_replace("keyword", "[0-9]+$", "")
    skill = F.when(numbered, F.try_element_at(F.create_map(*(F.lit(x) for p in GATHERED_BY.items() for x in p)), stem)).when(F.col("by") == "Fishing", "Fishing")
    rows = each.withColumn("skill", skill).filter("skill is not null")
    return _summary(_ranking(rows, " items ranked by required skill level:"), F.concat(F.lit("summary_gathering_"), _snake(F.col("skill"))), F.concat("skill", F.lit(" Gathering Summary")), F.col("body"))


def harvest_rows(pages: DataFrame) -> DataFrame:
    """(skill, name, level) of the rows of the wiki's harvest tables: a cell with an item, and a level in the next one."""
    skill = F.try_element_at(F.create_map(*(F.lit(x) for p in HARVESTED_ON.items() for x in p)), F.col("title"))
    cells = pages.select(skill.alias("skill"), F.explode(F.split("text", "\n")).alias("row")).filter("skill is not null")
    cells = cells.select("skill", F.transform(F.split("row", r"\|\|"), lambda c: F.trim(c)).alias("cells")).select("skill", "cells", F.posexplode("cells").alias("i", "cell"))
    after = F.try_element_at("cells", F.col("i") + 2)
    named = F.substring_index(F.substring_index("cell", "{{Item|", -1), "}}", 1)
    rows = cells.filter(F.contains("cell", F.lit("{{Item|")) & F.col("cell").endswith("}}")).select("skill", F.trim(F.substring_index(named, "|", 1)).alias("name"), F.rtrim(F.split_part(after, F.lit(" "), F.lit(1)), F.lit("?")).try_cast("int").alias("level"))
    return rows.filter("level is not null and name <> ''")


def harvest_levels(pages: DataFrame) -> DataFrame:
    """(key, skill, level): for each lower-case name the highest level it takes."""
    return harvest_rows(pages).groupBy(F.lower("name").alias("key")).agg(F.min_by("skill", F.struct(-F.col("level"), F.col("skill"))).alias("skill"), F.max("level").alias("level"))


def harvest_rankings(pages: DataFrame) -> DataFrame:
    """summary_wiki_<skill>: each name once, at its highest level."""
    rows = harvest_rows(pages).groupBy("skill", "name").agg(F.max("level").alias("level"))
    place = F.row_number().over(Window.partitionBy("skill").orderBy(F.desc("level"), F.desc("name")))
    return _summary(_ranking(rows.withColumn("place", place), " items ranked by required skill level (wiki):"), F.concat(F.lit("summary_wiki_"), _snake(F.col("skill"))), F.concat("skill", F.lit(" Wiki Gathering Summary")), F.col("body"))


def better_rankings(gathering: DataFrame, harvested: DataFrame) -> DataFrame:
    """The wiki's rankings, and those of gathering for skills the wiki has none of."""
    skill = lambda prefix: F.regexp_replace("id", f"^{prefix}", "")
    own = gathering.withColumn("_s", skill("summary_gathering_")).join(harvested.select(skill("summary_wiki_").alias("_s")), "_s", "left_anti").drop("_s")
    return own.unionByName(harvested)


def gift_lists(items: DataFrame, sources: DataFrame, npcs: DataFrame) -> DataFrame:
    """summary_gifts_<npc>: what a person accepts, by name, with what kind of thing it is; persons without a record are left out."""
    each = parsed(sources).select("key", F.explode(objects("entries", "type", "npc")).alias("e")).filter("e.type = 'NpcGift'").select("key", F.col("e.npc").alias("npc_key"))
    things = parsed(items).select("key", text("Name").alias("name"), strings("Keywords").alias("keywords")).filter("name <> ''")
    persons = parsed(npcs).select(F.col("key").alias("npc_key"), text("Name").alias("npc")).filter("npc <> ''")
    accepted = each.join(things.select("key", "name"), "key").join(persons, "npc_key").select("npc", "name").distinct()
    kinds = things.select("name", F.explode("keywords").alias("k")).filter(~F.col("k").startswith("Lint_") & ~F.contains("k", F.lit("=")) & ~F.col("k").isin(*VAGUE))
    kinds = kinds.groupBy("name").agg(F.array_sort(F.collect_set(spaced_words(F.col("k")))).alias("labels"))
    shown = F.concat(F.lit("- "), F.col("name"), F.array_join(F.transform(F.coalesce("labels", F.array().cast("array<string>")), lambda x: F.concat(F.lit("\n  (type: "), x, F.lit(")"))), ""))
    listed = accepted.join(kinds, "name", "left").groupBy("npc").agg(F.transform(F.array_sort(F.collect_list(F.struct("name", shown.alias("line")))), lambda x: x["line"]).alias("all"))
    ident = F.concat(F.lit("summary_gifts_"), F.replace(_snake(F.col("npc")), F.lit("'"), F.lit("")))
    return _summary(listed, ident, F.concat("npc", F.lit(" Gift Preferences")), F.concat("npc", F.lit(" accepts these items as gifts:\n"), lines(F.col("all"))))


def combat_xp(advancement: DataFrame) -> DataFrame:
    """combatxp_<level>: what each kind of monster gives at a level, most first; levels with one kind only have nothing to compare."""
    each = parsed(advancement).select(said("InternalName", F.col("key")).alias("name"), F.explode(F.from_json("raw", "map<string,string>")).alias("k", "stats")).filter(F.col("k").startswith("Level_"))
    rows = each.select("name", F.substring_index("k", "_", -1).try_cast("int").alias("level"), F.get_json_object("stats", f"$.{COMBAT_XP}").alias("xp")).filter(f"xp is not null and level between 1 and {TOP_LEVEL}")
    number = F.col("xp").try_cast("double")
    shown = F.when(number == F.floor(number), number.cast("bigint").cast("string")).otherwise(F.col("xp"))
    listed = rows.groupBy("level").agg(F.array_sort(F.collect_list(F.struct((-F.coalesce(number, F.lit(0.0))).alias("down"), F.lower("name").alias("low"), F.concat(F.lit("- "), F.col("name"), F.lit(": "), shown).alias("line")))).alias("all")).filter("size(all) > 1")
    body = F.concat(F.lit("Combat XP by Monster Archetype — Level "), F.col("level").cast("string"), F.lit(f"\n\nThe combat XP ({COMBAT_XP}) earned for defeating each monster archetype at this level, highest first:\n\n"), lines(F.transform("all", lambda x: x["line"])))
    return document(listed, F.concat(F.lit("combatxp_"), F.col("level").cast("string")), "combatxp", "advancementtables", F.concat(F.lit("Combat XP by Monster Archetype, Level "), F.col("level").cast("string")), body, level=F.col("level"))


def _by_skill(rows: DataFrame, line: Column, place: list[Column], cap: int | None, noun: str = "") -> DataFrame:
    """(skill, all, n): the lines of each skill in order, the first `cap`, and how many more there are."""
    columns = {f"o{i}": c for i, c in enumerate(place)}
    each = rows.select("skill", line.alias("line"), *(c.alias(k) for k, c in columns.items()))
    counts = each.groupBy("skill").agg(F.count(F.lit(1)).alias("n"))
    if cap is not None:  # ranked before they are brought together
        first = Window.partitionBy("skill").orderBy(*columns, "line")
        each = each.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= cap)
    listed = each.groupBy("skill").agg(F.transform(F.array_sort(F.collect_list(F.struct(*columns, "line"))), lambda x: x["line"]).alias("all"))
    out = listed.join(counts.withColumn("n", F.col("n").cast("int")), "skill")
    if cap is None:
        return out
    more = F.when(F.col("n") > cap, F.array(F.concat(F.lit("- +"), (F.col("n") - cap).cast("string"), F.lit(f" more {noun}")))).otherwise(F.array().cast("array<string>"))
    return out.withColumn("all", F.concat("all", more))


def skill_recipes(recipes: DataFrame) -> DataFrame:
    """(skill, key, name, req, xp, first, drop_level, drop_pct): a recipe under its own skill and under the one it rewards."""
    own = parsed(recipes).select("key", said("Name", "?").alias("name"), F.coalesce(F.try_variant_get("v", "$.SkillLevelReq", "int"), F.lit(0)).alias("req"), text("RewardSkillXp").alias("xp"), text("RewardSkillXpFirstTime").alias("first"), text("RewardSkillXpDropOffLevel").alias("drop_level"), F.try_variant_get("v", "$.RewardSkillXpDropOffPct", "double").alias("drop_pct"), F.array_distinct(F.array(text("Skill"), text("RewardSkill"))).alias("of"))
    return own.withColumn("skill", F.explode("of")).drop("of").filter("skill <> ''")


def skill_quests(quests: DataFrame) -> DataFrame:
    """(skill, key, name): quests that give experience in a skill or ask for a level of it, at whatever depth of their requirements."""
    rows = parsed(quests).filter(~F.array_contains(strings("Keywords"), "Lint_NotObtainable"))
    gives = F.transform(F.filter(objects("Rewards", "T", "Skill"), lambda r: r["T"] == "SkillXp"), lambda r: r["Skill"])
    # requirements nest to any depth, but one is an object without objects in it: T and Skill stand within one pair of braces
    flat = F.concat_ws(" ", F.get_json_object("raw", "$.Requirements"), F.get_json_object("raw", "$.Objectives[*].Requirements"))
    objects_ = F.filter(F.regexp_extract_all(flat, F.lit(r"(\{[^{}]*\})"), F.lit(1)), lambda o: F.get_json_object(o, "$.T") == "MinSkillLevel")
    asks = F.transform(objects_, lambda o: F.get_json_object(o, "$.Skill"))
    return rows.select("key", said("Name", "?").alias("name"), F.explode(F.array_distinct(F.concat(gives, asks))).alias("skill")).filter("skill <> ''")


def trainers(npcs: DataFrame) -> DataFrame:
    """(skill, key, name, area), once for each person and skill."""
    shape = "array<struct<Type:string,Skills:array<string>>>"
    services = F.filter(F.coalesce(F.try_variant_get("v", "$.Services", shape), F.from_json(F.lit("[]"), shape)), lambda s: s["Type"] == "Training")
    taught = F.array_distinct(F.flatten(F.transform(services, lambda s: F.coalesce(s["Skills"], F.array().cast("array<string>")))))
    return parsed(npcs).select("key", said("Name", F.col("key")).alias("name"), said("AreaFriendlyName").alias("area"), F.explode(taught).alias("skill"))


def synergies(skills: DataFrame) -> DataFrame:
    """(skill, source, name, levels): which skills give bonus levels to a skill, and at which of their levels."""
    rows = parsed(skills).select(F.col("key").alias("source"), said("Name", F.col("key")).alias("name"), F.explode(entries("Rewards")).alias("e"))
    rows = rows.select(F.get_json_object("e.value", "$.BonusToSkill").alias("skill"), "source", "name", F.split_part(F.col("e.key"), F.lit("_"), F.lit(1)).try_cast("int").alias("level")).filter("skill <> '' and level is not null")
    return rows.groupBy("skill", "source", "name").agg(F.array_sort(F.collect_set("level")).alias("levels"))


def advancement_lines(advancement: DataFrame) -> DataFrame:
    """(skill, all): what a skill's levels give, runs of levels with the same values on one line. A run reaches up to the next one; of several tables the first by key."""
    of = parsed(advancement).select("key", "raw", F.regexp_extract("key", "^[0-9]+_([^_]+)$", 1).alias("skill")).filter("skill <> ''")
    of = of.join(of.groupBy("skill").agg(F.min("key").alias("key")), ["skill", "key"])
    each = of.select("skill", F.explode(F.from_json("raw", "map<string,string>")).alias("k", "v")).filter(F.col("k").startswith("Level_") & F.col("v").startswith("{"))
    stats = F.array_join(F.transform(F.array_sort(F.map_entries(F.from_json("v", "map<string,string>"))), lambda e: F.concat(e["key"], F.lit(" = "), e["value"])), ", ")
    levels = each.select("skill", F.substring_index("k", "_", -1).try_cast("int").alias("level"), stats.alias("stats")).filter("level is not null")
    found = runs(levels, ["skill"], ["level"], "stats")
    after = F.lead("first").over(Window.partitionBy("skill").orderBy("first"))
    found = found.withColumn("to", F.coalesce(after - 1, F.col("last")))
    span = F.when(F.col("first") == F.col("to"), F.col("first").cast("string")).otherwise(F.concat(F.col("first").cast("string"), F.lit("-"), F.col("to").cast("string")))
    return _by_skill(found, F.concat(F.lit("- Level "), span, F.lit(": "), F.col("stats")), [F.col("first")], None)


def xp_amounts(xptables: DataFrame) -> DataFrame:
    """(xp_table, amounts) by the table's internal name, the first by key."""
    rows = parsed(xptables).select("key", text("InternalName").alias("xp_table"), F.coalesce(F.try_variant_get("v", "$.XpAmounts", "array<bigint>"), F.array().cast("array<bigint>")).alias("amounts"))
    return rows.groupBy("xp_table").agg(F.min_by("amounts", "key").alias("amounts"))


def skill_profiles(skills: DataFrame, abilities: DataFrame, recipes: DataFrame, quests: DataFrame, npcs: DataFrame, xptables: DataFrame, advancement: DataFrame) -> DataFrame:
    """skillprofile_<key>: all that is known of a skill, in sections that are left out where there is nothing."""
    own = parsed(abilities).filter(~F.array_contains(strings("Keywords"), "Lint_MonsterAbility"))
    some = lambda x, before, after="": F.when(F.coalesce(x, F.lit("0")) != "0", F.concat(F.lit(before), x, F.lit(after)))
    facts = F.concat_ws(". ", F.nullif(said("Description"), F.lit("")), some(text("PvE.PowerCost"), "Power "), some(text("ResetTime"), "Reuse ", "s"), F.when(F.size(strings("ItemKeywordReqs")) > 0, F.concat(F.lit("Requires "), F.array_join(strings("ItemKeywordReqs"), ", "))))
    moves = own.select(text("Skill").alias("skill"), "id", "key", F.concat(F.lit("- "), said("Name", F.col("key")), optional(" — ", facts)).alias("line")).filter("skill <> ''")
    parts = {
        "Abilities": _by_skill(moves, F.col("line"), [F.col("id"), F.col("key")], None),
        "Advancement": advancement_lines(advancement),
        "Recipes": _by_skill(skill_recipes(recipes), F.concat(F.lit("- "), F.col("name"), F.lit(" (level "), F.col("req").cast("string"), F.lit(")")), [F.col("req"), F.col("name")], RECIPES, "recipes"),
        "Quests": _by_skill(skill_quests(quests), F.concat(F.lit("- "), F.col("name")), [F.col("key")], QUESTS, "quests"),
        "Trainers": _by_skill(trainers(npcs), F.concat(F.lit("- "), F.col("name"), F.lit(" ("), F.col("area"), F.lit(")")), [F.col("key")], None),
        "Synergies": _by_skill(synergies(skills), F.concat(F.lit("- "), F.col("name"), F.lit(": level "), F.array_join(F.transform("levels", lambda x: x.cast("string")), ", ")), [F.lower("name")], None),
    }
    rows = parsed(skills)
    for name, found in parts.items():
        rows = rows.join(found.select(F.col("skill").alias("key"), F.concat_ws("\n", "all").alias(f"_{name}"), F.col("n").alias(f"_n{name}")), "key", "left")
    rows = rows.withColumn("xp_table", text("XpTable")).join(xp_amounts(xptables), "xp_table", "left")
    truly = lambda path: F.coalesce(F.try_variant_get("v", f"$.{path}", "boolean"), F.lit(False))
    kind = F.concat_ws(" | ", F.when(truly("Combat"), "Combat").when(truly("AuxCombat"), "Auxiliary Combat").otherwise("Non-Combat"), F.when(F.size(strings("Parents")) > 0, F.concat(F.lit("Parents: "), F.array_join(strings("Parents"), ", "))), some(text("GuestLevelCap"), "Guest Level Cap: "), some(text("MaxBonusLevels"), "Max Bonus Levels: "))
    numbered = F.array_sort(F.transform(entries("Rewards"), lambda e, i: F.struct(F.coalesce(F.split_part(e["key"], F.lit("_"), F.lit(1)).try_cast("int"), F.lit(0)).alias("n"), i.alias("i"), e.alias("e"))))
    rewards = lines(F.flatten(F.transform(numbered, lambda x: F.transform(F.coalesce(F.map_entries(F.from_json(x["e"]["value"], "map<string,string>")), F.from_json(F.lit("[]"), "array<struct<key:string,value:string>>")), lambda r: F.concat(F.lit("- Level "), x["e"]["key"], F.lit(": "), r["key"], F.lit(" = "), F.coalesce(r["value"], F.lit("")))))))
    curve = lines(F.transform("amounts", lambda x, i: F.concat(F.lit("- Level "), (i + 1).cast("string"), F.lit(": "), x.cast("string"), F.lit(" XP"))))
    section = lambda heading, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(heading), value))
    body = F.concat_ws(
        "\n\n",
        F.concat(F.lit("Skill Profile: "), said("Name", F.col("key"))),
        F.concat(F.lit("Internal Key: "), F.col("key")),
        section("Description:\n", text("Description")),
        F.concat(F.lit("Type: "), kind),
        section("Rewards:\n", rewards),
        F.when(F.col("_nAbilities") > 0, F.concat(F.lit("Abilities ("), F.col("_nAbilities").cast("string"), F.lit("):\n"), F.col("_Abilities"))),
        section("Advancement:\n", F.col("_Advancement")),
        F.when(F.size("amounts") > 0, F.concat(F.lit("XP Table ("), F.col("xp_table"), F.lit("):\n"), curve)),
        section("Recipes:\n", F.col("_Recipes")),
        section("Quests:\n", F.col("_Quests")),
        section("Trainers:\n", F.col("_Trainers")),
        section("Synergy Levels (bonus levels received from other skills):\n", F.col("_Synergies")),
    )
    return document(rows, F.concat(F.lit("skillprofile_"), F.col("key")), "skillprofile", "skills", said("Name", F.col("key")), body)


def leveling_guides(skills: DataFrame, recipes: DataFrame, xptables: DataFrame) -> DataFrame:
    """leveling_<key>: a skill's recipes by level beside the experience that levels take; as many recipes as fit GUIDE characters, LADDER at most."""
    percent = F.col("drop_pct") * 100
    shown = F.when(percent == F.floor(percent), percent.cast("bigint").cast("string")).otherwise(percent.cast("string"))
    gain = F.concat_ws(", ", F.concat(F.lit("+"), F.col("xp"), F.lit(" XP")), F.concat(F.lit("first +"), F.col("first")), F.concat(F.lit("drop after "), F.col("drop_level"), F.coalesce(F.concat(F.lit(" ("), shown, F.lit("%)")), F.lit(""))))
    line = F.concat(F.lit("- "), F.col("name"), F.lit(" [lvl "), F.col("req").cast("string"), F.lit("]"), optional(": ", gain))
    ladder = skill_recipes(recipes).groupBy("skill").agg(F.array_sort(F.collect_list(F.struct("req", "name", line.alias("line")))).alias("all"))
    rows = parsed(skills).join(ladder.withColumnRenamed("skill", "key"), "key").withColumn("xp_table", text("XpTable")).join(xp_amounts(xptables), "xp_table", "left")
    rows = rows.withColumn("amounts", F.coalesce("amounts", F.array().cast("array<bigint>")))
    # one candidate text for each number of recipes; the longest that fits stays
    each = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.least(F.lit(LADDER), F.size("all")))))
    level = F.element_at("all", F.col("k"))["req"]
    upto = F.slice("amounts", 1, F.greatest(level, F.lit(0)))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + x)
    curve = lines(F.transform(upto, lambda x, i: F.concat(F.lit("- Level "), (i + 1).cast("string"), F.lit(": "), x.cast("string"), F.lit(" XP (cumulative "), total(F.slice("amounts", F.lit(1), i + 1)).cast("string"), F.lit(")"))))
    more = F.size("all") - F.col("k")
    rest = F.when(more > 0, F.concat(F.lit("\n- +"), more.cast("string"), F.lit(" more recipes (from level "), F.try_element_at("all", F.col("k") + 1)["req"].cast("string"), F.lit(")"))).otherwise("")
    body = F.concat_ws(
        "\n\n",
        F.concat(F.lit("Skill: "), said("Name", F.col("key"))),
        F.lit("Leveling Guide (computed: recipes joined to the per-level XP curve)\nTo calculate the total XP needed between any two levels (e.g. from Level A to Level B): subtract Level A cumulative XP from Level B cumulative XP (Range XP = Level B cumulative XP - Level A cumulative XP)."),
        F.when(F.size(upto) > 0, F.concat(F.lit("XP table: "), F.col("xp_table"))),
        F.when(F.size(upto) > 0, F.concat(F.lit("Total: "), total(upto).cast("string"), F.lit(" cumulative XP to reach the highest shown level ("), level.cast("string"), F.lit(")."))),
        F.when(F.size(upto) > 0, F.concat(F.lit("XP needed to reach each level (through recipe unlock range):\n"), curve)),
        F.concat(F.lit("Recipes (by unlock level):\n"), lines(F.transform(F.slice("all", F.lit(1), F.col("k")), lambda x: x["line"])), rest),
        F.lit("Leveling strategy:\n- The first craft of each recipe awards its first-time XP instead of the normal per-craft XP.\n- Repeat crafts award the normal per-craft XP, at full value until your skill reaches that recipe's drop-off level.\n- To minimize crafts, craft every unlocked recipe once for its first-time bonus, then repeat the highest-level recipe you can craft."),
    )
    each = each.withColumn("body", body).filter(F.length("body") <= GUIDE)
    kept = each.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("k")))).filter("_r = 1")
    return document(kept, F.concat(F.lit("leveling_"), F.col("key")), "leveling", "skills", said("Name", F.col("key")), F.col("body"), skill=F.col("key"), max_recipe_level=F.element_at("all", -1)["req"], shown_recipe_count=F.col("k"))
