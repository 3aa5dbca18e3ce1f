"""Records of the JSON tables as text documents.

Every builder takes (key, id, raw) rows of `files.json_table` and gives (id, type, tbl, name, text, facts); facts is a map of
searchable values. Texts are put together by column expressions; lists that name other records are exploded, joined to
their names and gathered again in their order. A value that is missing or null is an empty text. Headings and wordings are fixed values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeforge.functions.text import short_sha256
from tomeforge.sources.game_tables import BETWEEN, parsed, strings, text

#: Persons that sources name but the table of persons lacks.
PERSONS = {"NPC_VendorFox": "Vendor Fox", "NPC_Pennoc": "Pennoc", "NPC_Khyrulek": "Khyrulek", "NPC_Raim": "Raim", "NPC_Moxie": "Moxie", "NPC_Grasuul": "Grasuul", "NPC_Riger": "Riger", "NPC_Velkort_Halloween": "Velkort"}
#: How a document's first line may begin.
HEADINGS = ("Item", "Recipe", "Skill", "Quest", "Ability", "NPC", "Effect", "Lore Book", "Directed Goal", "Area", "Landmark", "Player Title", "Storage Vault")


def said(path: str, otherwise: str | Column = "") -> Column:
    return F.coalesce(text(path), F.lit(otherwise) if isinstance(otherwise, str) else otherwise)


def stripped(x: Column) -> Column:
    return F.trim(x, F.lit(" \n\t\r"))


def lines(items: Column) -> Column:
    return F.array_join(items, "\n")


def optional(heading: str, value: Column) -> Column:
    """A heading and the value after it, if there is any."""
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(heading), value)).otherwise("")


def objects(path: str, *fields: str) -> Column:
    """A list of objects with these fields as texts; what is no list is empty."""
    shape = "array<struct<" + ",".join(f"{f}:string" for f in fields) + ">>"
    return F.coalesce(F.try_variant_get("v", f"$.{path}", shape), F.from_json(F.lit("[]"), shape))


def entries(path: str) -> Column:
    """An object's (key, value) pairs, values as JSON texts, in the order of the source."""
    return F.coalesce(F.map_entries(F.from_json(F.get_json_object("raw", f"$.{path}"), "map<string,string>")), F.from_json(F.lit("[]"), "array<struct<key:string,value:string>>"))


def field(x: Column, name: str, otherwise: str = "") -> Column:
    return F.coalesce(x[name], F.lit(otherwise))


def facts(**values: Column) -> Column:
    return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.coalesce(v.cast("string"), F.lit("")))))


def document(rows: DataFrame, ident: Column, kind: str, tbl: str, name: Column, body: Column, **more: Column) -> DataFrame:
    return rows.select(ident.alias("id"), F.lit(kind).alias("type"), F.lit(tbl).alias("tbl"), name.alias("name"), stripped(body).alias("text"), (facts(**more) if more else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("facts"))


def gathered(rows: DataFrame, listed: DataFrame, out: str) -> DataFrame:
    """rows with the column out: the values of listed (key, pos, value) in order."""
    own = listed.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias(out))
    return rows.join(own, "key", "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


def called(listed: DataFrame, names: DataFrame, kind: str) -> DataFrame:
    """listed (key, pos, code, ...) with the column name: of the record "<kind>_<code>", or else Unknown."""
    own = parsed(names).select(F.regexp_extract("key", "^[^_]*_(.*)$", 1).alias("code"), F.coalesce(text("Name"), F.concat(F.lit(f"{kind} "), F.regexp_extract("key", "^[^_]*_(.*)$", 1))).alias("name"))
    return listed.join(own, "code", "left").withColumn("name", F.coalesce("name", F.concat(F.lit(f"Unknown {kind} ("), F.col("code"), F.lit(")"))))


def items(rows: DataFrame, attributes: DataFrame | None = None, recipes: DataFrame | None = None, harvest: DataFrame | None = None) -> DataFrame:
    """item_<n>. harvest: key (lower-case name), skill, level."""
    rows = parsed(rows)
    effects = rows.select("key", F.posexplode(strings("EffectDescs")).alias("pos", "said"))
    token, value = F.regexp_extract("said", r"^\{([^}]+)\}\{([^}]+)\}$", 1), F.regexp_extract("said", r"^\{([^}]+)\}\{([^}]+)\}$", 2)
    effects = effects.withColumn("token", token).withColumn("amount", value)
    if attributes is not None:
        effects = effects.join(parsed(attributes).select(F.col("key").alias("token"), F.nullif(text("Label"), F.lit("")).alias("label")), "token", "left")
    else:
        effects = effects.withColumn("label", F.lit(None).cast("string"))
    sign = F.when(F.col("amount").try_cast("double") >= 0, "+").otherwise("")
    shown = F.when(F.col("token") != "", F.concat(F.lit("Stat: "), F.coalesce("label", "token"), F.lit(" "), sign, F.col("amount"))).otherwise(F.col("said"))
    rows = gathered(rows, effects.select("key", "pos", shown.alias("value")), "effects")
    if recipes is not None:
        taught = called(rows.select("key", F.posexplode(strings("BestowRecipes")).alias("pos", "code")), recipes, "Recipe")
        rows = gathered(rows, taught.select("key", "pos", F.concat(F.lit("Bestows Recipe: "), F.col("name")).alias("value")), "bestows")
    else:
        rows = rows.withColumn("bestows", F.array().cast("array<string>"))
    needs = F.array_sort(entries("SkillReqs"))
    one = lambda heading, path: F.when(F.coalesce(text(path), F.lit("")) != "", F.array(F.concat(F.lit(heading), text(path)))).otherwise(F.array().cast("array<string>"))
    section = F.concat(one("Slot: ", "EquipSlot"), F.transform(needs, lambda e: F.concat(F.lit("Requires "), e["key"], F.lit(" skill level "), e["value"])), one("TSys Profile: ", "TSysProfile"), one("Crafting Target Level: ", "CraftingTargetLevel"), one("Food: ", "FoodDesc"), F.col("effects"), F.col("bestows"))
    body = F.concat(F.lit("Item: "), said("Name", F.col("key")), F.lit("\n\nInternal Name:\n"), said("InternalName"), F.lit("\n\nKeywords:\n"), F.array_join(strings("Keywords"), ", "), F.lit("\n\nUsage:\n"), said("Description"), F.lit("\n\nDescription:\n"), said("Description"), F.lit("\n\nStack Size:\n"), said("MaxStackSize"), F.lit("\n\nValue:\n"), said("Value"), F.lit("\n"), optional("\n\n", lines(section)))
    if harvest is not None:
        own = harvest.select(F.col("key").alias("_name"), F.concat(F.lit("\n\nGather Requirement:\nRequires "), F.col("skill"), F.lit(" skill level "), F.col("level").cast("string"), F.lit(" to gather")).alias("gather"))
        rows = rows.withColumn("_name", F.lower(F.trim(said("Name")))).join(own, "_name", "left")
        body = F.concat(body, F.coalesce("gather", F.lit("")))
    skills = F.array_join(F.transform(needs, lambda e: F.concat(e["key"], F.lit(" "), e["value"])), BETWEEN)
    whole = lambda path: F.coalesce(F.try_variant_get("v", f"$.{path}", "double").cast("bigint"), F.lit(0))
    return document(rows, F.col("key"), "item", "items", said("Name", F.col("key")), body, keywords=F.array_join(strings("Keywords"), BETWEEN), equip_slot=said("EquipSlot"), skill_reqs=skills, value=whole("Value"), stack_size=whole("MaxStackSize"))


def recipes(rows: DataFrame, item_rows: DataFrame) -> DataFrame:
    """recipe_<n>."""
    rows = parsed(rows)
    parts = rows.select("key", F.posexplode(F.coalesce(F.try_variant_get("v", "$.Ingredients", "array<struct<ItemCode:string,StackSize:string,Desc:string,ItemKeys:array<string>>>"), F.from_json(F.lit("[]"), "array<struct<ItemCode:string,StackSize:string,Desc:string,ItemKeys:array<string>>>"))).alias("pos", "p")).withColumn("code", F.col("p.ItemCode"))
    parts = called(parts, item_rows, "Item")
    keys, times = F.array_join("p.ItemKeys", ", "), F.concat(F.lit(" x"), F.coalesce("p.StackSize", F.lit("1")))
    shown = (
        F.when(F.col("code").isNotNull(), F.concat(F.lit("- "), F.col("name"), times))
        .when(F.col("p.ItemKeys").isNotNull() & (F.coalesce("p.Desc", F.lit("")) != ""), F.concat(F.lit("- "), F.col("p.Desc"), F.lit(" (category: "), keys, F.lit(")"), times))
        .when(F.col("p.ItemKeys").isNotNull(), F.concat(F.lit("- Any item matching: "), keys, times))
        .otherwise(F.concat(F.lit("- "), F.coalesce("p.Desc", F.lit("Unknown ingredient"))))
    )
    short = F.when(F.col("code").isNotNull(), F.col("name")).when(F.col("p.ItemKeys").isNotNull(), F.coalesce(F.nullif(F.col("p.Desc"), F.lit("")), keys)).otherwise(F.coalesce("p.Desc", F.lit("Unknown ingredient")))
    made = rows.select("key", F.posexplode(objects("ResultItems", "ItemCode", "StackSize")).alias("pos", "p")).withColumn("code", F.col("p.ItemCode"))
    made = called(made, item_rows, "Item")
    for listed, value, out in ((parts, shown, "ingredients"), (parts, short, "ingredient_names"), (parts.filter("code is not null"), F.col("code"), "ingredient_codes"), (made, F.concat(F.lit("- "), F.col("name"), F.lit(" x"), F.coalesce("p.StackSize", F.lit("1"))), "results"), (made, F.col("name"), "result_names"), (made, F.col("code"), "result_codes")):
        rows = gathered(rows, listed.select("key", "pos", value.alias("value")), out)
    codes = F.concat_ws("; ", F.when(F.size("ingredient_codes") > 0, F.concat(F.lit("ingredients: "), F.array_join("ingredient_codes", ", "))), F.when(F.size("result_codes") > 0, F.concat(F.lit("results: "), F.array_join("result_codes", ", "))))
    gains = F.coalesce(F.nullif(text("RewardSkill"), F.lit("")), said("Skill"))
    percent = F.try_variant_get("v", "$.RewardSkillXpDropOffPct", "double") * 100
    drop = F.concat_ws(", ", F.concat(F.lit("-"), F.when(percent == F.floor(percent), percent.cast("bigint").cast("string")).otherwise(percent.cast("string")), F.lit("%")), F.concat(F.lit("after level "), text("RewardSkillXpDropOffLevel")), F.concat(F.lit("rate "), text("RewardSkillXpDropOffRate")))
    xp = F.concat_ws(", ", F.concat(F.lit("+"), text("RewardSkillXp")), F.concat(F.lit("first-time +"), text("RewardSkillXpFirstTime")))
    rewards = F.concat_ws("\n", F.when(xp != "", F.concat(F.lit("Awards "), gains, F.lit(" XP: "), xp)), F.when((said("RewardSkill") != "") & (said("RewardSkill") != said("Skill")), F.concat(F.lit("Reward Skill: "), text("RewardSkill"))), F.when(drop != "", F.concat(F.lit("XP Drop-off: "), drop)), F.concat(F.lit("Reset Time: "), text("ResetTimeInSeconds"), F.lit("s")), F.concat(F.lit("Max Uses: "), text("MaxUses")))
    body = F.concat(F.lit("Recipe: "), said("Name", F.col("key")), F.lit("\n\nSkill:\n"), said("Skill"), F.lit("\n\nRequired Skill Level:\n"), said("SkillLevelReq", "0"), F.lit("\n\nDescription:\n"), said("Description"), F.lit("\n\nIngredients:\n"), lines(F.col("ingredients")), F.lit("\n\nProduces:\n"), lines(F.col("results")), F.when(codes != "", F.concat(F.lit("\nItem codes ("), codes, F.lit(")."))).otherwise(""), F.lit("\n"), optional("\n\nRewards:\n", rewards))
    return document(rows, F.col("key"), "recipe", "recipes", said("Name", F.col("key")), body, skill=said("Skill"), skill_level_req=F.coalesce(F.try_variant_get("v", "$.SkillLevelReq", "bigint"), F.lit(0)), reward_skill=gains, ingredients=F.array_join(F.array_distinct("ingredient_names"), BETWEEN), result_items=F.array_join(F.array_distinct("result_names"), BETWEEN))


def _by_number(pairs: Column) -> Column:
    """Pairs sorted by the number that their key begins with (0 without one), else in their order."""
    numbered = F.transform(pairs, lambda e, i: F.struct(F.coalesce(F.split_part(e["key"], F.lit("_"), F.lit(1)).try_cast("int"), F.lit(0)).alias("n"), i.alias("i"), e.alias("e")))
    return F.transform(F.array_sort(numbered), lambda x: x["e"])


def skills(rows: DataFrame) -> DataFrame:
    """skill_<key>."""
    rows = parsed(rows)

    def level_lines(e: Column) -> Column:
        head, rest = F.split_part(e["key"], F.lit("_"), F.lit(1)), F.substring_index(e["key"], "_", 1)
        after = e["key"].substr(F.length(rest) + 2, F.length(e["key"]))
        shown = F.when(F.contains(e["key"], F.lit("_")) & head.rlike("^[0-9]+$") & (after != ""), F.concat(head, F.lit(" ("), after, F.lit(")"))).otherwise(e["key"])
        inner = F.coalesce(F.map_entries(F.from_json(e["value"], "map<string,string>")), F.from_json(F.lit("[]"), "array<struct<key:string,value:string>>"))
        return F.transform(F.filter(inner, lambda x: x["value"].isNotNull()), lambda x: F.concat(F.lit("- Level "), shown, F.lit(": "), x["key"], F.lit(" = "), x["value"]))

    rewards = lines(F.flatten(F.transform(_by_number(entries("Rewards")), level_lines)))
    hints = lines(F.transform(F.filter(_by_number(entries("AdvancementHints")), lambda e: e["value"].isNotNull()), lambda e: F.concat(F.lit("- Level "), e["key"], F.lit(": "), e["value"])))
    truly = lambda path: F.coalesce(F.try_variant_get("v", f"$.{path}", "boolean"), F.lit(False))
    kind = F.when(truly("Combat"), "Combat").when(truly("AuxCombat"), "Auxiliary Combat").otherwise("Non-Combat")
    body = F.concat(F.lit("Skill: "), said("Name", F.col("key")), F.lit("\n\nDescription:\n"), said("Description"), F.lit("\n\nRewards:\n"), F.when(rewards == "", "No rewards listed").otherwise(rewards), F.lit("\n\nAdvancement Hints:\n"), F.when(hints == "", "No advancement hints listed").otherwise(hints), optional("\n\nParents:\n", F.array_join(strings("Parents"), ", ")), F.lit("\n\nType: "), kind, optional("\nMax Bonus Levels: ", text("MaxBonusLevels")))
    return document(rows, F.concat(F.lit("skill_"), F.col("key")), "skill", "skills", said("Name", F.col("key")), body)


def quests(rows: DataFrame) -> DataFrame:
    """quest_<key>, without those that can't be had."""
    rows = parsed(rows).filter(~F.array_contains(strings("Keywords"), "Lint_NotObtainable"))
    goals = F.transform(objects("Objectives", "Type", "Description", "Number", "Target"), lambda o: F.concat(F.lit("- "), field(o, "Type"), F.lit(": "), field(o, "Description"), F.lit(" (x"), field(o, "Number", "1"), F.lit(", target: "), field(o, "Target"), F.lit(")")))
    # a requirement is a text, an object, or a list of objects
    raw = F.coalesce(F.try_variant_get("v", "$.Requirements", "array<variant>"), F.array().cast("array<variant>"))
    shape = "struct<T:string,Skill:string,Level:string,Npc:string,Quest:string>"

    def need(o: Column) -> Column:
        return F.when(o["T"] == "MinSkillLevel", F.concat(F.lit("Skill "), field(o, "Skill"), F.lit(" >= "), field(o, "Level", "0"))).when(o["T"] == "MinFavorLevel", F.concat(F.lit("Favor with "), field(o, "Npc"), F.lit(" >= "), field(o, "Level"))).when(o["T"] == "QuestCompleted", F.concat(F.lit("Completed quest: "), field(o, "Quest")))

    def needs(x: Column) -> Column:
        kind = F.schema_of_variant(x)
        many = F.coalesce(F.try_variant_get(x, "$", f"array<{shape}>"), F.array(F.try_variant_get(x, "$", shape)))
        return F.when(kind == "STRING", F.array(F.try_variant_get(x, "$", "string"))).otherwise(F.filter(F.transform(many, need), lambda y: y.isNotNull()))

    required = F.flatten(F.transform(raw, needs))
    spaced = lambda x: F.regexp_replace(x, "([a-z])([A-Z])", "$1 $2")
    won = objects("Rewards", "T", "Xp", "Skill", "Recipe", "Currency", "Amount")
    gains = F.filter(F.transform(won, lambda r: F.when(r["T"] == "SkillXp", F.concat(F.lit("+"), field(r, "Xp", "0"), F.lit(" "), field(r, "Skill"), F.lit(" XP"))).when(r["T"] == "Recipe", F.concat(F.lit("Recipe: "), field(r, "Recipe"))).when(r["T"] == "Currency", F.concat(F.lit("+"), field(r, "Amount", "0"), F.lit(" "), spaced(field(r, "Currency"))))), lambda x: x.isNotNull())
    things = F.transform(objects("Rewards_Items", "Item", "StackSize"), lambda r: F.concat(F.lit("Item: "), field(r, "Item"), F.lit(" x"), field(r, "StackSize", "1")))
    dashed = lambda xs: lines(F.transform(xs, lambda x: F.concat(F.lit("- "), x)))
    body = F.concat(F.lit("Quest: "), said("Name", F.col("key")), F.lit("\n\nDescription:\n"), said("Description"), optional("\n\nPreface:\n", text("PrefaceText")), optional("\n\nCompletion:\n", text("SuccessText")), optional("\n\nLocation: ", text("DisplayedLocation")), optional("\n\nObjectives:\n", lines(goals)), optional("\n\nRequirements:\n", dashed(required)), optional("\n\nRewards:\n", dashed(F.concat(gains, things))))
    trained = F.transform(F.filter(won, lambda r: (r["T"] == "SkillXp") & (F.coalesce(r["Skill"], F.lit("")) != "")), lambda r: r["Skill"])
    return document(rows, F.concat(F.lit("quest_"), F.col("key")), "quest", "quests", said("Name", F.col("key")), body, reward_skills=F.array_join(F.array_distinct(trained), BETWEEN), location=said("DisplayedLocation"))


def abilities(rows: DataFrame) -> DataFrame:
    """ability_<key>, without those of monsters."""
    rows = parsed(rows).filter(~F.array_contains(strings("Keywords"), "Lint_MonsterAbility"))
    has = F.coalesce(F.size(entries("PvE")) > 0, F.lit(False))
    pve = F.concat(F.lit("\n\nPvE: Damage="), said("PvE.Damage", "0"), F.lit(", PowerCost="), said("PvE.PowerCost", "0"), F.lit(", RageCost="), said("PvE.RageCost", "0"), F.lit(", Range="), said("PvE.Range", "0"))
    body = F.concat(F.lit("Ability: "), said("Name", F.col("key")), F.lit("\n\nDescription:\n"), said("Description"), F.lit("\n\nSkill: "), said("Skill"), F.lit("\nDamage Type: "), said("DamageType"), F.lit("\nTarget: "), said("Target"), F.lit("\nLevel: "), said("Level", "0"), F.lit("\nReset Time: "), said("ResetTime", "0"), F.lit("s"), F.when(has, pve).otherwise(""), optional("\n\nKeywords: ", F.array_join(strings("Keywords"), ", ")))
    return document(rows, F.concat(F.lit("ability_"), F.col("key")), "ability", "abilities", said("Name", F.col("key")), body, skill=said("Skill"), keywords=F.array_join(strings("Keywords"), BETWEEN), level=F.coalesce(F.try_variant_get("v", "$.Level", "bigint"), F.lit(0)), damage_type=said("DamageType"))


def npcs(rows: DataFrame) -> DataFrame:
    """npc_<key>."""
    rows = parsed(rows)
    shape = "array<struct<Type:string,Favor:string,Skills:array<string>>>"
    offered = F.transform(F.coalesce(F.try_variant_get("v", "$.Services", shape), F.from_json(F.lit("[]"), shape)), lambda s: F.concat(F.lit("- "), field(s, "Type"), F.when(field(s, "Favor") != "", F.concat(F.lit(" (Favor: "), s["Favor"], F.lit(")"))).otherwise(""), optional(" - Skills: ", F.array_join(s["Skills"], ", "))))
    liked = F.transform(F.filter(objects("Preferences", "Desire", "Name"), lambda p: field(p, "Name") != ""), lambda p: F.trim(F.concat(F.lit("- "), field(p, "Desire"), F.lit(": "), p["Name"]), F.lit(": ")))
    body = F.concat(F.lit("NPC: "), said("Name", F.col("key")), F.lit("\n\nDescription:\n"), said("Desc"), F.lit("\n\nLocation: "), said("AreaFriendlyName"), optional("\n\nServices:\n", lines(offered)), optional("\n\nGift preferences:\n", lines(liked)))
    return document(rows, F.concat(F.lit("npc_"), F.col("key")), "npc", "npcs", said("Name", F.col("key")), body)


def effects(rows: DataFrame) -> DataFrame:
    """effect_<key> of those with a description."""
    rows = parsed(rows).filter(said("Desc") != "")
    body = F.concat(F.lit("Effect: "), said("Name", F.col("key")), F.lit("\n\nDescription:\n"), said("Desc"), optional("\n\nKeywords: ", F.array_join(strings("Keywords"), ", ")))
    return document(rows, F.concat(F.lit("effect_"), F.col("key")), "effect", "effects", said("Name", F.col("key")), body)


def lorebooks(rows: DataFrame, clean=lambda x: stripped(F.regexp_replace(F.regexp_replace(x, r"<[^>\n]+>", ""), r"'{2,5}", ""))) -> DataFrame:
    """lorebook_<key> of those with a text; clean takes the markup out of it."""
    rows = parsed(rows).filter(said("Text") != "")
    title = F.coalesce(text("Title"), text("Name"), F.col("key"))
    body = F.concat(F.lit("Lore Book: "), title, F.lit("\n\nCategory: "), said("Category"), F.lit("\nLocation: "), said("LocationHint"), F.lit("\n\nContent:\n"), clean(said("Text")), optional("\n\nKeywords: ", F.array_join(strings("Keywords"), ", ")))
    return document(rows, F.concat(F.lit("lorebook_"), F.col("key")), "lorebook", "lorebooks", title, body)


def goals(rows: DataFrame) -> DataFrame:
    """goal_<Id> of those with a hint."""
    rows = parsed(rows).filter((said("LargeHint") != "") | (said("SmallHint") != ""))
    body = F.concat(F.lit("Directed Goal: "), said("Label"), F.lit("\n\nZone: "), said("Zone"), optional("\n\nHint: ", text("LargeHint")), optional("\n\nSmall Hint: ", text("SmallHint")))
    return document(rows, F.concat(F.lit("goal_"), said("Id", said("Label"))), "directedgoal", "directedgoals", said("Label"), body)


def areas(rows: DataFrame) -> DataFrame:
    rows, name = parsed(rows), said("FriendlyName", F.col("key"))
    return document(rows, F.concat(F.lit("area_"), F.col("key")), "area", "areas", name, F.concat(F.lit("Area: "), name, F.lit("\n\nShort Name: "), said("ShortFriendlyName"), F.lit("\nInternal ID: "), F.col("key")))


def item_uses(rows: DataFrame, item_rows: DataFrame) -> DataFrame:
    """itemuse_<key> of items that some recipe uses."""
    rows = parsed(rows).withColumn("used", strings("RecipesThatUseItem")).filter(F.size("used") > 0)
    rows = called(rows.withColumn("code", F.regexp_replace("key", "^item_", "")), item_rows, "Item")
    body = F.concat(F.lit("Item Usage: "), F.col("name"), F.lit("\n\nUsed in "), F.size("used").cast("string"), F.lit(" recipes:\nRecipe IDs: "), F.array_join("used", ", "))
    return document(rows, F.concat(F.lit("itemuse_"), F.col("key")), "itemuse", "itemuses", F.col("name"), body)


def landmarks(rows: DataFrame) -> DataFrame:
    """landmark_<area>_<name>_<i>; raw is a list of landmarks of the area `key`."""
    each = rows.select("key", F.posexplode(F.from_json("raw", "array<string>")).alias("i", "raw"))
    each = parsed(each)
    body = F.concat(F.lit("Landmark: "), said("Name"), F.lit("\n\nType: "), said("Type"), F.lit("\nArea: "), F.col("key"), F.lit("\nLocation: "), said("Loc"), F.lit("\n\nDescription:\n"), said("Desc"))
    return document(each, F.concat_ws("_", F.lit("landmark"), "key", said("Name"), F.col("i").cast("string")), "landmark", "landmarks", said("Name"), body)


def titles(rows: DataFrame) -> DataFrame:
    rows = parsed(rows)
    return document(rows, F.concat(F.lit("title_"), F.col("key")), "title", "playertitles", said("Title"), F.concat(F.lit("Player Title: "), said("Title")))


def vaults(rows: DataFrame) -> DataFrame:
    rows = parsed(rows)
    name = said("NpcFriendlyName", F.concat(F.lit("Vault "), F.col("key")))
    body = F.concat(F.lit("Storage Vault: "), name, F.lit("\n\nArea: "), said("Area"), F.lit("\nSlots: "), said("NumSlots", "0"), F.lit("\nHas Associated NPC: "), F.initcap(said("HasAssociatedNpc", "false")))
    return document(rows, F.concat(F.lit("vault_"), F.col("key")), "vault", "storagevaults", name, body)


def advancement(rows: DataFrame) -> DataFrame:
    """advtable_<key>: every entry on a line, those of nested ones below it."""
    rows = parsed(rows)
    shown = lambda e: F.when(e["value"].startswith("{"), F.concat(F.lit("- "), e["key"], F.lit(":"), F.array_join(F.transform(F.map_entries(F.from_json(e["value"], "map<string,string>")), lambda x: F.concat(F.lit("\n  "), x["key"], F.lit(": "), x["value"])), ""))).otherwise(F.concat(F.lit("- "), e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(""))))
    every = F.map_entries(F.from_json("raw", "map<string,string>"))
    name = said("InternalName", F.col("key"))
    body = F.concat(F.lit("Advancement Table: "), name, F.lit("\n\n"), lines(F.transform(F.filter(every, lambda e: e["key"] != "InternalName"), shown)))
    return document(rows, F.concat(F.lit("advtable_"), F.col("key")), "advancementtable", "advancementtables", name, body)


def behaviours(rows: DataFrame) -> DataFrame:
    """ai_<key>."""
    rows = parsed(rows)
    known = F.filter(entries("Abilities"), lambda e: e["value"].startswith("{"))
    listed = lines(F.transform(known, lambda e: F.concat(F.lit("- "), e["key"], F.lit(" (levels "), F.coalesce(F.get_json_object(e["value"], "$.minLevel"), F.lit("1")), F.lit("-"), F.coalesce(F.get_json_object(e["value"], "$.maxLevel"), F.lit("max")), F.lit(")"))))
    body = F.concat(F.lit("AI Behavior: "), F.col("key"), F.lit("\n\nComment: "), said("Comment"), F.lit("\nMobility: "), said("MobilityType"), F.lit("\nUncontrolled Pet: "), F.initcap(said("UncontrolledPet", "false")), F.lit("\n\nAbilities:\n"), F.when(listed == "", "No abilities listed").otherwise(listed))
    return document(rows, F.concat(F.lit("ai_"), F.col("key")), "ai", "ai", F.col("key"), body)


def attributes(rows: DataFrame) -> DataFrame:
    rows, label = parsed(rows), said("Label", F.col("key"))
    body = F.concat(F.lit("Attribute: "), label, F.lit("\n\nInternal Name: "), F.col("key"), F.lit("\nDefault Value: "), said("DefaultValue", "0"), F.lit("\nDisplay Rule: "), said("DisplayRule"), F.lit("\nDisplay Type: "), said("DisplayType"))
    return document(rows, F.concat(F.lit("attr_"), F.col("key")), "attribute", "attributes", label, body)


def source_entries(rows: DataFrame, of: str, names: DataFrame, persons: DataFrame) -> DataFrame:
    """source_<of>_<key>: where an item, ability or recipe comes from. of: items, abilities or recipes; names: that table's rows."""
    kind = {"items": "Item", "abilities": "Ability", "recipes": "Recipe"}[of]
    rows = parsed(rows)
    both = "array<struct<Npc:string,npc:string,Skill:string,skill:string,Type:string,type:string>>".replace("npc:string,", "").replace(",skill:string", "").replace(",type:string", "")
    upper = F.coalesce(F.try_variant_get("v", "$.entries", both), F.from_json(F.lit("[]"), both))
    lower = F.coalesce(F.try_variant_get("v", "$.entries", "array<struct<npc:string,skill:string,type:string>>"), F.from_json(F.lit("[]"), "array<struct<npc:string,skill:string,type:string>>"))
    each = rows.select("key", F.posexplode(F.arrays_zip(upper.alias("u"), lower.alias("l"))).alias("pos", "e"))
    each = each.select("key", "pos", F.coalesce("e.u.Npc", "e.l.npc").alias("npc"), F.coalesce("e.u.Skill", "e.l.skill", F.lit("")).alias("skill"), F.coalesce("e.u.Type", "e.l.type", F.lit("")).alias("kind"))
    alias = F.create_map(*(F.lit(x) for pair in PERSONS.items() for x in pair))
    each = each.join(parsed(persons).select(F.col("key").alias("npc"), F.nullif(text("Name"), F.lit("")).alias("person")), "npc", "left")
    person = F.coalesce("person", F.try_element_at(alias, F.col("npc")), F.concat(F.lit("Unknown NPC ("), F.col("npc"), F.lit(")")))
    has = F.coalesce("npc", F.lit("")) != ""
    line = F.when((F.col("kind") == "NpcGift") & has, F.concat(F.lit("- Gifted to "), person)).otherwise(F.concat(F.lit("- "), F.col("kind"), F.when(has & (F.col("kind") != "NpcGift"), F.concat(F.lit(" from "), person)).otherwise("")))
    line = F.concat(line, F.when(F.col("skill") != "", F.concat(F.lit(" ("), F.col("skill"), F.lit(" skill)"))).otherwise(""))
    rows = gathered(rows, each.select("key", "pos", line.alias("value")), "listed").filter(F.size("listed") > 0)
    rows = called(rows.withColumn("code", F.regexp_replace("key", f"^{kind.lower()}_", "")), names, kind)
    tbl = f"sources_{of}"
    body = F.concat(F.lit("Source: "), F.col("name"), F.lit(f"\n\nFound in {tbl}:\n"), lines(F.col("listed")))
    return document(rows, F.concat(F.lit(f"source_{of}_"), F.col("key")), "source", tbl, F.concat(F.col("name"), F.lit(" Sources")), body)


def treasures(rows: DataFrame) -> DataFrame:
    """tsys_<key>."""
    rows, name = parsed(rows), said("InternalName", F.col("key"))
    at = lambda e, path, otherwise: F.coalesce(F.get_json_object(e["value"], path), F.lit(otherwise))
    tier = lambda e: F.concat(F.lit("- "), e["key"], F.lit(": Level "), at(e, "$.MinLevel", "?"), F.lit("-"), at(e, "$.MaxLevel", "?"), F.lit(", "), at(e, "$.MinRarity", ""), F.lit(": "), F.coalesce(F.array_join(F.from_json(F.get_json_object(e["value"], "$.EffectDescs"), "array<string>"), ", "), F.lit("")))
    tiers = lines(F.transform(F.filter(entries("Tiers"), lambda e: e["value"].startswith("{")), tier))
    slots = F.array_join(F.filter(strings("Slots"), lambda s: (s != "") & (s != "None")), ", ")
    body = F.concat(F.lit("Treasure Item: "), name, F.lit("\n\nSkill: "), said("Skill"), F.lit("\nSuffix: "), said("Suffix"), F.lit("\nSlots: "), F.when(F.size(strings("Slots")) > 0, slots).otherwise("Any"), F.lit("\n\nTiers:\n"), F.when(tiers == "", "No tiers listed").otherwise(tiers))
    return document(rows, F.concat(F.lit("tsys_"), F.col("key")), "tsys", "tsysclientinfo", name, body)


def xp_tables(rows: DataFrame) -> DataFrame:
    """xptable_<key> of those with amounts."""
    rows = parsed(rows).filter(F.size(strings("XpAmounts")) > 0)
    name = F.when(said("InternalName").isin("", "None"), F.col("key")).otherwise(text("InternalName"))
    body = F.concat(F.lit("XP Table: "), name, F.lit("\n\nXP required per level:\n"), lines(F.transform(strings("XpAmounts"), lambda x, i: F.concat(F.lit("Level "), (i + 1).cast("string"), F.lit(": "), x, F.lit(" XP")))))
    return document(rows, F.concat(F.lit("xptable_"), F.col("key")), "xptable", "xptables", name, body)


def ability_keywords(rows: DataFrame) -> DataFrame:
    """abkeyword_<hash of the sorted keywords>; key: the place in the list, which numbers equal ones _2, _3."""
    from tomeforge.operators.sync import collision_suffix

    rows = parsed(rows)
    combo = F.array_join(F.array_sort(strings("MustHaveAbilityKeywords")), ",")
    body = F.concat(F.lit("Ability Keyword Combo: "), F.when(combo == "", "Unknown combo").otherwise(combo), *(optional(f"\n{h}: ", F.array_join(strings(p), ", ")) for h, p in (("Required Keywords", "MustHaveAbilityKeywords"), ("Crit Chance Attrs", "AttributesThatDeltaCritChance"), ("Crit Damage Attrs", "AttributesThatModCritDamage"))))
    rows = collision_suffix(rows.withColumn("doc", F.concat(F.lit("abkeyword_"), short_sha256(combo))), "doc", ["key"])
    return document(rows, F.col("doc"), "abilitykeyword", "abilitykeywords", F.concat(F.lit("Keyword Combo: "), combo), body)


def inferred_name(body: Column) -> Column:
    """What follows the first of the HEADINGS that begins a line."""
    return F.nullif(F.regexp_extract(body, "(?m)^(?:" + "|".join(HEADINGS) + "): (.*)$", 1), F.lit(""))


def assembled(parts: list[DataFrame]) -> DataFrame:
    """All documents; one without a name takes that of its heading."""
    every = reduce(lambda a, b: a.unionByName(b), parts)
    return every.withColumn("name", F.coalesce("name", inferred_name(F.col("text"))))
