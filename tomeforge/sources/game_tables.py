"""Typed columns of the mapped JSON tables.

Each mapping takes the (key, id, raw) rows of `files.json_table`, parses raw once as VARIANT and selects named paths,
so a further column costs no further scan. Records that are not objects are left out, as nothing can be named in them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeforge.functions.text import without_lint

#: Between the values of a list in one text column.
BETWEEN = " | "


def parsed(rows: DataFrame) -> DataFrame:
    """Adds `v`, the record as VARIANT, and keeps objects only."""
    return rows.withColumn("v", F.try_parse_json("raw")).filter(F.schema_of_variant("v").startswith("OBJECT"))


def text(path: str) -> Column:
    return F.try_variant_get("v", f"$.{path}", "string")


def whole(path: str) -> Column:
    return F.try_variant_get("v", f"$.{path}", "bigint")


def real(path: str) -> Column:
    """A number, or a text that is one; else null."""
    return F.try_variant_get("v", f"$.{path}", "double")


def strings(path: str) -> Column:
    """A list as strings; what is no list is an empty one."""
    return F.coalesce(F.try_variant_get("v", f"$.{path}", "array<string>"), F.array().cast("array<string>"))


def joined(path: str) -> Column:
    return F.array_join(strings(path), BETWEEN)


def keywords() -> Column:
    """Lint marks stay in raw only."""
    return F.array_join(without_lint(strings("Keywords")), BETWEEN)


def json(path: str, otherwise: str = "[]") -> Column:
    return F.coalesce(F.to_json(F.try_variant_get("v", f"$.{path}", "variant")), F.lit(otherwise))


def counted(path: str, name: str) -> Column:
    """A list of objects as "<name>x<StackSize>" each."""
    found = F.try_variant_get("v", f"$.{path}", f"array<struct<{name}:string,StackSize:string>>")
    return F.coalesce(F.array_join(F.transform(found, lambda r: F.concat(F.coalesce(r[name], F.lit("None")), F.lit("x"), F.coalesce(r["StackSize"], F.lit("None")))), BETWEEN), F.lit(""))


def pairs(path: str) -> Column:
    """An object as "Name 5 | Other 7", in the order of the source (which VARIANT doesn't keep)."""
    found = F.from_json(F.get_json_object("raw", f"$.{path}"), "map<string,string>")
    return F.coalesce(F.array_join(F.transform(F.map_entries(found), lambda e: F.concat(e["key"], F.lit(" "), e["value"])), BETWEEN), F.lit(""))


def named(**columns: Column) -> list[Column]:
    return [c.alias(name) for name, c in columns.items()]


def _items() -> list[Column]:
    return named(code=F.col("id"), name=text("Name"), internal_name=text("InternalName"), keywords=keywords(), description=text("Description"), value=real("Value"), stack=whole("MaxStackSize"), equip_slot=text("EquipSlot"), skill_reqs=pairs("SkillReqs"), effect_descs=joined("EffectDescs"), bestow_recipes=joined("BestowRecipes"), raw=F.col("raw"))


def _recipes() -> list[Column]:
    drop = "RewardSkillXpDropOff"
    return named(id=F.col("id"), name=text("Name"), internal_name=text("InternalName"), skill=text("Skill"), skill_level_req=whole("SkillLevelReq"), reward_skill=text("RewardSkill"), reward_xp=whole("RewardSkillXp"), reward_xp_first=whole("RewardSkillXpFirstTime"), drop_off_level=whole(f"{drop}Level"), drop_off_pct=real(f"{drop}Pct"), description=text("Description"), result_items=counted("ResultItems", "ItemCode"), prereq_recipe=text("PrereqRecipe"), keywords=keywords(), raw=F.col("raw"))


def _abilities() -> list[Column]:
    return named(id=F.col("id"), name=text("Name"), internal_name=text("InternalName"), skill=text("Skill"), level=whole("Level"), damage_type=text("DamageType"), description=text("Description"), keywords=keywords(), reset_time=real("ResetTime"), power_cost=real("PvE.PowerCost"), raw=F.col("raw"))


def _quests() -> list[Column]:
    return named(id=F.col("id"), name=text("Name"), internal_name=text("InternalName"), description=text("Description"), keywords=keywords(), objectives=json("Objectives"), rewards=json("Rewards"), reward_items=counted("Rewards_Items", "Item"), favor_npc=text("FavorNpc"), displayed_location=text("DisplayedLocation"), raw=F.col("raw"))


def _npcs() -> list[Column]:
    gifts = F.array_join(F.try_variant_get("v", "$.ItemGifts", "array<string>"), BETWEEN)
    return named(key=F.col("key"), name=text("Name"), area=text("AreaName"), area_friendly=text("AreaFriendlyName"), description=text("Desc"), services=json("Services"), preferences=json("Preferences"), gift_items=gifts, raw=F.col("raw"))


def _effects() -> list[Column]:
    return named(id=F.col("id"), name=text("Name"), desc=text("Desc"), keywords=joined("Keywords"), duration=real("Duration"), raw=F.col("raw"))


def _skills() -> list[Column]:
    filled = lambda path: F.nullif(text(path), F.lit(""))
    combat = F.coalesce(F.try_variant_get("v", "$.Combat", "boolean"), F.lit(False)).cast("int")
    associated = F.array_join(F.concat(strings("AssociatedItemKeywords"), strings("RecipeIngredientKeywords")), BETWEEN)
    return named(id=whole("Id"), name=F.coalesce(filled("Name"), F.col("key")), description=text("Description"), combat=combat, advancement_table=F.coalesce(filled("ActiveAdvancementTable"), text("PassiveAdvancementTable")), associated_keywords=associated, xp_table=text("XpTable"), raw=F.col("raw"))


def _xptables() -> list[Column]:
    return named(id=F.col("key"), internal_name=text("InternalName"), xp_amounts=json("XpAmounts"))


def _advancementtables() -> list[Column]:
    return named(id=F.col("key"), name=joined("Keywords"), raw=F.col("raw"))


def _tsys_powers() -> list[Column]:
    return named(id=F.col("id"), internal_name=text("InternalName"), skill=text("Skill"), slots=joined("Slots"), suffix=text("Suffix"), prefix=text("Prefix"), tiers=json("Tiers", "{}"), raw=F.col("raw"))


def _attributes() -> list[Column]:
    return named(id=F.col("key"), label=text("Label"), default_value=real("DefaultValue"), raw=F.col("raw"))


def _itemuses() -> list[Column]:
    return named(item_key=F.col("key"), recipes_that_use=json("RecipesThatUseItem"), raw=F.col("raw"))


MAPPINGS: dict[str, Callable[[], list[Column]]] = {"items": _items, "recipes": _recipes, "abilities": _abilities, "quests": _quests, "npcs": _npcs, "effects": _effects, "skills": _skills, "xptables": _xptables, "advancementtables": _advancementtables, "tsysclientinfo": _tsys_powers, "attributes": _attributes, "itemuses": _itemuses}


def mapped(name: str, rows: DataFrame) -> DataFrame:
    """The typed columns of a mapped table; any other table as records (id, tbl, raw)."""
    if name not in MAPPINGS:
        return rows.select(F.concat(F.lit(f"{name}:"), F.col("key")).alias("id"), F.lit(name).alias("tbl"), "raw")
    return parsed(rows).select(*MAPPINGS[name]())


def ingredients(recipes: DataFrame) -> DataFrame:
    """One row for each ingredient of a recipe: recipe_id, seq (from 0), item_code (null for keyed ones), item_keys, desc, stack."""
    kind = "array<struct<ItemCode:bigint,ItemKeys:array<string>,Desc:string,StackSize:bigint>>"
    each = parsed(recipes).select(F.col("id").alias("recipe_id"), F.posexplode(F.try_variant_get("v", "$.Ingredients", kind)).alias("seq", "i"))
    return each.select("recipe_id", "seq", F.col("i.ItemCode").alias("item_code"), F.array_join("i.ItemKeys", BETWEEN).alias("item_keys"), F.col("i.Desc").alias("desc"), F.col("i.StackSize").alias("stack"))


def sources(tables: dict[str, DataFrame]) -> DataFrame:
    """The entries of all source tables (by what they are sources of) as one: item_key, seq, entries, source_table."""
    parts = []
    for name, rows in tables.items():
        each = parsed(rows).select("key", F.posexplode(F.try_variant_get("v", "$.entries", "array<variant>")).alias("seq", "e"))
        parts.append(each.select(F.col("key").alias("item_key"), "seq", F.to_json("e").alias("entries"), F.lit(name).alias("source_table")))
    return reduce(DataFrame.unionByName, parts)


def xp_levels(xptables: DataFrame) -> DataFrame:
    """internal_name, level (from 1), xp_needed and the sum of all levels so far."""
    amounts = F.from_json("xp_amounts", "array<bigint>")
    so_far = F.transform(amounts, lambda x, i: F.struct(x.alias("need"), F.aggregate(F.slice(amounts, 1, i + 1), F.lit(0).cast("bigint"), lambda s, y: s + y).alias("sum")))
    each = xptables.select("internal_name", F.posexplode(so_far).alias("level", "x"))
    return each.select("internal_name", (F.col("level") + 1).alias("level"), F.col("x.need").alias("xp_needed"), F.col("x.sum").alias("cumulative_xp"))


def entity_names(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, type, snippet) of all named things in the mapped tables; an item whose internal name differs has a second row."""
    said = lambda *parts: F.substring(F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("None")) for p in parts]), 1, 400)
    c = F.col
    filled = lambda name: F.nullif(c(name), F.lit(""))
    shapes = {
        "items": ("item", F.coalesce(filled("name"), c("internal_name")), said(c("name"), " (", c("code"), ") ", c("keywords"), " ", c("description"))),
        "abilities": ("ability", c("name"), said(c("name"), " (", c("skill"), " ", c("id"), ") ", c("keywords"), " ", c("description"))),
        "recipes": ("recipe", c("name"), said(c("name"), " (", c("skill"), " ", c("skill_level_req"), ") ", c("description"))),
        "quests": ("quest", c("name"), said(c("name"), " (", c("displayed_location"), ") ", c("description"))),
        "npcs": ("npc", F.coalesce(filled("name"), c("key")), said(F.coalesce(filled("name"), c("key")), " (", c("area_friendly"), ") ", c("description"))),
        "effects": ("effect", c("name"), said(c("name"), " ", c("keywords"), " ", c("desc"))),
        "skills": ("skill", c("name"), said(c("name"), " ", c("description"))),
    }
    parts = [tables[t].select(name.alias("name"), F.lit(kind).alias("type"), snippet.alias("snippet")) for t, (kind, name, snippet) in shapes.items() if t in tables]
    if "items" in tables:
        second = tables["items"].filter((c("internal_name") != c("name")) & (c("name") != "") & (c("internal_name") != ""))
        parts.append(second.select(c("internal_name").alias("name"), F.lit("item").alias("type"), said(c("internal_name"), " (", c("code"), ")").alias("snippet")))
    return reduce(DataFrame.unionByName, parts).filter(F.coalesce(c("name"), F.lit("")) != "")
