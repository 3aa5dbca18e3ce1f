"""What is known of one player: the newest report's parts, things, the stall's history. Each function gives a DataFrame; `engine` shows them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeforge.functions.text import has_price, name_like, spaced_words
from tomeforge.operators.lookup import exact_else_like, first_of_kinds, prefix_family, same_name, shortest_match

#: Channels in which other players quote prices.
SOCIAL = ("Trade", "Global", "Nearby", "Help", "Tell", "Guild", "Party")


#: Events of a stall that are shown; recipes of a family; what the names of recipes begin with.
NEWEST, MOST_RECIPES = 120, 40
RECIPE_PREFIXES = (
    "Tailoring:", "Cooking:", "Blacksmithing:", "Carpentry:", "Alchemy:", "Brewing:", "Cheesemaking:", "Fletching:", "Jewelry Crafting:", "Leatherworking:", "Masonry:", "Shoe Making:",
    "Sigil Scripting:", "Textile Creation:", "Toolcrafting:", "Weaponsmithing:",
)


class Ask(ValueError):
    """A question that can't be answered as it was put; the text says why."""


def character(reports: DataFrame, wanted: str | None = None, stall: DataFrame | None = None) -> str:
    """The only character, the one asked for or, for stall questions, the only owner of a stall if that is one of the characters."""
    names = [r[0] for r in reports.select("character").distinct().orderBy("character").limit(101).collect()]
    if not names:
        raise Ask("There are no reports of any character.")
    if len(names) == 1 or wanted in names:
        return names[0] if len(names) == 1 else wanted
    if stall is not None:
        owners = [r[0] for r in stall.filter("owner is not null and owner <> ''").select("owner").distinct().limit(2).collect()]
        if len(owners) == 1 and owners[0] in names:
            return owners[0]
    raise Ask("Which character? Ask with character= one of: " + ", ".join(names))


def latest_report(reports: DataFrame, who: str) -> DataFrame:
    """The newest character sheet (character, ts, report), or if there is none the newest report."""
    sheet = F.coalesce(F.get_json_object("report", "$.Report") == "CharacterSheet", F.lit(False))
    return reports.filter(F.col("character") == who).orderBy(F.desc(sheet), F.desc("ts")).limit(1).select("character", "ts", "report")


def _map(path: str) -> Column:
    return F.explode(F.from_json(F.get_json_object("report", path), "map<string,string>"))


def skills(report: DataFrame) -> DataFrame:
    """(name, level, bonus), highest first."""
    rows = report.select(_map("$.Skills").alias("name", "v"))
    return rows.select("name", F.get_json_object("v", "$.Level").cast("int").alias("level"), F.coalesce(F.get_json_object("v", "$.BonusLevels").cast("int"), F.lit(0)).alias("bonus")).orderBy(F.desc(F.coalesce("level", F.lit(0))), "name")


def currencies(report: DataFrame) -> DataFrame:
    """(name, amount) of what there is any of, by name."""
    return report.select(_map("$.Currencies").alias("key", "amount")).filter(F.coalesce(F.col("amount").try_cast("double"), F.lit(0.0)) != 0).select(F.lower("key").alias("name"), "amount").orderBy("key")


def quests(report: DataFrame) -> DataFrame:
    """(state, n, first 40): active and completed ones."""
    lists = [report.select(F.lit(s).alias("state"), F.coalesce(F.from_json(F.get_json_object("report", f"$.{p}"), "array<string>"), F.array().cast("array<string>")).alias("q")) for s, p in (("active", "ActiveQuests"), ("completed", "CompletedQuests"))]
    return lists[0].unionByName(lists[1]).select("state", F.size("q").alias("n"), F.slice("q", 1, 40).alias("names"))


def favour(report: DataFrame) -> DataFrame:
    """(name, favor) of persons who are not neutral, by favor."""
    rows = report.select(_map("$.NPCs").alias("name", "v")).select("name", F.get_json_object("v", "$.FavorLevel").alias("favor"))
    return rows.filter("favor is not null and favor not in ('', 'Neutral')").orderBy("favor", "name")


def things(items: DataFrame, who: str, query: str | None = None) -> DataFrame:
    """type_id, name, rarity, storage, stack, value of the first 50 by storage and name."""
    own = items.filter(F.col("character") == who)
    if query:
        own = own.filter(F.contains(F.lower("name"), F.lit(query.lower())) | F.contains(F.lower("report"), F.lit(query.lower())))
    return own.select("type_id", "name", "rarity", "storage", "stack", "value").orderBy("storage", "name", "type_id").limit(50)


def ability_audit(report: DataFrame, abilities: DataFrame, skill: str) -> DataFrame:
    """(internal_name, name, level, state): known, missing, or sheet only, of one skill's abilities; other = known ones of no skill."""
    bare = skill.replace(" ", "")
    family = abilities.filter(same_name(F.col("skill"), skill) | same_name(F.replace("skill", F.lit(" "), F.lit("")), bare)).select("internal_name", "name", F.col("level").cast("double").alias("level"))
    listed = lambda s: F.from_json(F.get_json_object("report", f"$.Skills['{s}'].Abilities"), "array<string>")
    quoted = skill.replace("'", "")
    known = report.select(F.explode(F.coalesce(listed(quoted), listed(bare.replace("'", "")))).alias("internal_name")).distinct()
    other = report.select(F.explode(listed("Unknown")).alias("internal_name")).distinct().select("internal_name", F.lit(None).cast("string").alias("name"), F.lit(None).cast("double").alias("level"), F.lit("other").alias("state"))
    both = family.join(known.withColumn("has", F.lit(True)), "internal_name", "full").join(family.select("internal_name").distinct().withColumn("is_family", F.lit(True)), "internal_name", "left")
    state = F.when(F.col("is_family").isNull(), "sheet only").when(F.col("has"), "known").otherwise("missing")
    return both.select("internal_name", "name", "level", state.alias("state")).unionByName(other)


def stall_history(events: DataFrame, query: str | None = None, n: int = NEWEST) -> DataFrame:
    """The newest n events as (kind, event_at, item, quantity, price_unit, price_total, player, action), oldest first: sold, asking (40 at most) and others."""
    own = events.filter("ignored = 0")
    own = own.filter(name_like(F.col("item"), query)) if query else own
    at = F.coalesce("event_at", "event_timestamp")
    recent = own.select("item", "event_at", "action", "player", "quantity", "price_unit", "price_total", "id", at.alias("_at")).orderBy(F.desc("_at"), F.desc("id")).limit(n)
    priced = F.col("price_unit").isNotNull()
    kind = F.when((F.col("action") == "bought") & priced, "sold").when(F.col("action").isin("visible", "configured") & priced, "asking").otherwise("other")
    return recent.withColumn("kind", kind).select("kind", "event_at", "item", "quantity", "price_unit", "price_total", "player", "action", "id", "_at").orderBy("_at", "id").drop("_at")


def work_orders(items: DataFrame, quests_: DataFrame, query: str) -> DataFrame:
    """(item, needed, payout, each, skill, xp, quest, id) of collect quests that pay for the queried item. quests: id, name, objectives, rewards (JSON)."""
    item = shortest_match(items.select("internal_name", F.col("name").alias("item")), "item", query)
    goals = quests_.select("id", F.col("name").alias("quest"), "rewards", F.explode(F.from_json("objectives", "array<struct<Type:string,ItemName:string,Number:double>>")).alias("o")).filter("o.Type = 'Collect'")
    rewards = F.from_json("rewards", "array<struct<T:string,Amount:double,Skill:string,Xp:double>>")
    found = goals.join(F.broadcast(item), F.col("o.ItemName") == F.col("internal_name"))  # one row
    found = found.withColumn("pay", F.try_element_at(F.filter(rewards, lambda r: (r["T"] == "WorkOrderCurrency") & (r["Amount"] > 0)), F.lit(1))).withColumn("gain", F.try_element_at(F.filter(rewards, lambda r: (r["T"] == "SkillXp") & (r["Xp"] > 0)), F.lit(1)))
    needed = F.when(F.coalesce("o.Number", F.lit(0.0)) == 0, 1.0).otherwise(F.col("o.Number"))
    return found.filter("pay is not null").select("item", needed.alias("needed"), F.col("pay.Amount").alias("payout"), (F.col("pay.Amount") / needed).alias("each"), F.col("gain.Skill").alias("skill"), F.col("gain.Xp").alias("xp"), "quest", "id")


def base_value(items: DataFrame, query: str) -> DataFrame:
    """(name, value) of the item of that name, else the shortest that holds it."""
    return shortest_match(exact_else_like(items.select("name", "value"), "name", query), "name", query)


def recipe_family(items: DataFrame, query: str, prefixes: tuple[str, ...] = RECIPE_PREFIXES) -> DataFrame:
    """(name, value, n_all) of the first MOST_RECIPES recipes of which the name, after one of the prefixes, holds the query."""
    return prefix_family(items.select("name", "value"), "name", prefixes, query, MOST_RECIPES)


def value_or_recipe(items: DataFrame, query: str, prefixes: tuple[str, ...] = RECIPE_PREFIXES) -> DataFrame:
    """As base_value, but where that is no recipe and there is a recipe of the name, the recipe with the shortest name: that is what is traded."""
    is_recipe = F.coalesce(reduce(lambda a, b: a | b, [F.col("name").startswith(p + " ") for p in prefixes]), F.lit(False))
    recipe = recipe_family(items, query, prefixes).select("name", "value").orderBy(F.length("name"), "name").limit(1)
    both = base_value(items, query).withColumn("_p", F.when(is_recipe, 0).otherwise(2)).unionByName(recipe.withColumn("_p", F.lit(1)))
    return both.orderBy("_p").limit(1).select("name", "value")  # two rows at most


def sources_of(items: DataFrame, sources: DataFrame, query: str, npcs: DataFrame | None = None, quests: DataFrame | None = None, recipes: DataFrame | None = None) -> DataFrame:
    """(seq, type, target) of where the queried item comes from, in order: a person, quest or recipe by name, or its code if the table doesn't
    have it. items: code, name; sources: item_key, seq, entries (JSON); npcs: key, name; quests and recipes: id, name."""
    item = shortest_match(exact_else_like(items.select("code", "name"), "name", query), "name", query)
    own = sources.join(F.broadcast(item.select(F.concat(F.lit("item_"), "code").alias("item_key"))), "item_key")  # one row
    at = lambda k: F.nullif(F.get_json_object("entries", f"$.{k}"), F.lit(""))
    own = own.select("seq", F.coalesce(at("type"), F.lit("source")).alias("type"), at("npc").alias("npc"), F.nullif(at("questId"), F.lit("0")).alias("quest"), F.nullif(at("recipeId"), F.lit("0")).alias("recipe"))
    none = items.sparkSession.createDataFrame([], "code string, name string")
    names = lambda t, key: none if t is None else t.select(F.col(key).cast("string").alias("code"), "name")
    return first_of_kinds(own, [("npc", names(npcs, "key")), ("quest", names(quests, "id")), ("recipe", names(recipes, "id"))]).select("seq", "type", "target").orderBy("seq", "target")


def observations(seen: DataFrame, query: str, n: int = 20) -> DataFrame:
    """What other players' stalls were seen to sell, newest first."""
    return seen.filter(name_like(F.col("item_name"), query)).orderBy(F.desc("observed_at"), "item_name").limit(n)


def chat_prices(chat: DataFrame, query: str, n: int = 20) -> DataFrame:
    """(ts, channel, speaker, said) of social lines that hold the query and quote a price: of the newest 200 the first n."""
    lines = chat.filter(F.col("channel").isin(*SOCIAL) & F.contains(F.lower("text"), F.lit(query.lower())))
    newest = lines.orderBy(F.desc(F.coalesce("ts", F.lit(""))), "text").limit(200)
    said = F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, 160)
    return newest.filter(has_price(F.col("text"))).orderBy(F.desc(F.coalesce("ts", F.lit(""))), "text").limit(n).select("ts", "channel", "speaker", said.alias("said"))


def top_vendors(vendors: DataFrame, npcs: DataFrame, n: int = 10) -> DataFrame:
    """(npc_key, name, earned, available) of the n persons who have paid most in all; those without a record go. vendors: npc_key, councils_earned_lifetime,
    vendor_gold_available; npcs: key, name."""
    named = vendors.join(npcs.select(F.col("key").alias("npc_key"), "name"), "npc_key")
    rows = named.select("npc_key", "name", F.col("councils_earned_lifetime").alias("earned"), F.col("vendor_gold_available").alias("available"))
    return rows.orderBy(F.desc_nulls_last("earned"), "name", "npc_key").limit(n)


def keyword_label(keywords: Column) -> Column:
    return F.array_join(F.transform(keywords, spaced_words), ", ")
