"""Registered queries of the document builders: records are made as JSON from the driver's tables, so SQL can say what each document must hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeforge.catalog import register, table
from tomeforge.documents import builders, computed, wiki_docs
from tomeforge.functions import wiki
from tomeforge.operators import chunks


def records(df: DataFrame, key: str, **fields: Column) -> DataFrame:
    raw = F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))
    return df.select(F.expr(key).alias("key"), F.expr(key.rpartition("', ")[2].rstrip(")") if key.startswith("concat") else "null").cast("bigint").alias("id"), raw.alias("raw"))


def _items(s, d):
    return records(table(s, d, "part"), "concat('item_', p_partkey)", Name=F.col("p_name"), InternalName=F.col("p_brand"), Keywords=F.array("p_type", "p_brand"), Description=F.concat("p_type", F.lit(" thing")), MaxStackSize=F.col("p_size"), Value=F.floor("p_retailprice"), SkillReqs=F.create_map("p_type", "p_size"), EquipSlot=F.when(F.col("p_size") > 25, F.lit("Hand")))


def _recipes(s, d):
    one = F.struct((F.col("p_partkey") + 1).alias("ItemCode"), F.lit(2).alias("StackSize"))
    made = F.struct(F.col("p_partkey").alias("ItemCode"), F.lit(1).alias("StackSize"))
    return records(table(s, d, "part"), "concat('recipe_', p_partkey)", Name=F.col("p_name"), Skill=F.col("p_type"), SkillLevelReq=F.col("p_size"), Description=F.lit("d"), Ingredients=F.array(one), ResultItems=F.array(made), RewardSkill=F.col("p_brand"), RewardSkillXp=F.col("p_size") * 2, ItemMenuKeywordReq=F.when(F.col("p_size") < 10, F.concat(F.lit("Mushroom"), F.col("p_size"))))


def _npcs(s, d):
    return records(table(s, d, "supplier"), "concat('NPC_', s_suppkey)", Name=F.col("s_name"), Desc=F.lit("sells"), AreaFriendlyName=F.concat(F.lit("Area "), F.col("s_nationkey")), Services=F.array(F.struct(F.lit("Training").alias("Type"), F.lit("Friends").alias("Favor"), F.array(F.concat(F.lit("S"), F.col("s_nationkey"))).alias("Skills"))), Preferences=F.array(F.struct(F.lit("Love").alias("Desire"), F.concat(F.lit("P"), F.col("s_suppkey")).alias("Name"))))


def shown(df: DataFrame) -> DataFrame:
    return df.select("id", "type", "name", "text")


_N = "chr(10)"
_ITEM = f"""'Item: ' || p_name || {_N} || {_N} || 'Internal Name:' || {_N} || p_brand || {_N} || {_N} || 'Keywords:' || {_N} || p_type || ', ' || p_brand || {_N} || {_N} || 'Usage:' || {_N} || p_type || ' thing' || {_N} || {_N} || 'Description:' || {_N} || p_type || ' thing' || {_N} || {_N}
|| 'Stack Size:' || {_N} || p_size || {_N} || {_N} || 'Value:' || {_N} || floor(p_retailprice)::bigint || {_N} || {_N} || {_N} || case when p_size > 25 then 'Slot: Hand' || {_N} else '' end || 'Requires ' || p_type || ' skill level ' || p_size"""
register("doc_item", lambda s, d: shown(builders.items(_items(s, d))), f"select 'item_' || p_partkey as id, 'item' as type, p_name as name, {_ITEM} as text from part")
register(
    "doc_recipe",
    lambda s, d: shown(builders.recipes(_recipes(s, d), _items(s, d))),
    f"""select 'recipe_' || p.p_partkey as id, 'recipe' as type, p.p_name as name, 'Recipe: ' || p.p_name || {_N} || {_N} || 'Skill:' || {_N} || p.p_type || {_N} || {_N} || 'Required Skill Level:' || {_N} || p.p_size || {_N} || {_N} || 'Description:' || {_N} || 'd' || {_N} || {_N} || 'Ingredients:' || {_N}
    || '- ' || coalesce(q.p_name, 'Unknown Item (' || (p.p_partkey + 1) || ')') || ' x2' || {_N} || {_N} || 'Produces:' || {_N} || '- ' || p.p_name || ' x1' || {_N} || 'Item codes (ingredients: ' || (p.p_partkey + 1) || '; results: ' || p.p_partkey || ').' || {_N} || {_N} || {_N} || 'Rewards:' || {_N}
    || 'Awards ' || p.p_brand || ' XP: +' || (p.p_size * 2) || {_N} || 'Reward Skill: ' || p.p_brand as text from part p left join part q on q.p_partkey = p.p_partkey + 1""",
)
register(
    "doc_skill",
    lambda s, d: shown(builders.skills(records(table(s, d, "nation"), "n_name", Name=F.initcap("n_name"), Description=F.lit("d"), Rewards=F.create_map(F.concat((F.col("n_nationkey") + 2).cast("string"), F.lit("_Bonus")), F.create_map(F.lit("Recipe"), F.col("n_name")), F.lit("1"), F.create_map(F.lit("Title"), F.lit("T"))), Parents=F.array(F.lit("A"), F.lit("B")), Combat=F.col("n_regionkey") == 1))),
    f"""select 'skill_' || n_name as id, 'skill' as type, upper(n_name[1]) || lower(n_name[2:]) as name, 'Skill: ' || upper(n_name[1]) || lower(n_name[2:]) || {_N} || {_N} || 'Description:' || {_N} || 'd' || {_N} || {_N} || 'Rewards:' || {_N} || '- Level 1: Title = T' || {_N} || '- Level ' || (n_nationkey + 2) || ' (Bonus): Recipe = ' || n_name || {_N} || {_N}
    || 'Advancement Hints:' || {_N} || 'No advancement hints listed' || {_N} || {_N} || 'Parents:' || {_N} || 'A, B' || {_N} || {_N} || 'Type: ' || case when n_regionkey = 1 then 'Combat' else 'Non-Combat' end as text from nation""",
)
register(
    "doc_quest",
    lambda s, d: shown(builders.quests(records(table(s, d, "customer"), "concat('quest_', c_custkey)", Name=F.col("c_name"), Description=F.lit("d"), Keywords=F.when(F.col("c_custkey") % 5 == 0, F.array(F.lit("Lint_NotObtainable"))), DisplayedLocation=F.col("c_mktsegment"), Objectives=F.array(F.struct(F.lit("Kill").alias("Type"), F.lit("rats").alias("Description"), F.col("c_nationkey").alias("Number"))), Requirements=F.array(F.struct(F.lit("MinSkillLevel").alias("T"), F.lit("Dig").alias("Skill"), F.col("c_nationkey").alias("Level"))), Rewards=F.array(F.struct(F.lit("Currency").alias("T"), F.lit("HillRenown").alias("Currency"), F.col("c_nationkey").alias("Amount")))))),
    f"""select 'quest_quest_' || c_custkey as id, 'quest' as type, c_name as name, 'Quest: ' || c_name || {_N} || {_N} || 'Description:' || {_N} || 'd' || {_N} || {_N} || 'Location: ' || c_mktsegment || {_N} || {_N} || 'Objectives:' || {_N} || '- Kill: rats (x' || c_nationkey || ', target: )' || {_N} || {_N} || 'Requirements:' || {_N} || '- Skill Dig >= ' || c_nationkey
    || {_N} || {_N} || 'Rewards:' || {_N} || '- +' || c_nationkey || ' Hill Renown' as text from customer where c_custkey % 5 <> 0""",
)
register(
    "doc_ability",
    lambda s, d: shown(builders.abilities(records(table(s, d, "part"), "concat('ability_', p_partkey)", Name=F.col("p_name"), Description=F.lit("d"), Skill=F.col("p_type"), DamageType=F.lit("Fire"), Target=F.lit("Enemy"), Level=F.col("p_size"), ResetTime=F.lit(3), PvE=F.when(F.col("p_size") > 9, F.struct(F.col("p_size").alias("Damage"), F.lit(4).alias("PowerCost"))), Keywords=F.array(F.when(F.col("p_size") < 3, "Lint_MonsterAbility").otherwise(F.col("p_brand")))))),
    f"""select 'ability_ability_' || p_partkey as id, 'ability' as type, p_name as name, 'Ability: ' || p_name || {_N} || {_N} || 'Description:' || {_N} || 'd' || {_N} || {_N} || 'Skill: ' || p_type || {_N} || 'Damage Type: Fire' || {_N} || 'Target: Enemy' || {_N} || 'Level: ' || p_size || {_N} || 'Reset Time: 3s'
    || case when p_size > 9 then {_N} || {_N} || 'PvE: Damage=' || p_size || ', PowerCost=4, RageCost=0, Range=0' else '' end || {_N} || {_N} || 'Keywords: ' || p_brand as text from part where p_size >= 3""",
)
register(
    "doc_npc",
    lambda s, d: shown(builders.npcs(_npcs(s, d))),
    f"""select 'npc_NPC_' || s_suppkey as id, 'npc' as type, s_name as name, 'NPC: ' || s_name || {_N} || {_N} || 'Description:' || {_N} || 'sells' || {_N} || {_N} || 'Location: Area ' || s_nationkey || {_N} || {_N} || 'Services:' || {_N} || '- Training (Favor: Friends) - Skills: S' || s_nationkey || {_N} || {_N} || 'Gift preferences:' || {_N} || '- Love: P' || s_suppkey as text from supplier""",
)
register(
    "doc_effect",
    lambda s, d: shown(builders.effects(records(table(s, d, "part"), "concat('effect_', p_partkey)", Name=F.col("p_name"), Desc=F.when(F.col("p_size") % 2 == 0, F.col("p_type")), Keywords=F.array("p_brand")))),
    f"select 'effect_effect_' || p_partkey as id, 'effect' as type, p_name as name, 'Effect: ' || p_name || {_N} || {_N} || 'Description:' || {_N} || p_type || {_N} || {_N} || 'Keywords: ' || p_brand as text from part where p_size % 2 = 0",
)
register(
    "doc_lorebook",
    lambda s, d: shown(builders.lorebooks(records(table(s, d, "customer"), "concat('book_', c_custkey)", Title=F.col("c_name"), Text=F.concat(F.lit("''Old'' <b>"), F.col("c_mktsegment"), F.lit("</b>")), Category=F.lit("C"), LocationHint=F.lit("L")))),
    f"select 'lorebook_book_' || c_custkey as id, 'lorebook' as type, c_name as name, 'Lore Book: ' || c_name || {_N} || {_N} || 'Category: C' || {_N} || 'Location: L' || {_N} || {_N} || 'Content:' || {_N} || 'Old ' || c_mktsegment as text from customer",
)
register(
    "doc_goal",
    lambda s, d: shown(builders.goals(records(table(s, d, "customer"), "c_name", Id=F.col("c_custkey"), Label=F.col("c_name"), Zone=F.col("c_mktsegment"), LargeHint=F.when(F.col("c_custkey") % 2 == 0, F.lit("look")), SmallHint=F.when(F.col("c_custkey") % 3 == 0, F.lit("near"))))),
    f"select 'goal_' || c_custkey as id, 'directedgoal' as type, c_name as name, 'Directed Goal: ' || c_name || {_N} || {_N} || 'Zone: ' || c_mktsegment || case when c_custkey % 2 = 0 then {_N} || {_N} || 'Hint: look' else '' end || case when c_custkey % 3 = 0 then {_N} || {_N} || 'Small Hint: near' else '' end as text from customer where c_custkey % 2 = 0 or c_custkey % 3 = 0",
)
register(
    "doc_area_title_vault",
    lambda s, d: shown(builders.areas(records(table(s, d, "region"), "concat('A', r_regionkey)", FriendlyName=F.col("r_name"), ShortFriendlyName=F.lower("r_name")))).unionByName(shown(builders.titles(records(table(s, d, "nation"), "concat('t', n_nationkey)", Title=F.col("n_name"))))).unionByName(shown(builders.vaults(records(table(s, d, "supplier"), "concat('v', s_suppkey)", NpcFriendlyName=F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")), Area=F.lit("A"), NumSlots=F.col("s_nationkey"), HasAssociatedNpc=F.col("s_suppkey") % 2 == 0)))),
    f"""select 'area_A' || r_regionkey as id, 'area' as type, r_name as name, 'Area: ' || r_name || {_N} || {_N} || 'Short Name: ' || lower(r_name) || {_N} || 'Internal ID: A' || r_regionkey as text from region union all select 'title_t' || n_nationkey, 'title', n_name, 'Player Title: ' || n_name from nation
    union all select 'vault_v' || s_suppkey, 'vault', case when s_suppkey % 2 = 0 then s_name else 'Vault v' || s_suppkey end, 'Storage Vault: ' || case when s_suppkey % 2 = 0 then s_name else 'Vault v' || s_suppkey end || {_N} || {_N} || 'Area: A' || {_N} || 'Slots: ' || s_nationkey || {_N} || 'Has Associated NPC: ' || case when s_suppkey % 2 = 0 then 'True' else 'False' end from supplier""",
)
register(
    "doc_item_use",
    lambda s, d: shown(builders.item_uses(table(s, d, "lineitem").groupBy("l_partkey").agg(F.to_json(F.struct(F.array_sort(F.collect_set("l_suppkey")).alias("RecipesThatUseItem"))).alias("raw")).select(F.concat(F.lit("item_"), F.col("l_partkey") * 2).alias("key"), F.lit(None).cast("bigint").alias("id"), "raw"), _items(s, d))),
    f"""with u as (select l_partkey * 2 k, list_sort(list(distinct l_suppkey)) r from lineitem group by 1) select 'itemuse_item_' || k as id, 'itemuse' as type, coalesce(p_name, 'Unknown Item (' || k || ')') as name,
    'Item Usage: ' || coalesce(p_name, 'Unknown Item (' || k || ')') || {_N} || {_N} || 'Used in ' || len(r) || ' recipes:' || {_N} || 'Recipe IDs: ' || array_to_string(r, ', ') as text from u left join part on p_partkey = k""",
)
register(
    "doc_landmark",
    lambda s, d: shown(builders.landmarks(table(s, d, "nation").groupBy("n_regionkey").agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("n_name").alias("Name"), F.lit("Well").alias("Type"), F.lit("d").alias("Desc"))))).alias("raw")).select(F.concat(F.lit("A"), F.col("n_regionkey")).alias("key"), F.lit(None).cast("bigint").alias("id"), "raw"))),
    f"select 'landmark_A' || n_regionkey || '_' || n_name || '_' || (row_number() over (partition by n_regionkey order by n_name) - 1) as id, 'landmark' as type, n_name as name, 'Landmark: ' || n_name || {_N} || {_N} || 'Type: Well' || {_N} || 'Area: A' || n_regionkey || {_N} || 'Location: ' || {_N} || {_N} || 'Description:' || {_N} || 'd' as text from nation",
)
register(
    "doc_tables",
    lambda s, d: shown(builders.advancement(records(table(s, d, "nation"), "concat('a', n_nationkey)", InternalName=F.col("n_name"), Level_1=F.create_map(F.lit("HP"), F.col("n_regionkey")), X=F.col("n_nationkey"))))
    .unionByName(shown(builders.behaviours(records(table(s, d, "nation"), "n_name", Comment=F.lit("c"), MobilityType=F.lit("Fixed"), UncontrolledPet=F.col("n_regionkey") == 1, Abilities=F.create_map(F.lit("Bite"), F.struct(F.col("n_regionkey").alias("minLevel")))))))
    .unionByName(shown(builders.attributes(records(table(s, d, "nation"), "n_name", Label=F.lower("n_name"), DefaultValue=F.col("n_nationkey"), DisplayRule=F.lit("R"), DisplayType=F.lit("T")))))
    .unionByName(shown(builders.xp_tables(records(table(s, d, "nation"), "concat('x', n_nationkey)", InternalName=F.col("n_name"), XpAmounts=F.when(F.col("n_regionkey") > 0, F.array(F.col("n_regionkey"), F.col("n_nationkey")))))))
    .unionByName(shown(builders.treasures(records(table(s, d, "nation"), "concat('p', n_nationkey)", InternalName=F.col("n_name"), Skill=F.lit("S"), Suffix=F.lit("of X"), Slots=F.array(F.lit("Head"), F.lit("None")), Tiers=F.create_map(F.lit("id_1"), F.struct(F.col("n_regionkey").alias("MinLevel"), F.lit("Rare").alias("MinRarity"), F.array(F.lit("a"), F.lit("b")).alias("EffectDescs"))))))),
    f"""select 'advtable_a' || n_nationkey as id, 'advancementtable' as type, n_name as name, 'Advancement Table: ' || n_name || {_N} || {_N} || '- Level_1:' || {_N} || '  HP: ' || n_regionkey || {_N} || '- X: ' || n_nationkey as text from nation
    union all select 'ai_' || n_name, 'ai', n_name, 'AI Behavior: ' || n_name || {_N} || {_N} || 'Comment: c' || {_N} || 'Mobility: Fixed' || {_N} || 'Uncontrolled Pet: ' || case when n_regionkey = 1 then 'True' else 'False' end || {_N} || {_N} || 'Abilities:' || {_N} || '- Bite (levels ' || n_regionkey || '-max)' from nation
    union all select 'attr_' || n_name, 'attribute', lower(n_name), 'Attribute: ' || lower(n_name) || {_N} || {_N} || 'Internal Name: ' || n_name || {_N} || 'Default Value: ' || n_nationkey || {_N} || 'Display Rule: R' || {_N} || 'Display Type: T' from nation
    union all select 'xptable_x' || n_nationkey, 'xptable', n_name, 'XP Table: ' || n_name || {_N} || {_N} || 'XP required per level:' || {_N} || 'Level 1: ' || n_regionkey || ' XP' || {_N} || 'Level 2: ' || n_nationkey || ' XP' from nation where n_regionkey > 0
    union all select 'tsys_p' || n_nationkey, 'tsys', n_name, 'Treasure Item: ' || n_name || {_N} || {_N} || 'Skill: S' || {_N} || 'Suffix: of X' || {_N} || 'Slots: Head' || {_N} || {_N} || 'Tiers:' || {_N} || '- id_1: Level ' || n_regionkey || '-?, Rare: a, b' from nation""",
)
register(
    "doc_source",
    lambda s, d: shown(builders.source_entries(table(s, d, "lineitem").filter("l_linenumber <= 2").groupBy("l_partkey").agg(F.array_sort(F.collect_set(F.struct(F.col("l_suppkey").alias("k"), F.lit("Barter").alias("type"), F.concat(F.lit("NPC_"), F.col("l_suppkey") * 2).alias("npc")))).alias("entries")).select(F.concat(F.lit("item_"), "l_partkey").alias("key"), F.lit(None).cast("bigint").alias("id"), F.to_json(F.struct("entries")).alias("raw")), "items", _items(s, d), _npcs(s, d))),
    f"""with e as (select distinct l_partkey, l_suppkey from lineitem where l_linenumber <= 2), t as (select l_partkey, string_agg('- Barter from ' || coalesce(s_name, 'Unknown NPC (NPC_' || (l_suppkey * 2) || ')'), {_N} order by l_suppkey) x from e left join supplier on s_suppkey = l_suppkey * 2 group by 1)
    select 'source_items_item_' || l_partkey as id, 'source' as type, coalesce(p_name, 'Unknown Item (' || l_partkey || ')') || ' Sources' as name, 'Source: ' || coalesce(p_name, 'Unknown Item (' || l_partkey || ')') || {_N} || {_N} || 'Found in sources_items:' || {_N} || x as text from t left join part on p_partkey = l_partkey""",
)
register(
    "doc_ability_keyword",
    lambda s, d: shown(builders.ability_keywords(records(table(s, d, "part"), "lpad(p_partkey, 9, '0')", MustHaveAbilityKeywords=F.array("p_type", "p_brand")))),
    f"""with k as (select p_partkey, case when p_brand < p_type then p_brand || ',' || p_type else p_type || ',' || p_brand end c, p_type || ', ' || p_brand l from part), r as (select *, row_number() over (partition by c order by p_partkey) i from k)
    select 'abkeyword_' || sha256(c)[1:12] || case when i > 1 then '_' || i else '' end as id, 'abilitykeyword' as type, 'Keyword Combo: ' || c as name, 'Ability Keyword Combo: ' || c || {_N} || 'Required Keywords: ' || l as text from r""",
)
register(
    "recipe_rankings",
    lambda s, d: shown(computed.recipe_rankings(_recipes(s, d))),
    f"""with r as (select p_type, p_size, p_name, row_number() over (partition by p_type order by p_size desc, p_partkey) i from part) select 'summary_' || lower(p_type) as id, 'summary' as type, p_type || ' Summary' as name, p_type || ' recipes ranked by skill level:' || {_N} || string_agg(i || '. ' || p_name || ' (' || p_size || ')', {_N} order by i) as text from r group by p_type""",
)
register(
    "gathering_rankings",
    lambda s, d: shown(computed.gathering_rankings(records(table(s, d, "part"), "concat('item_', p_partkey)", Name=F.col("p_name"), Keywords=F.array(F.concat(F.lit("Mushroom"), F.col("p_size")), F.lit("Loot"))), _recipes(s, d))),
    f"""with r as (select p_size, p_name, row_number() over (order by p_size desc, p_partkey) i from part where p_size < 10) select 'summary_gathering_mycology' as id, 'summary' as type, 'Mycology Gathering Summary' as name, 'Mycology items ranked by required skill level:' || {_N} || string_agg(i || '. ' || p_name || ' (' || p_size || ')', {_N} order by i) as text from r""",
)
_PAGES = lambda s, d: table(s, d, "part").filter("p_size < 20").groupBy(F.when(F.col("p_size") < 10, "Mining").otherwise("Myconic").alias("title")).agg(F.array_join(F.collect_list(F.concat(F.lit("| {{Item|"), F.col("p_name"), F.lit(" "), F.col("p_brand"), F.lit("}} || "), F.col("p_size"), F.lit("? || x"))), "\n").alias("text"))
register(
    "harvest_rankings",
    lambda s, d: shown(computed.harvest_rankings(_PAGES(s, d))),
    f"""with m as (select case when p_size < 10 then 'Mining' else 'Mycology' end sk, p_name || ' ' || p_brand nm, max(p_size) lv from part where p_size < 20 group by 1, 2), r as (select *, row_number() over (partition by sk order by lv desc, nm desc) i from m)
    select 'summary_wiki_' || lower(sk) as id, 'summary' as type, sk || ' Wiki Gathering Summary' as name, sk || ' items ranked by required skill level (wiki):' || {_N} || string_agg(i || '. ' || nm || ' (' || lv || ')', {_N} order by i) as text from r group by sk""",
)
register(
    "harvest_levels",
    lambda s, d: computed.harvest_levels(_PAGES(s, d)),
    "select lower(p_name || ' ' || p_brand) as key, case when max(p_size) < 10 then 'Mining' else 'Mycology' end as skill, max(p_size)::int as level from part where p_size < 20 group by 1",
)
register(
    "gift_lists",
    lambda s, d: shown(computed.gift_lists(_items(s, d), table(s, d, "lineitem").groupBy("l_partkey").agg(F.to_json(F.struct(F.collect_list(F.struct(F.when(F.col("l_linenumber") < 3, "NpcGift").otherwise("Barter").alias("type"), F.concat(F.lit("NPC_"), "l_suppkey").alias("npc"))).alias("entries"))).alias("raw")).select(F.concat(F.lit("item_"), "l_partkey").alias("key"), F.lit(None).cast("bigint").alias("id"), "raw"), _npcs(s, d))),
    f"""with g as (select distinct s_name, p_name from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey where l_linenumber < 3), b as (select distinct p_name, x from (select p_name, upper(p_type) x from part union all select p_name, 'Brand' from part)),
    l as (select p_name, string_agg({_N} || '  (type: ' || x || ')', '' order by x) t from b group by 1) select 'summary_gifts_' || replace(lower(s_name), ' ', '_') as id, 'summary' as type, s_name || ' Gift Preferences' as name, s_name || ' accepts these items as gifts:' || {_N} || string_agg('- ' || g.p_name || t, {_N} order by g.p_name) as text from g join l using (p_name) group by s_name""",
)
register(
    "combat_xp",
    lambda s, d: shown(computed.combat_xp(records(table(s, d, "supplier"), "s_name", Level_1=F.create_map(F.lit(computed.COMBAT_XP), F.col("s_nationkey")), Level_2=F.when(F.col("s_suppkey") == 1, F.create_map(F.lit(computed.COMBAT_XP), F.lit(5)))))),
    f"""select 'combatxp_1' as id, 'combatxp' as type, 'Combat XP by Monster Archetype, Level 1' as name, 'Combat XP by Monster Archetype — Level 1' || {_N} || {_N} || 'The combat XP ({computed.COMBAT_XP}) earned for defeating each monster archetype at this level, highest first:' || {_N} || {_N} || string_agg('- ' || s_name || ': ' || s_nationkey, {_N} order by s_nationkey desc, lower(s_name)) as text from supplier""",
)
register(
    "skill_recipes",
    lambda s, d: computed.skill_recipes(_recipes(s, d)).select("skill", "key", "name", "req"),
    "select p_type as skill, 'recipe_' || p_partkey as key, p_name as name, p_size as req from part union select p_brand, 'recipe_' || p_partkey, p_name, p_size from part",
)
register("trainers", lambda s, d: computed.trainers(_npcs(s, d)), "select 'NPC_' || s_suppkey as key, s_name as name, 'Area ' || s_nationkey as area, 'S' || s_nationkey as skill from supplier")
register(
    "synergies",
    lambda s, d: computed.synergies(records(table(s, d, "nation"), "n_name", Name=F.lower("n_name"), Rewards=F.create_map(F.concat(F.col("n_nationkey").cast("string"), F.lit("_x")), F.create_map(F.lit("BonusToSkill"), F.concat(F.lit("R"), F.col("n_regionkey")))))),
    "select 'R' || n_regionkey as skill, n_name as source, lower(n_name) as name, [n_nationkey::int] as levels from nation",
)
register(
    "skill_quests",
    lambda s, d: computed.skill_quests(records(table(s, d, "customer"), "c_name", Name=F.col("c_name"), Rewards=F.array(F.struct(F.lit("SkillXp").alias("T"), F.concat(F.lit("S"), F.col("c_nationkey")).alias("Skill"))), Requirements=F.array(F.array(F.struct(F.lit("MinSkillLevel").alias("T"), F.col("c_mktsegment").alias("Skill")))))),
    "select c_name as key, c_name as name, 'S' || c_nationkey as skill from customer union select c_name, c_name, c_mktsegment from customer",
)
register(
    "inferred_names",
    lambda s, d: builders.assembled([builders.areas(records(table(s, d, "region"), "r_name")).withColumn("name", F.lit(None).cast("string")), builders.titles(records(table(s, d, "nation"), "n_name", Title=F.col("n_name")))]).select("id", "name"),
    "select 'area_' || r_name as id, r_name as name from region union all select 'title_' || n_name, n_name from nation",
)
register(
    "page_text",
    lambda s, d: table(s, d, "supplier").select("s_suppkey", wiki.plain_text(F.concat(F.lit("'''"), "s_name", F.lit("''' {{Quote|by|of "), "s_nationkey", F.lit("}} [[A|b]] [[File:x.png]]<br>\n== Use ==\nend")), F.lit("t")).alias("text")),
    "select s_suppkey, s_name || ' of ' || s_nationkey || ' b ' || chr(10) || chr(10) || '## Use' || chr(10) || 'end' as text from supplier",
)
register(
    "chunk_lineage",
    lambda s, d: chunks.chunked(table(s, d, "documents"), "doc_id", "text").groupBy(F.coalesce("parent_id", "id").alias("doc")).agg(F.max("chunk_count").alias("chunks"), F.count(F.lit(1)).cast("int").alias("n")).filter("chunks = n").select("doc", (F.col("n") > 1).alias("is_cut")),
    "select doc_id::varchar as doc, length(coalesce(text, '')) > 1024 as is_cut from documents",
)
register(
    "creatures",
    lambda s, d: shown(wiki_docs.creatures(table(s, d, "supplier").select(F.col("s_name").alias("title"), F.concat(F.lit("{{MOB infobox| type = Insect\n}}\nIt flies at "), "s_name", F.lit(".\n== X ==\n{{MOB Location| area = [[Hill|N"), "s_nationkey", F.lit("]] }}[[Category:Lake Creatures]]")).alias("text")))),
    f"""select 'creature_' || s_name as id, 'wiki' as type, s_name as name, 'Creature Locations: ' || s_name || {_N} || 'Type: Insect' || {_N} || 'Locations: N' || s_nationkey || ', Lake' || {_N} || 'Description: It flies at ' || s_name || '.' || {_N} || s_name || ' is an Insect creature. It can be found in N' || s_nationkey || ', Lake.' as text from supplier""",
)
register(
    "growing_tables",
    lambda s, d: shown(wiki_docs.growing(table(s, d, "part").filter("p_size < 20").groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name", "p_size"))), lambda x: F.concat(F.lit("| {{Item|"), x["p_name"], F.lit("}} || "), x["p_size"].cast("string"), F.lit(" || 2h || a || b || full || -"))), "\n").alias("t")).select(F.col("p_brand").alias("title"), F.concat(F.lit("Growing Time\n"), "t").alias("text")))),
    f"""select 'summary_wiki_growing_' || lower(p_brand) as id, 'summary' as type, p_brand || ' Growing Table Summary' as name, p_brand || ' growing table (per item, wiki):' || {_N} || string_agg('- ' || p_name || ': ' || p_brand || ' level ' || p_size || '; grows in 2h; adequate substrate a; very well in b; moon phases: robust in full', {_N} order by p_partkey) as text from part where p_size < 20 group by p_brand""",
)
register(
    "page_documents",
    lambda s, d: shown(wiki_docs.page_documents(table(s, d, "customer").select(F.col("c_name").alias("title"), F.concat("c_name", F.lit(" is the lead of this page, and it is long enough to be kept.\n== Use ==\nshort\n{|\n! A !! B\n|-\n| "), "c_mktsegment", F.lit(" || "), "c_nationkey", F.lit("\n|}")).alias("text")))),
    """select 'wiki_' || c_name as id, 'wiki' as type, c_name as name, c_name || ' is the lead of this page, and it is long enough to be kept.' as text from customer union all select 'wiki_' || replace(c_name, '#', '_') || '_table_0_coverage', 'wiki', c_name, c_name || ' table covers: ' || c_mktsegment from customer
    union all select 'wiki_' || replace(c_name, '#', '_') || '_table_0_row_0', 'wiki', c_name, c_name || ' table row: ' || c_mktsegment || ' | ' || c_nationkey from customer""",
)
register(
    "topics",
    lambda s, d: wiki_docs.topics(table(s, d, "customer").select(F.col("c_name").alias("filename"), F.when(F.col("c_custkey") % 2 == 0, "requires level 3").otherwise("nothing").alias("text"))),
    """with f as (select c_name, row_number() over (order by c_name) i, count(*) over () n from customer where c_custkey % 2 = 0) select 'crafting_progressions' as topic, max(n)::int as n, '==Crafting Progressions==' || chr(10) || 'Auto-generated from ' || max(n) || ' wiki sources.' || chr(10) || chr(10) || string_agg('Source: ' || c_name || chr(10) || 'requires level 3' || chr(10) || chr(10), '' order by i) as text from f where i <= 5""",
)
