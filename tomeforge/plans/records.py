"""Registered queries of the typed tables, chat and sync plans, player sections and stores, beside SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomeforge.catalog import register, table
from tomeforge.operators import chat, ledger, player, search, sync
from tomeforge.plans.documents import _items, _npcs, _recipes, records
from tomeforge.sinks import tables as sinks
from tomeforge.sources import game_tables

register(
    "table_items",
    lambda s, d: game_tables.mapped("items", _items(s, d)).drop("raw"),
    """select p_partkey::bigint as code, p_name as name, p_brand as internal_name, p_type || ' | ' || p_brand as keywords, p_type || ' thing' as description, floor(p_retailprice) as value, p_size::bigint as stack, case when p_size > 25 then 'Hand' end as equip_slot,
    p_type || ' ' || p_size as skill_reqs, '' as effect_descs, '' as bestow_recipes from part""",
)
register(
    "table_recipes",
    lambda s, d: game_tables.mapped("recipes", _recipes(s, d)).select("id", "name", "skill", "skill_level_req", "reward_skill", "reward_xp", "description", "result_items", "keywords"),
    "select p_partkey::bigint as id, p_name as name, p_type as skill, p_size::bigint as skill_level_req, p_brand as reward_skill, (p_size * 2)::bigint as reward_xp, 'd' as description, p_partkey || 'x1' as result_items, '' as keywords from part",
)
register("recipe_ingredients", lambda s, d: game_tables.ingredients(_recipes(s, d)).select("recipe_id", "seq", "item_code", "stack"), "select p_partkey::bigint as recipe_id, 0 as seq, (p_partkey + 1)::bigint as item_code, 2::bigint as stack from part")
register(
    "ingredients_of_items",
    lambda s, d: game_tables.ingredients(_recipes(s, d)).join(game_tables.mapped("items", _items(s, d)).select(F.col("code").alias("item_code"), "name", "value"), "item_code").select("recipe_id", "name", (F.col("stack") * F.col("value")).alias("cost")),
    "select r.p_partkey::bigint as recipe_id, i.p_name as name, 2 * floor(i.p_retailprice) as cost from part r join part i on i.p_partkey = r.p_partkey + 1",
)
register(
    "table_abilities",
    lambda s, d: game_tables.mapped("abilities", records(table(s, d, "part"), "concat('ability_', p_partkey)", Name=F.col("p_name"), Skill=F.col("p_type"), Level=F.col("p_size"), PvE=F.struct((F.col("p_size") * 0.5).alias("PowerCost")), ResetTime=F.col("p_size"), Keywords=F.array(F.lit("Lint_Monster"), F.col("p_brand")))).select("id", "name", "skill", "level", "keywords", "reset_time", "power_cost"),
    "select p_partkey::bigint as id, p_name as name, p_type as skill, p_size::bigint as level, p_brand as keywords, p_size::double as reset_time, p_size * 0.5::double as power_cost from part",
)
register(
    "table_quests",
    lambda s, d: game_tables.mapped("quests", records(table(s, d, "customer"), "concat('quest_', c_custkey)", Name=F.col("c_name"), InternalName=F.upper("c_name"), FavorNpc=F.lit("N"), DisplayedLocation=F.col("c_mktsegment"), Rewards=F.array(F.col("c_nationkey")), Rewards_Items=F.array(F.struct(F.lit("Cup").alias("Item"), F.col("c_nationkey").alias("StackSize"))))).select("id", "name", "internal_name", "objectives", "rewards", "reward_items", "favor_npc", "displayed_location"),
    "select c_custkey::bigint as id, c_name as name, upper(c_name) as internal_name, '[]' as objectives, '[' || c_nationkey || ']' as rewards, 'Cupx' || c_nationkey as reward_items, 'N' as favor_npc, c_mktsegment as displayed_location from customer",
)
register("table_npcs", lambda s, d: game_tables.mapped("npcs", _npcs(s, d)).select("key", "name", "area_friendly", "description"), "select 'NPC_' || s_suppkey as key, s_name as name, 'Area ' || s_nationkey as area_friendly, 'sells' as description from supplier")
register(
    "services_of_npcs",
    lambda s, d: game_tables.mapped("npcs", _npcs(s, d)).select("name", F.explode(F.from_json("services", "array<struct<Type:string,Favor:string,Skills:array<string>>>")).alias("s")).filter("s.Type = 'Training' and array_contains(s.Skills, 'S3')").select("name", F.col("s.Favor").alias("favor")),
    "select s_name as name, 'Friends' as favor from supplier where s_nationkey = 3",
)
register(
    "table_effects",
    lambda s, d: game_tables.mapped("effects", records(table(s, d, "part"), "concat('effect_', p_partkey)", Name=F.col("p_name"), Desc=F.col("p_type"), Keywords=F.array("p_brand", "p_type"), Duration=F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise("long"))).drop("raw"),
    "select p_partkey::bigint as id, p_name as name, p_type as desc, p_brand || ' | ' || p_type as keywords, case when p_size % 2 = 0 then p_size::double end as duration from part",
)
register(
    "table_skills",
    lambda s, d: game_tables.mapped("skills", records(table(s, d, "nation"), "n_name", Id=F.col("n_nationkey"), Name=F.when(F.col("n_nationkey") % 2 == 0, F.lit("")).otherwise(F.lower("n_name")), Combat=F.col("n_regionkey") == 1, PassiveAdvancementTable=F.lit("P"), ActiveAdvancementTable=F.when(F.col("n_regionkey") == 2, F.lit("A")), AssociatedItemKeywords=F.array(F.lit("a")), RecipeIngredientKeywords=F.array("n_name"))).select("id", "name", "combat", "advancement_table", "associated_keywords"),
    "select n_nationkey::bigint as id, case when n_nationkey % 2 = 0 then n_name else lower(n_name) end as name, (n_regionkey = 1)::int as combat, case when n_regionkey = 2 then 'A' else 'P' end as advancement_table, 'a | ' || n_name as associated_keywords from nation",
)
register(
    "table_xp_levels",
    lambda s, d: game_tables.xp_levels(game_tables.mapped("xptables", table(s, d, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.struct(F.concat(F.lit("T"), F.first("l_orderkey")).alias("InternalName"), F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))), lambda x: x["l_quantity"].cast("bigint")).alias("XpAmounts"))).alias("raw")).select(F.concat(F.lit("x"), "l_orderkey").alias("key"), F.lit(None).cast("bigint").alias("id"), "raw"))),
    """select 'T' || l_orderkey as internal_name, (row_number() over w)::int as level, l_quantity::bigint as xp_needed, (sum(l_quantity::bigint) over (w rows unbounded preceding))::bigint as cumulative_xp from lineitem window w as (partition by l_orderkey order by l_linenumber, l_quantity)""",
)
register(
    "table_others",
    lambda s, d: game_tables.mapped("advancementtables", records(table(s, d, "nation"), "n_name", Keywords=F.array("n_name", F.lit("k")))).select(F.lit("advancement").alias("of"), "id", F.col("name").alias("shown"))
    .unionByName(game_tables.mapped("tsysclientinfo", records(table(s, d, "nation"), "concat('power_', n_nationkey)", InternalName=F.col("n_name"), Slots=F.array(F.lit("Head"), F.lit("Feet")))).select(F.lit("power").alias("of"), F.col("id").cast("string").alias("id"), F.concat_ws(":", "internal_name", "slots").alias("shown")))
    .unionByName(game_tables.mapped("attributes", records(table(s, d, "nation"), "n_name", Label=F.lower("n_name"), DefaultValue=F.col("n_regionkey"))).select(F.lit("attribute").alias("of"), "id", F.concat_ws(":", "label", F.col("default_value").cast("int").cast("string")).alias("shown")))
    .unionByName(game_tables.mapped("itemuses", records(table(s, d, "nation"), "n_name", RecipesThatUseItem=F.array("n_nationkey", "n_regionkey"))).select(F.lit("use").alias("of"), F.col("item_key").alias("id"), F.col("recipes_that_use").alias("shown")))
    .unionByName(game_tables.mapped("areas", records(table(s, d, "region"), "r_name", FriendlyName=F.col("r_name"))).select(F.lit("overflow").alias("of"), "id", F.get_json_object("raw", "$.FriendlyName").alias("shown"))),
    """select 'advancement' as "of", n_name as id, n_name || ' | k' as shown from nation union all select 'power', n_nationkey::varchar, n_name || ':Head | Feet' from nation union all select 'attribute', n_name, lower(n_name) || ':' || n_regionkey from nation
    union all select 'use', n_name, '[' || n_nationkey || ',' || n_regionkey || ']' from nation union all select 'overflow', 'areas:' || r_name, r_name from region""",
)
register(
    "uses_of_recipes",
    lambda s, d: game_tables.mapped("itemuses", records(table(s, d, "part"), "concat('item_', p_partkey)", RecipesThatUseItem=F.array(F.col("p_partkey"), F.col("p_partkey") * 2))).select("item_key", F.explode(F.from_json("recipes_that_use", "array<bigint>")).alias("id")).join(game_tables.mapped("recipes", _recipes(s, d)).select("id", "name"), "id"),
    "select k as id, 'item_' || u.p_partkey as item_key, r.p_name as name from (select p_partkey, unnest([p_partkey, p_partkey * 2])::bigint k from part) u join part r on r.p_partkey = k",
)
register(
    "table_sources",
    lambda s, d: game_tables.sources({n: records(table(s, d, t), k, entries=F.array(F.struct(F.lit(n).alias("type")), F.struct(F.lit("b").alias("type")))) for n, t, k in (("items", "part", "concat('item_', p_partkey)"), ("recipes", "supplier", "concat('recipe_', s_suppkey)"))}),
    """select 'item_' || p_partkey as item_key, i as seq, case i when 0 then '{"type":"items"}' else '{"type":"b"}' end as entries, 'items' as source_table from part, (values (0), (1)) v(i)
    union all select 'recipe_' || s_suppkey, i, case i when 0 then '{"type":"recipes"}' else '{"type":"b"}' end, 'recipes' from supplier, (values (0), (1)) v(i)""",
)
register(
    "entity_names",
    lambda s, d: game_tables.entity_names({"items": game_tables.mapped("items", _items(s, d)), "npcs": game_tables.mapped("npcs", _npcs(s, d))}).select("name", "type"),
    "select p_name as name, 'item' as type from part union all select p_brand, 'item' from part union all select s_name, 'npc' from supplier",
)
register(
    "chat_rows",
    lambda s, d: chat.folded(
        table(s, d, "customer").select(F.concat(F.lit("f"), "c_nationkey").alias("source_file"), F.explode(F.array(F.struct((F.col("c_custkey") * 3).alias("line_no"), F.concat(F.lit("24-01-02 03:04:05\t[Trade] "), F.col("c_mktsegment"), F.lit(": sells")).alias("value")), F.struct((F.col("c_custkey") * 3 + 1).alias("line_no"), F.col("c_name").alias("value")), F.struct((F.col("c_custkey") * 3 + 2).alias("line_no"), F.lit("[Item: Cup]").alias("value")))).alias("l")).select("source_file", "l.*")
    ).select("source_file", "line_no", "channel", "speaker", "text"),
    "select 'f' || c_nationkey as source_file, c_custkey * 3 as line_no, 'Trade' as channel, c_mktsegment as speaker, 'sells ' || c_name || ' [Item: Cup]' as text from customer",
)
register(
    "refined_actions",
    lambda s, d: sync.refined_actions(table(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 == 4, "added").otherwise("unknown").alias("action"), F.lit(None).cast("string").alias("player"), F.lit(None).cast("string").alias("item"), F.lit(None).cast("bigint").alias("price_total"), F.when(F.col("c_custkey") % 5 == 0, F.concat("c_name", F.lit(" paid 70 Councils to hire Bo for 24 hours."))).when(F.col("c_custkey") % 5 == 1, F.concat("c_name", F.lit(" sent a note to shop owner"))).when(F.col("c_custkey") % 5 == 2, F.concat(F.lit("Al hid "), "c_mktsegment", F.lit(" from shoppers"))).otherwise(F.concat(F.lit("Al set shop tag to "), "c_mktsegment")).alias("raw_message"))).drop("raw_message"),
    """select c_custkey, case c_custkey % 5 when 0 then 'hire_stall' when 1 then 'visitor_note' when 2 then 'hid_item' when 3 then 'shop_tag' else 'added' end as action, case when c_custkey % 5 = 1 then c_name end as player, case when c_custkey % 5 in (2, 3) then c_mktsegment end as item,
    case when c_custkey % 5 = 0 then 70::bigint end as price_total from customer""",
)
register(
    "stable_names",
    lambda s, d: table(s, d, "part").select("p_partkey", sync.stable_name(F.concat("p_name", F.lit("/ "), "p_brand", F.lit("?"))).alias("file")),
    "select p_partkey, replace(regexp_replace(p_name || ' ' || p_brand, '[^A-Za-z0-9 _-]', '', 'g'), ' ', '_') || '_' || sha256(p_name || '/ ' || p_brand || '?')[1:8] || '.txt' as file from part",
)
register(
    "page_plan",
    lambda s, d: sync.page_plan(table(s, d, "customer").select(F.col("c_name").alias("title"), F.col("c_nationkey").cast("string").alias("touched"), (F.col("c_custkey") % 7 == 0).alias("blocked")), table(s, d, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_name").alias("title"), F.when(F.col("c_custkey") % 5 == 0, "old").otherwise(F.col("c_nationkey").cast("string")).alias("touched")), table(s, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_name").alias("title"))),
    """select c_name as title, case when c_custkey % 7 = 0 then 'blocked' when c_custkey % 2 = 0 and c_custkey % 3 <> 0 and c_custkey % 5 <> 0 then 'skip' when c_custkey % 2 = 0 and c_custkey % 3 = 0 then 'adopt' else 'download' end as action from customer""",
)
register(
    "purge_plan",
    lambda s, d: sync.purge_plan(table(s, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_name").alias("title")), table(s, d, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_name").alias("title"), F.concat("c_name", F.lit(".txt")).alias("filename")), table(s, d, "customer").select(F.concat("c_name", F.lit(".txt")).alias("filename"))),
    "select c_name || '.txt' as filename, case when c_custkey % 3 = 0 then 'orphan' else 'stale' end as reason from customer where c_custkey % 3 = 0 or c_custkey % 2 = 1",
)
register(
    "ordered_distinct",
    lambda s, d: sync.ordered_distinct(table(s, d, "events").select("event_type", "event_id"), "event_type", "event_id"),
    "select event_type, min(event_id) as event_id from events group by 1",
)
register(
    "collision_suffix",
    lambda s, d: sync.collision_suffix(table(s, d, "part").select("p_partkey", F.col("p_name").alias("title")), "title", ["p_partkey"]),
    "select p_partkey, p_name || case when row_number() over w > 1 then '_' || row_number() over w else '' end as title from part window w as (partition by p_name order by p_partkey)",
)
register(
    "changed_files",
    lambda s, d: sinks.changed_files(table(s, d, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_name").alias("source_file"), F.md5("c_mktsegment").alias("stamp")), table(s, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_name").alias("source_file"), F.md5(F.when(F.col("c_custkey") % 5 == 0, "x").otherwise(F.col("c_mktsegment"))).alias("stamp"))),
    """select c_name as source_file, case when c_custkey % 3 <> 0 and c_custkey % 2 = 1 then 'new' when c_custkey % 3 = 0 then 'deleted' else 'modified' end as change from customer
    where (c_custkey % 3 <> 0 and c_custkey % 2 = 1) or (c_custkey % 3 = 0 and c_custkey % 2 = 0) or (c_custkey % 3 <> 0 and c_custkey % 2 = 0 and c_custkey % 5 = 0)""",
)
register(
    "reassembled",
    lambda s, d: search.reassembled(table(s, d, "documents").select(F.when(F.col("doc_id") < 10, F.concat(F.lit("a_chunk_"), "doc_id")).when(F.col("doc_id") == 10, "a").otherwise(F.col("doc_id").cast("string")).alias("id"), F.when(F.col("doc_id") < 10, "a").alias("parent_id"), "doc_id"), "a_chunk_3").select("id", "doc_id"),
    "select case when doc_id < 10 then 'a_chunk_' || doc_id else 'a' end as id, doc_id from documents where doc_id <= 10",
)
register(
    "price_snapshot",
    lambda s, d: ledger.inventory(table(s, d, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").cast("string").alias("item"), F.explode(F.array(F.struct(F.lit("1").alias("event_at"), F.lit(1).alias("id"), F.lit("added").alias("action"), (F.col("o_orderkey") % 9 + 3).alias("quantity"), F.lit(None).cast("double").alias("price_unit")), F.struct(F.lit("2").alias("event_at"), F.lit(2).alias("id"), F.lit("visible").alias("action"), F.lit(4).alias("quantity"), F.lit(5.0).alias("price_unit")), F.struct(F.lit("3").alias("event_at"), F.lit(3).alias("id"), F.lit("bought").alias("action"), F.lit(2).alias("quantity"), F.lit(5.0).alias("price_unit")))).alias("e")).select("owner", "item", "e.*")),
    """with q as (select o_custkey as owner, o_orderkey::varchar as item, o_orderkey % 9 + 3 n from orders) select owner, item, 5.0::double as price, (least(n, 4) - 2)::bigint as quantity, 1 as place, 'listed' as status from q
    union all select owner, item, null, (n - 4)::bigint, 2, 'listed' from q where n > 4""",
)
register(
    "skill_levels",
    lambda s, d: player.skills(table(s, d, "nation").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("n_name", F.struct(F.col("n_nationkey").alias("Level"), F.when(F.col("n_regionkey") > 2, F.col("n_regionkey")).alias("BonusLevels"))))).alias("Skills"))).alias("report"))),
    "select n_name as name, n_nationkey::int as level, case when n_regionkey > 2 then n_regionkey else 0 end::int as bonus from nation",
)
register(
    "favours",
    lambda s, d: player.favour(table(s, d, "nation").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("n_name", F.struct(F.when(F.col("n_regionkey") < 2, "Neutral").otherwise("Friends").alias("FavorLevel"))))).alias("NPCs"))).alias("report"))),
    "select n_name as name, 'Friends' as favor from nation where n_regionkey >= 2",
)
register(
    "stall_history",
    lambda s, d: player.stall_history(table(s, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("item"), F.col("ts").cast("string").alias("event_at"), F.col("ts").cast("string").alias("event_timestamp"), F.expr("map('purchase', 'bought', 'view', 'visible', 'click', 'configured')[event_type]").alias("action"), F.col("user_id").alias("player"), F.lit(1).alias("quantity"), F.col("value").alias("price_unit"), F.col("value").alias("price_total"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("ignored")), None).select("kind", "id"),
    "with r as (select event_id id, event_type, ts from events where event_type <> 'error' order by ts desc, event_id desc limit 120) select case event_type when 'purchase' then 'sold' when 'view' then 'asking' when 'click' then 'asking' else 'other' end as kind, id from r",
)
register(
    "work_orders",
    lambda s, d: player.work_orders(table(s, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("internal_name"), F.concat("p_name", F.lit(" "), "p_partkey").alias("name")), table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.to_json(F.array(F.struct(F.lit("Collect").alias("Type"), F.concat(F.lit("P"), F.col("c_custkey") % 100).alias("ItemName"), F.lit(4).alias("Number")))).alias("objectives"), F.to_json(F.array(F.struct(F.lit("WorkOrderCurrency").alias("T"), (F.col("c_custkey") * 8).alias("Amount")))).alias("rewards")), " 7").select("item", "each", "quest", "id"),
    """with i as (select p_partkey, p_name || ' ' || p_partkey nm from part where contains(p_name || ' ' || p_partkey, ' 7') order by length(p_name || ' ' || p_partkey), 2 limit 1)
    select nm as item, c_custkey * 2.0::double as each, c_name as quest, c_custkey as id from customer, i where 'P' || (c_custkey % 100) = 'P' || p_partkey and c_custkey > 0""",
)
register(
    "chat_prices",
    lambda s, d: player.chat_prices(table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("ts"), F.when(F.col("c_nationkey") % 2 == 0, "Trade").otherwise("Combat").alias("channel"), F.col("c_name").alias("speaker"), F.concat(F.lit("selling  cup "), F.when(F.col("c_custkey") % 3 == 0, F.lit("500 each")).otherwise(F.lit("soon"))).alias("text")), "CUP").select("ts", "speaker", "said"),
    "with n as (select * from customer where c_nationkey % 2 = 0 order by c_custkey::varchar desc limit 200) select c_custkey::varchar as ts, c_name as speaker, 'selling cup 500 each' as said from n where c_custkey % 3 = 0 order by c_custkey::varchar desc limit 20",
)
