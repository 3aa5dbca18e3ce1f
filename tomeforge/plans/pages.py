"""Registered queries on markup, parsed pages, trades, tool calls and capped results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeforge.catalog import register, table
from tomeforge.documents import barter, wiki_docs
from tomeforge.functions import wiki
from tomeforge.operators import calls, chat, reports
from tomeforge.runtime import shared_folder
from tomeforge.sinks.tables import Store

#: A page with every template that carries facts, nested and with values missing.
_MARKUP = """concat('{{Item|', p_name, '|x}} {{Spoiler|', p_brand, '|{{NPC|', p_type, '}} and ', p_size, '|more}} {{Quote|source=', p_brand, '|{{Item|', p_name, '}}!||', p_type, '}} {{Favor| ', p_type, ' }} ',
    '{{NPC training ', if(p_size % 2 = 0, 'unlock ', ''), 'row|item=', p_name, '{{pipe}}', p_brand, '|skilllevel=', if(p_size % 3 = 0, '?', cast(p_size as string)), '|cost=', p_partkey, '}} {{HOLIDAY\\n|A = {{Item|', p_name, '}} x2\\n|B = ', p_size, '\\n}} ',
    '{{MOB Location|area=', if(p_size % 4 = 0, '', p_type), '|location=', if(p_size % 5 = 0, '', p_name), '|lootlevel=', p_size, '}} {{MOB infobox|type=', p_type, '|immune=|effective=', p_brand, '}} {{Other|{{Skill|', p_name, '}}}} [[', p_type, ']]')"""
register(
    "wikicode",
    lambda s, d: table(s, d, "part").select("p_partkey", wiki.prose_text(F.expr(_MARKUP)).alias("said")),
    """select p_partkey, p_name || ' ' || p_brand || ' ' || p_type || ' and ' || p_size || '|more ' || p_brand || ' says: ' || p_name || '! ' || p_type || ' favor tier ' || p_type || ' '
    || case when p_size % 2 = 0 then 'Unlock: ' else 'Teaches: ' end || p_name || ': ' || p_brand || case when p_size % 3 = 0 then '' else ' - skill level ' || p_size end || ' - cost ' || p_partkey || ' A = ' || p_name || ' x2' || chr(10) || 'B = ' || p_size || ' '
    || case when p_size % 4 = 0 and p_size % 5 = 0 then '' else 'Located' || case when p_size % 4 = 0 then '' else ' in ' || p_type end || case when p_size % 5 = 0 then '' else ', specifically ' || p_name end || '; loot level ' || p_size || '.' end
    || ' Creature type: ' || p_type || '. Effectively damaged by: ' || p_brand || '. {{Other|' || p_name || '}} [[' || p_type || ']]' as said from part""",
)


def _parsed_again(s: SparkSession, d: str) -> DataFrame:
    """Pages after a second run, in which the French ones are newer and the German ones gone, and after a third with another parser."""
    docs, store = table(s, d, "documents"), Store(s, shared_folder(s))
    lang = F.coalesce("lang", F.lit("none"))
    pages = docs.select(F.col("doc_id").cast("string").alias("title"), "text", lang.alias("lang"))
    wiki_docs.cached_pages(store, pages.select("title", "text", F.lit("1").alias("stamp")))
    later = pages.filter("lang <> 'de'").select("title", "text", F.when(F.col("lang") == "fr", "2").otherwise("1").alias("stamp"))
    store.replace("second", wiki_docs.cached_pages(store, later).select("title", "stamp", "fresh"))
    store.replace("third", wiki_docs.cached_pages(store, later, wiki_docs.PARSER + 1).select("title", "stamp", "fresh"))
    return store.read("second").withColumn("run", F.lit(2)).unionByName(store.read("third").withColumn("run", F.lit(3)))


register(
    "parse_cache",
    _parsed_again,
    """with p as (select doc_id::varchar as title, case when lang = 'fr' then '2' else '1' end as stamp, lang from documents where coalesce(lang, 'none') <> 'de')
    select title, stamp, coalesce(lang = 'fr', false) as fresh, 2 as run from p union all select title, stamp, true, 3 from p""",
)


def _trades(s: SparkSession, d: str) -> DataFrame:
    parts = table(s, d, "part").select(F.col("p_partkey").alias("item_key"), F.concat_ws(" ", "p_name", "p_brand").alias("name"), "p_type")
    sold = table(s, d, "lineitem").withColumn("person", F.concat(F.lit("s"), "l_suppkey")).withColumn("table_id", F.concat("person", F.lit("_"), "l_returnflag", "l_linestatus"))
    offers = sold.select(F.col("l_partkey").alias("item_key"), F.col("l_suppkey").alias("place"), "person")
    given = F.concat(F.lit("One "), F.upper("name"), F.when(F.col("l_linenumber") == 2, "x").otherwise(""), F.lit(" of "), "p_type")
    asked = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" "), "l_returnflag")
    rows = sold.join(parts.withColumnRenamed("item_key", "l_partkey"), "l_partkey").select("person", "table_id", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row"), F.when(F.col("l_linenumber") == 1, F.array(given)).otherwise(F.array(asked, F.lit("and"), given)).alias("cells"))
    covers = sold.select("table_id", F.when((F.col("l_returnflag") == "N") & (F.col("l_suppkey") % 2 == 0), "").otherwise(F.concat("table_id", F.lit(" options"))).alias("text")).distinct()
    return barter.trades(parts.select("item_key", "name"), offers, rows, covers)


register(
    "trades",
    _trades,
    """with p as (select p_partkey item_key, p_name || ' ' || p_brand as name from part),
    o as (select l_partkey item_key, l_suppkey place from lineitem group by all),
    r as (select l_suppkey place, 's' || l_suppkey || '_' || l_returnflag || l_linestatus table_id, name, cast(floor(l_quantity) as int) || ' ' || l_returnflag || ' | and' asked, min(l_orderkey * 10 + l_linenumber) as "row"
        from lineitem join p on l_partkey = item_key where l_linenumber > 2 and not (l_returnflag = 'N' and l_suppkey % 2 = 0) group by 1, 2, 3, 4),
    h as (select item_key, name, place, table_id, asked, "row" from p join o using (item_key) join r using (name, place)),
    f as (select * from h qualify row_number() over (partition by item_key, table_id order by "row", asked) <= 3),
    g as (select item_key, name, place, table_id, string_agg(asked, ', ' order by "row", asked) requests from f group by 1, 2, 3, 4),
    t as (select *, row_number() over (partition by item_key order by place, table_id) k from g)
    select item_key, string_agg('Barter: s' || place || ' gives ' || name || ' in exchange for ' || requests || '.' || chr(10) || 'Barter options at s' || place || ': ' || table_id || ' options', chr(10) order by k) as trades from t where k <= 2 group by 1""",
)

_CALLS = """case turn % 4
    when 0 then concat('say ```tool\\n', to_json(struct(role as name, struct(text as query, turn as n) as args)), '\\n``` end')
    when 1 then concat('```tool\\n{"args": {"a": ', turn, '}}\\n``````tool\\n{"name": "', role, '"} more\\n```')
    when 2 then concat('<function=f.', role, '><parameter=title>\\n x', conv_id, '  y </parameter><parameter=n>5</parameter><parameter=n>"', role, '"</parameter></function><function=open>', text)
    else text end"""
register(
    "tool_calls",
    lambda s, d: (
        calls.tool_calls(table(s, d, "conversations").withColumn("text", F.expr(_CALLS)), "conv_id", "turn")
        .select("conv_id", "turn", "place", "name", F.expr("try_element_at(args, 'n')").alias("n"), "raw", F.when(F.col("args").isNotNull(), calls.preview(F.col("args"))).alias("about"))
    ),
    r"""select conv_id, turn, 0 as place, role as name, turn::varchar as n, null as raw, left(trim(regexp_replace(text, '\s+', ' ', 'g')), 100) as about from conversations where turn % 4 = 0
    union all select conv_id, turn, 0, null, null, '{"args": {"a": ' || turn || '}}', null from conversations where turn % 4 = 1
    union all select conv_id, turn, 1, null, null, '{"name": "' || role || '"} more', null from conversations where turn % 4 = 1
    union all select conv_id, turn, 0, 'f.' || role, role, null, 'x' || conv_id || ' y' from conversations where turn % 4 = 2""",
)
register(
    "middle_out",
    lambda s, d: reports.middle_out(table(s, d, "documents").select("source", "doc_id", F.substring("text", 1, 200).alias("line")), ["source"], ["doc_id"], "line", 3000).select("source", "doc_id", "n_left_out"),
    """with l as (select source, doc_id, length(left(coalesce(text, ''), 200)) + 1 as k from documents),
    s as (select *, sum(k) over (partition by source order by doc_id) a, sum(k) over (partition by source order by doc_id desc) b, sum(k) over (partition by source) t from l),
    m as (select *, t <= 3000 or a <= 1500 or b <= 1500 as keep from s), n as (select *, count(*) filter (where not keep) over (partition by source) as n_left_out from m)
    select source, doc_id, n_left_out from n where keep""",
)

#: A log in which every shape of line follows every other; event_id is the line's number and its shape follows from a mix of it.
_SHAPE = "(event_id * 7 + event_id div 9 * 5 + event_id div 31) % 9"
_LINES = f"""case {_SHAPE}
    when 0 then concat('20-01-01 10:00:00\\t[Trade] U', event_id, ': said ', event_id) when 1 then concat('  more ', event_id, ' ') when 2 then concat('[Item: A', event_id, '][Item: B]')
    when 3 then concat('20-01-01 10:00:00\\t[Error] text ', event_id) when 4 then concat('[Recipe: R', event_id, '] [Item: C [x]]') when 5 then ' '
    when 6 then concat('[the bell ', event_id, ']') when 7 then concat('20-01-01 10:00:00\\tnothing ', event_id) else concat('20-01-01 10:00:00\\t[Status] got [Item: X', event_id, '] [Item: Y]') end"""
register(
    "chat_shapes",
    lambda s, d: chat.folded(
        table(s, d, "events").select(F.concat(F.lit("f"), F.col("user_id") % 5).alias("source_file"), F.col("event_id").alias("line_no"), F.expr("event_id div 40").alias("piece"), F.expr(_LINES).alias("value")), piece="piece"
    ),
    f"""with l as (select 'f' || user_id % 5 as source_file, event_id as line_no, {_SHAPE.replace(" div ", " // ")} as k from events),
    s as (select *, last_value(case when k = 0 then true when k in (3, 6, 8) then false end ignore nulls) over (partition by source_file order by line_no rows unbounded preceding) as social from l where k not in (5, 7)),
    b as (select *, k in (0, 3, 6, 8) or (k in (2, 4) and not coalesce(social, false)) as begins from s),
    r as (select *, sum(begins::int) over (partition by source_file order by line_no) as n from b),
    t as (select *, case when k = 0 then 'said ' || line_no when k = 1 then 'more ' || line_no when k = 3 then 'text ' || line_no when k = 6 then '[the bell ' || line_no || ']' when k = 8 then 'X' || line_no || '; Y'
        when k = 2 and begins then 'A' || line_no || '; B' when k = 2 then '[Item: A' || line_no || '][Item: B]' when begins then 'R' || line_no || '; C [x]' else '[Recipe: R' || line_no || '] [Item: C [x]]' end as part from r where n > 0)
    select case when max(k) filter (where begins) in (0, 3, 8) then '20-01-01 10:00:00' else '' end as ts, case max(k) filter (where begins) when 0 then 'Trade' when 3 then 'Error' when 6 then 'system' else 'item' end as channel,
    case when max(k) filter (where begins) = 0 then 'U' || max(line_no) filter (where begins) end as speaker, string_agg(part, ' ' order by line_no) as text, source_file, max(line_no) filter (where begins) as line_no from t group by source_file, n""",
)
