"""Registered queries for finding, naming and listing, beside SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomeforge.catalog import register, table
from tomeforge.functions import text as T
from tomeforge.operators import guard, lookup, reports

COLOURS = ("small", "red", "blue", "large")

register("same_name", lambda s, d: table(s, d, "nation").filter(lookup.same_name(F.col("n_name"), "nation_7")).select("n_nationkey", "n_name"), "select n_nationkey, n_name from nation where lower(n_name) = 'nation_7'")
register(
    "shortest_match",
    lambda s, d: lookup.shortest_match(table(s, d, "nation").select("n_name", "n_nationkey"), "n_name", "TION_1s"),
    "select n_name, n_nationkey from nation where contains(lower(n_name), 'tion_1s') or contains(lower(n_name), 'tion_1') order by length(n_name), n_name limit 1",
)
register(
    "exact_else_like",
    lambda s, d: lookup.exact_else_like(table(s, d, "nation").select("n_nationkey", "n_name"), "n_name", "Nation_1"),
    "with f as (select n_nationkey, n_name, lower(n_name) = 'nation_1' e from nation where contains(lower(n_name), 'nation_1')) select n_nationkey, n_name from f where e or not (select coalesce(bool_or(e), false) from f)",
)
register(
    "like_without_exact",
    lambda s, d: lookup.exact_else_like(table(s, d, "nation").select("n_nationkey", "n_name"), "n_name", "ation_2"),
    "select n_nationkey, n_name from nation where contains(lower(n_name), 'ation_2')",
)
register(
    "prefix_family",
    lambda s, d: lookup.prefix_family(table(s, d, "part").select("p_partkey", "p_name"), "p_name", COLOURS, "rings"),
    "with f as (select p_partkey, p_name from part where " + " or ".join(f"(starts_with(lower(p_name), '{p} ') and (contains(substr(lower(p_name), {len(p) + 2}), 'rings') or contains(substr(lower(p_name), {len(p) + 2}), 'ring')))" for p in COLOURS) + ") select *, (select count(*) from f) as n_all from f order by p_name, p_partkey limit 40",
)
register("channels", lambda s, d: table(s, d, "events").filter(F.col("event_type").isin("click", "view", "error")).select("event_id", "event_type"), "select event_id, event_type from events where event_type in ('click', 'view', 'error')")
register("none_of", lambda s, d: table(s, d, "documents").filter(lookup.none_of(F.col("source"), ("src0", "src1"))).select("doc_id", "source"), "select doc_id, source from documents where source not in ('src0', 'src1')")
register(
    "named",
    lambda s, d: lookup.named(
        table(s, d, "customer").select("c_custkey", "c_nationkey"),
        "c_nationkey",
        table(s, d, "nation").filter("n_regionkey < 2").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name")),
        "nation",
        table(s, d, "nation").filter("n_regionkey = 2").select(F.col("n_nationkey").alias("code"), F.lower("n_name").alias("name")),
    ),
    """select c_custkey, c_nationkey, case when n_regionkey < 2 then n_name when n_regionkey = 2 then lower(n_name) else 'Unknown nation (' || c_nationkey || ')' end as name
    from customer left join nation on c_nationkey = n_nationkey""",
)
register(
    "first_of_kinds",
    lambda s, d: lookup.first_of_kinds(
        table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 1, F.col("l_suppkey")).alias("supp"), F.when(F.col("l_linenumber") <= 2, F.col("l_partkey")).alias("prt"), F.when(F.col("l_linenumber") == 3, F.col("l_orderkey")).alias("ord")),
        [("supp", table(s, d, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("name"))), ("prt", table(s, d, "part").select(F.col("p_partkey").alias("code"), F.col("p_name").alias("name"))), ("ord", table(s, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("code"), F.col("o_orderdate").cast("date").cast("string").alias("name")))],
    ).select("l_orderkey", "l_linenumber", "target"),
    """select l_orderkey, l_linenumber, case when l_linenumber = 1 then coalesce(s_name, l_suppkey::varchar) when l_linenumber = 2 then coalesce(p_name, l_partkey::varchar)
    else coalesce(o_orderdate::date::varchar, l_orderkey::varchar) end as target from lineitem left join supplier on l_suppkey = s_suppkey left join part on l_partkey = p_partkey
    left join (select * from orders where o_orderstatus = 'F') on l_orderkey = o_orderkey where l_linenumber <= 3""",
)
register(
    "pages_of",
    lambda s, d: lookup.pages_of(
        table(s, d, "nation").select(F.lit(1).alias("place"), F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name")).unionByName(table(s, d, "region").select(F.lit(2).alias("place"), F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"))).unionByName(table(s, d, "nation").select(F.lit(3).alias("place"), F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))),
        table(s, d, "nation").select(F.concat(F.lit(" "), F.initcap("n_name")).alias("title")).unionByName(table(s, d, "region").select(F.lower("r_name").alias("title"))),
    ),
    """select ' ' || array_to_string(list_transform(string_split(n_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') as title, 1 as place, n_nationkey::bigint as id from nation
    union all select lower(r_name), 2, r_regionkey::bigint from region""",
)
register(
    "best_by_name",
    lambda s, d: lookup.best_by_name(table(s, d, "orders").select(F.concat(F.lit(" "), F.upper("o_orderstatus"), F.lit(" ")).alias("name"), "o_totalprice", "o_orderkey"), "name", "o_totalprice", "o_orderkey"),
    "select lower(o_orderstatus) as key, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) as o_orderkey, max(o_totalprice) as o_totalprice from orders group by 1",
)
register(
    "by_keyword",
    lambda s, d: lookup.by_keyword(table(s, d, "part").select("p_partkey", F.split("p_name", " ").alias("words")), table(s, d, "nation").select("n_nationkey", F.split_part(F.lower("n_name"), F.lit(" "), F.lit(1)).alias("need")).unionByName(table(s, d, "part").select(F.col("p_partkey").alias("n_nationkey"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("need"))), "words", "need", "n_nationkey").select("p_partkey", "keyword", F.col("maker.n_nationkey").alias("maker")),
    """with m as (select need, max(k) as maker from (select split_part(lower(n_name), ' ', 1) need, n_nationkey k from nation union all select split_part(p_name, ' ', 1), p_partkey from part) group by 1),
    w as (select distinct p_partkey, unnest(string_split(p_name, ' ')) as keyword from part) select p_partkey, keyword, maker from w join m on keyword = need""",
)
register(
    "unless_in",
    lambda s, d: lookup.unless_in(table(s, d, "customer").groupBy("c_nationkey").agg(F.lit("customers").alias("of"), F.count(F.lit(1)).alias("n")), table(s, d, "supplier").filter("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.lit("suppliers").alias("of"), F.count(F.lit(1)).alias("n")), "c_nationkey"),
    """with b as (select s_nationkey as c_nationkey, 'suppliers' as "of", count(*) as n from supplier where s_acctbal > 5000 group by 1)
    select * from b union all select c_nationkey, 'customers', count(*) from customer where c_nationkey not in (select c_nationkey from b) group by 1""",
)
register(
    "both_differences",
    lambda s, d: lookup.both_differences(table(s, d, "customer").select(F.col("c_custkey").alias("key")), table(s, d, "part").select(F.col("p_partkey").alias("key")), "key"),
    "select c_custkey as key, 'known' as side from customer where c_custkey not in (select p_partkey from part) union all select p_partkey, 'family' from part where p_partkey not in (select c_custkey from customer)",
)
register(
    "closure",
    lambda s, d: lookup.closure(table(s, d, "customer").select(F.floor(F.col("c_custkey") / 3).alias("parent"), F.col("c_custkey").cast("long").alias("child")), s.range(1, 3).select(F.col("id").alias("node")), 4),
    """with recursive e as (select (c_custkey // 3)::bigint parent, c_custkey::bigint child from customer), r as (select unnest([1, 2])::bigint node, 0 depth union select child, depth + 1 from r join e on node = parent where depth < 4)
    select node, min(depth)::int as depth from r group by 1""",
)
register(
    "gifts",
    lambda s, d: lookup.gifts(table(s, d, "lineitem").select(F.col("l_suppkey").alias("npc_code"), F.col("l_partkey").alias("item_code")), table(s, d, "part").select(F.col("p_partkey").alias("code"), F.col("p_name").alias("name")), table(s, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("name"))),
    "select distinct s_name as npc, p_name as item from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey where s_acctbal > 0",
)
register(
    "newest_events",
    lambda s, d: reports.newest(table(s, d, "events").select("event_id", "ts"), [F.desc("ts"), F.desc("event_id")], 120).orderBy("ts", "event_id"),
    "select * from (select event_id, ts from events order by ts desc, event_id desc limit 120) order by ts, event_id",
)
register("top_by_level", lambda s, d: reports.newest(table(s, d, "supplier").select("s_suppkey", F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("level")), [F.desc_nulls_last("level"), F.asc("s_suppkey")], 10), "select s_suppkey, case when s_acctbal > 0 then s_acctbal end as level from supplier order by level desc nulls last, s_suppkey limit 10")
register(
    "numeric_prefix_sort",
    lambda s, d: table(s, d, "part").select("p_partkey", F.concat_ws("_", F.when(F.col("p_partkey") % 7 != 0, F.col("p_size").cast("string")).otherwise("x"), F.lit("bonus")).alias("key")).withColumn("place", reports.numeric_prefix(F.col("key"))).orderBy("place", "p_partkey").limit(50),
    "select p_partkey, case when p_partkey % 7 <> 0 then p_size::varchar else 'x' end || '_bonus' as key, case when p_partkey % 7 <> 0 then p_size else 0 end as place from part order by place, p_partkey limit 50",
)
register(
    "ranked_list",
    lambda s, d: reports.ranked_list(table(s, d, "supplier").select("s_nationkey", "s_name", F.floor("s_acctbal").alias("level")), "s_nationkey", "s_name", "level"),
    """with r as (select s_nationkey, s_name, floor(s_acctbal)::bigint lv, row_number() over (partition by s_nationkey order by floor(s_acctbal) desc, s_name) i from supplier)
    select s_nationkey, count(*)::int as n, string_agg(i || '. ' || s_name || ' (level ' || lv || ')', chr(10) order by i) as listing from r group by 1""",
)
register(
    "highest_by_name",
    lambda s, d: reports.highest_by_name(table(s, d, "part").select("p_brand", F.split_part("p_type", F.lit(" "), F.lit(1)).alias("name"), F.col("p_size").cast("long").alias("level")), "p_brand", "name", "level"),
    """with m as (select p_brand, split_part(p_type, ' ', 1) nm, max(p_size) lv from part group by 1, 2), r as (select *, row_number() over (partition by p_brand order by lv desc, nm) i from m)
    select p_brand, count(*)::int as n, string_agg(i || '. ' || nm || ' (level ' || lv || ')', chr(10) order by i) as listing from r group by 1""",
)
register(
    "labelled",
    lambda s, d: reports.labelled(table(s, d, "part").select("p_brand", F.split_part("p_type", F.lit(" "), F.lit(1)).alias("name"), F.split_part("p_type", F.lit(" "), F.lit(-1)).alias("label")), "p_brand", "name", "label", 4),
    """with e as (select distinct p_brand, split_part(p_type, ' ', 1) nm, split_part(p_type, ' ', -1) lb from part), t as (select p_brand, nm, nm || ' (' || string_agg(lb, ', ' order by lb) || ')' tx from e group by 1, 2),
    r as (select *, row_number() over (partition by p_brand order by nm) i, count(*) over (partition by p_brand) c from t)
    select p_brand, string_agg(tx, '; ' order by i) filter (where i <= 4) || case when max(c) > 4 then '; +' || (max(c) - 4) || ' more' else '' end as listing from r group by 1""",
)
register(
    "cross_tab",
    lambda s, d: reports.cross_tab(table(s, d, "supplier").select("s_name", F.floor("s_acctbal").alias("one"), F.floor(F.col("s_acctbal") / 1000).alias("two"), F.when(F.col("s_suppkey") == 1, F.lit(0.5)).alias("three")), "s_name", {1: "one", 2: "two", 3: "three"}),
    """with p as (select 1 as level, s_name, floor(s_acctbal)::bigint v from supplier union all select 2, s_name, floor(s_acctbal / 1000)::bigint from supplier)
    select level, count(*)::int as n, string_agg(s_name || ': ' || v, ', ' order by v desc, s_name) as listing from p where v > 0 group by 1 having count(*) >= 2""",
)
register(
    "within_budget",
    lambda s, d: reports.within_budget(table(s, d, "part").select("p_brand", "p_partkey", "p_name"), ["p_brand"], [F.col("p_partkey")], "p_name", 60, 12),
    """with u as (select p_brand, p_partkey, p_name, sum(length(p_name) + 1) over w - 1 used, row_number() over w place from part window w as (partition by p_brand order by p_partkey rows unbounded preceding))
    select p_brand, p_partkey, p_name from u where used <= 60 and place <= 12""",
)
register(
    "price_tiers",
    lambda s, d: reports.price_tiers(table(s, d, "lineitem").select("l_suppkey", F.when(F.col("l_linenumber") < 5, F.col("l_discount")).alias("price"), F.col("l_linenumber").cast("long").alias("quantity")), ["l_suppkey"], "price", "quantity"),
    """with t as (select l_suppkey, round(case when l_linenumber < 5 then l_discount end * 1000) m, sum(l_linenumber)::bigint q from lineitem group by 1, 2)
    select l_suppkey, m / 1000 as price, q as quantity, row_number() over (partition by l_suppkey order by m asc nulls last)::int as place from t""",
)
register("table_counts", lambda s, d: reports.table_counts({n: table(s, d, n) for n in ("orders", "lineitem", "documents", "pages", "events")}), " union all ".join(f"select '{n}' as tbl, count(*) as n from {n}" for n in ("orders", "lineitem", "documents", "pages", "events")))
register("distinct_owners", lambda s, d: table(s, d, "events").agg(F.count_distinct("user_id").alias("owners"), F.max("ts").alias("newest")), "select count(distinct user_id) as owners, max(ts) as newest from events")
register(
    "status_report",
    lambda s, d: reports.status_report(table(s, d, "orders").select("o_orderpriority", F.expr("map('F', 'PASS', 'O', 'FAIL', 'P', 'ERROR')[o_orderstatus]").alias("status"), (F.col("o_orderkey") % 3).cast("long").alias("missing")), ["o_orderpriority"], "status", "missing"),
    "select o_orderpriority, count(*) as n, count(*) filter (o_orderstatus = 'F') as passed, count(*) filter (o_orderstatus = 'O') as failed, count(*) filter (o_orderstatus = 'P') as erred, sum(o_orderkey % 3)::bigint as missing from orders group by 1",
)
register(
    "run_table",
    lambda s, d: reports.status_report(table(s, d, "orders").select("o_orderpriority", (F.col("o_custkey") % 4).cast("long").alias("temperature"), F.expr("map('F', 'PASS', 'O', 'FAIL', 'P', 'ERROR')[o_orderstatus]").alias("status"), (F.col("o_orderkey") % 3).cast("long").alias("missing")), ["o_orderpriority", "temperature"], "status", "missing").orderBy("o_orderpriority", "temperature", F.desc("passed"), "missing"),
    "select o_orderpriority, o_custkey % 4 as temperature, count(*) as n, count(*) filter (o_orderstatus = 'F') as passed, count(*) filter (o_orderstatus = 'O') as failed, count(*) filter (o_orderstatus = 'P') as erred, sum(o_orderkey % 3)::bigint as missing from orders group by 1, 2",
)
register(
    "chosen_ids",
    lambda s, d: reports.chosen_ids(table(s, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("key")), s.range(1, 400).select(F.col("id").alias("key")), table(s, d, "customer").select(F.col("c_custkey").alias("key")), "key"),
    "select c_custkey as key, case when c_custkey in (select o_custkey from orders where o_totalprice > 300000) then 'derived' else 'manual' end as why from customer where c_custkey < 400 or c_custkey in (select o_custkey from orders where o_totalprice > 300000)",
)
register(
    "recent_window",
    lambda s, d: table(s, d, "events").filter(F.col("ts") >= F.date_sub(F.to_date(F.lit("2024-02-10")), 100)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")),
    "select event_type, count(*) as n from events where ts >= date '2024-02-10' - 100 group by 1",
)
register(
    "json_predicate",
    lambda s, d: table(s, d, "events").filter(F.get_json_object("props", "$.k").cast("int") == 7).select("event_id"),
    "select event_id from events where json_extract_string(props, '$.k')::int = 7",
)
register(
    "case_insensitive_sort",
    lambda s, d: table(s, d, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name")).otherwise(F.col("n_name")).alias("shown")).orderBy(F.lower("shown")).limit(7),
    "select n_nationkey, case when n_nationkey % 2 = 0 then lower(n_name) else n_name end as shown from nation order by lower(n_name) limit 7",
)
register(
    "null_default_sort",
    lambda s, d: table(s, d, "events").select("event_id", F.when(F.col("event_type") != "error", F.col("ts").cast("string")).alias("stamp")).orderBy(F.desc(F.coalesce("stamp", F.lit(""))), "event_id").limit(200).select("event_id"),
    "select event_id from events order by coalesce(case when event_type <> 'error' then ts::varchar end, '') desc, event_id limit 200",
)


def _guarded(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("guarded_orders")
    table(spark, sf_dir, "customer").createOrReplaceTempView("guarded_customers")
    return guard.guarded_sql(spark, "with big as (select o_custkey, sum(o_totalprice) s from guarded_orders group by 1) select c_custkey, round(s, 2) as total from guarded_customers join big on c_custkey = o_custkey where exists (select 1 from guarded_orders o where o.o_custkey = c_custkey and o_orderstatus = 'P') order by s desc, c_custkey")


register("sql_query", _guarded, "with big as (select o_custkey, sum(o_totalprice) s from orders group by 1) select c_custkey, round(s, 2) as total from customer join big on c_custkey = o_custkey where exists (select 1 from orders o where o.o_custkey = c_custkey and o_orderstatus = 'P') order by s desc, c_custkey limit 201")


def _set_operations(spark, sf_dir):
    a, b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"))
    return a.intersect(b).withColumn("of", F.lit("both")).unionByName(a.exceptAll(b.distinct()).withColumn("of", F.lit("customers"))).unionByName(a.union(b).distinct().withColumn("of", F.lit("either")))


register(
    "set_operations",
    _set_operations,
    """select key, 'both' as "of" from (select c_custkey as key from customer intersect select o_custkey from orders) union all select key, 'customers' from (select c_custkey as key from customer except select o_custkey from orders)
    union all select key, 'either' from (select c_custkey as key from customer union select o_custkey from orders)""",
)
register(
    "names_and_hashes",
    lambda s, d: table(s, d, "part").select("p_partkey", T.squeezed(F.concat(F.lit("  "), F.col("p_type"), F.lit("  X"))).alias("squeezed"), T.spaced_words(F.concat(F.lit("XP"), F.initcap(F.split_part("p_name", F.lit(" "), F.lit(1))), F.lit("Boost"))).alias("words"), T.article(F.col("p_name")).alias("article"), T.short_sha256(F.col("p_name")).alias("sha"), T.short_md5(F.col("p_name")).alias("md5"), T.grouped_number(F.col("p_partkey") * 1000).alias("grouped"), T.table_cell(F.concat("p_name", F.lit("|x\ny"))).alias("cell")),
    """select p_partkey, lower(p_type) || ' x' as squeezed, 'XP ' || upper(split_part(p_name, ' ', 1)[1]) || lower(split_part(p_name, ' ', 1)[2:]) || ' Boost' as words, case when lower(p_name[1]) in ('a', 'e', 'i', 'o', 'u') then 'an' else 'a' end as article,
    sha256(p_name)[1:12] as sha, md5(p_name)[1:8] as md5, format('{:,}', (p_partkey * 1000)::bigint) as grouped, substr(replace(replace(p_name || '|x' || chr(10) || 'y', '|', '\\|'), chr(10), ' '), 1, 200) as cell from part""",
)
