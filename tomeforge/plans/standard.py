"""Registered queries: each applies an operator to the driver's tables, beside SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tomeforge.catalog import register, table
from tomeforge.functions import text as T
from tomeforge.operators import chunks, ledger, relational, search

register(
    "postings",
    lambda s, d: search.postings(table(s, d, "documents"), "doc_id", "text").select("doc_id", "term", "tf", F.col("dl").cast("long").alias("dl")),
    """with t as (select doc_id, list_filter(regexp_split_to_array(strip_accents(lower(coalesce(text, ''))), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') w from documents)
    select doc_id, term, count(*) as tf, max(dl)::bigint as dl from (select doc_id, len(w) dl, unnest(w) term from t) group by all""",
)
register(
    "running_total",
    lambda s, d: relational.running_total(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey"], ["l_linenumber", "l_quantity"], "l_quantity", "cumulative"),
    "select l_orderkey, l_linenumber, l_quantity, sum(l_quantity) over (partition by l_orderkey order by l_linenumber, l_quantity rows unbounded preceding) as cumulative from lineitem",
)
register(
    "cumulative_difference",
    lambda s, d: table(s, d, "lineitem").groupBy("l_orderkey").agg((F.sum(F.when(F.col("l_linenumber") <= 3, F.col("l_quantity")).otherwise(0.0)) - F.sum(F.when(F.col("l_linenumber") <= 1, F.col("l_quantity")).otherwise(0.0))).alias("gained")),
    "select l_orderkey, sum(case when l_linenumber <= 3 then l_quantity else 0 end) - sum(case when l_linenumber <= 1 then l_quantity else 0 end) as gained from lineitem group by 1",
)
register(
    "run_length",
    lambda s, d: relational.runs(table(s, d, "events"), ["user_id"], ["event_id"], "event_type"),
    """with a as (select *, case when event_type is not distinct from lag(event_type) over w and lag(1) over w is not null then 0 else 1 end b from events window w as (partition by user_id order by event_id)),
    c as (select *, sum(b) over (partition by user_id order by event_id) g from a) select user_id, event_type, min(event_id) as first, max(event_id) as last, count(*) as n from c group by user_id, g, event_type""",
)
register(
    "fullest_batch",
    lambda s, d: relational.fullest_batch(table(s, d, "events").withColumn("day", F.to_date("ts").cast("string")), ["user_id"], "day", "event_id").select("user_id", "day", "event_id"),
    """with e as (select *, cast(cast(ts as date) as varchar) as day from events), n as (select user_id, day, count(*) n, max(event_id) m from e group by 1, 2),
    b as (select user_id, day from n qualify row_number() over (partition by user_id order by n desc, m desc) = 1) select user_id, day, event_id from e semi join b using (user_id, day)""",
)
register(
    "latest_usable",
    lambda s, d: relational.latest(table(s, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint")), ["user_id"], [F.desc("ts"), F.desc("event_id")], F.col("k") >= 10).select("user_id", "event_id", "k"),
    "select user_id, event_id, k from (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events) where k >= 10 qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1",
)
register(
    "recent_share",
    lambda s, d: relational.recent_share(table(s, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], F.col("event_type") == "error"),
    "with r as (select * from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 10) select user_id, count(*) as n, avg((event_type = 'error')::int::double) as share from r group by 1",
)
register(
    "either_key_join",
    lambda s, d: relational.either_key_join(table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey"), table(s, d, "supplier").select("s_suppkey", "s_name"), "l_partkey", "l_suppkey", "s_suppkey", ["l_orderkey", "s_name"]),
    "select l_orderkey, s_name from lineitem join supplier on l_partkey = s_suppkey union select l_orderkey, s_name from lineitem join supplier on l_suppkey = s_suppkey",
)
register(
    "freshness",
    lambda s, d: relational.freshness(table(s, d, "orders").select("o_custkey", "o_orderdate").groupBy("o_custkey").agg(F.max("o_orderdate").alias("stamp")), table(s, d, "orders").filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max("o_orderdate").alias("stamp")), "o_custkey", "stamp"),
    """with a as (select o_custkey, max(o_orderdate) n from orders group by 1), b as (select o_custkey, max(o_orderdate) h from orders where o_orderstatus = 'F' group by 1)
    select o_custkey, case when n is null then 'purge' when h is null or h < n then 'download' else 'skip' end as action from a full join b using (o_custkey)""",
)
register("known_minus_family", lambda s, d: table(s, d, "customer").select(F.col("c_custkey").alias("key")).join(table(s, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("key")), "key", "left_anti"), "select c_custkey as key from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 300000)")
register(
    "singular_match",
    lambda s, d: table(s, d, "customer").filter(T.name_like(F.col("c_name"), "customers")).select("c_custkey", "c_name").orderBy(F.length("c_name"), "c_name", "c_custkey").limit(20),
    "select c_custkey, c_name from customer where contains(lower(c_name), 'customers') or contains(lower(c_name), 'customer') order by length(c_name), c_name, c_custkey limit 20",
)
register(
    "price_lines",
    lambda s, d: table(s, d, "documents").filter(T.has_price(F.col("text"))).select("doc_id"),
    r"""with p as (select doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(replace(lower(text), '@', ' @ '), '[^a-z0-9_.,@]+', ' ', 'g'), '(^|[^a-z_0-9])([0-9][0-9,.]*)([a-z])', '\1\2 \3', 'g'), ' '), lambda x: rtrim(x, '.,')), lambda x: x <> '') t from documents),
    f as (select doc_id, t, generate_subscripts(t, 1) i from p), n as (select doc_id, t[i + 1] after, case when i > 1 then t[i - 1] else '' end before, length(replace(split_part(t[i], '.', 1), ',', '')) k from f where regexp_full_match(t[i], '[0-9][0-9,]*([.][0-9]+)?'))
    select distinct doc_id from n where before = '@' or after in ('c', 'k', 'g', 'ea', 'ppu', 'each', 'per', 'council', 'councils', 'gold') or (before = 'for' and k >= 3) or k >= 5""",
)
register(
    "normalised_text",
    lambda s, d: table(s, d, "documents").select("doc_id", T.normalised(F.col("text")).alias("norm")),
    """select doc_id, trim(regexp_replace(regexp_replace(translate(lower(text), '''"`‘’“”', ''), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) as norm from documents""",
)
register("week_counts", lambda s, d: table(s, d, "events").groupBy(T.week(F.col("ts")).alias("week")).agg(F.count(F.lit(1)).alias("n")), "select strftime(ts, '%Y-%W') as week, count(*) as n from events group by 1")
register(
    "capped_list",
    lambda s, d: table(s, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("names")).select("n_regionkey", T.capped(F.col("names"), 3).alias("listed")),
    "select n_regionkey, array_to_string(list_sort(list(n_name))[1:3], ', ') || case when count(*) > 3 then ' +' || (count(*) - 3) || ' more' else '' end as listed from nation group by 1",
)
register(
    "several_contributors",
    lambda s, d: table(s, d, "events").groupBy("user_id").agg(F.count_distinct("event_type").alias("kinds"), F.count(F.lit(1)).alias("n")).filter("kinds >= 2"),
    "select user_id, count(distinct event_type) as kinds, count(*) as n from events group by 1 having count(distinct event_type) >= 2",
)
register(
    "rank_in_group",
    lambda s, d: table(s, d, "customer").withColumn("place", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))).filter("place <= 5").select("c_nationkey", "place", "c_custkey"),
    "select c_nationkey, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as place, c_custkey from customer qualify place <= 5",
)
register(
    "after_baseline",
    lambda s, d: ledger.after_baseline(table(s, d, "events").select("user_id", "event_id", F.col("ts").alias("event_at")), table(s, d, "events").filter("event_type = 'signup'").select("user_id", F.col("ts").alias("recorded_at")), ["user_id"]).select("user_id", "event_id"),
    "with b as (select user_id, max(ts) r from events where event_type = 'signup' group by 1) select user_id, event_id from events left join b using (user_id) where r is null or ts > r",
)
register(
    "grouped_spend",
    lambda s, d: table(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total")),
    "select l_returnflag, l_linestatus, count(*) as n, round(sum(l_extendedprice), 2) as total from lineitem group by 1, 2",
)
#: An ordered fold and text chunking have no SQL; their tests use fixtures.
register("inventory", lambda s, d: ledger.inventory(table(s, d, "events").select(F.col("user_id").alias("owner"), F.lit("stock").alias("item"), F.col("ts").alias("event_at"), F.col("event_id").alias("id"), F.expr("map('signup', 'added', 'view', 'visible', 'purchase', 'bought', 'click', 'removed', 'error', 'hid_item')[event_type]").alias("action"), (F.col("event_id") % 5 + 1).alias("quantity"), F.round("value", 2).alias("price_unit"))))
register("chunks", lambda s, d: chunks.chunked(table(s, d, "documents"), "doc_id", "text"))
