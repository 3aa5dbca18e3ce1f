"""What read-only SQL accepts, and that nothing else gets through in any spelling."""

import pytest

from tomeforge.operators.guard import guarded_sql


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("guard") / "rows")
    spark.range(5).selectExpr("id as a", "cast(id as string) as b", "array(id) as c", "current_timestamp() as t", "named_struct('x', id) as s", "map('k', id) as m").write.parquet(path)
    spark.read.parquet(path).createOrReplaceTempView("things")
    spark.range(5).selectExpr("id as a").createOrReplaceTempView("other")
    spark.range(3).createOrReplaceGlobalTempView("shared")
    spark.sql(f"create table if not exists hidden using parquet location '{path}'")
    spark.udf.register("shout", lambda x: x, "string")
    yield path
    spark.sql("drop table if exists hidden")
    spark.catalog.dropGlobalTempView("shared")


@pytest.mark.parametrize(
    "text",
    [
        "select a, count(*) n, sum(distinct a) filter (where a > 1) from things where b like '%1%' or a between 1 and 3 and b is not null group by a having count(*) > 0 order by n desc nulls last, 1 limit 5 offset 1",
        "with x as (select * from things), y(q) as (select a from x) select q, sum(q) over (partition by q order by q desc rows between 1 preceding and current row) from y",
        "select case when a = 1 then 'x' else 'y' end, cast(a as double), a div 2, -a, not (a = 1), a <=> 2, a in (select a from other), exists (select 1 from other o where o.a = things.a), (select max(a) from other) from things",
        "select i.a, c[0], s.x, m['k'] from things i left join other o on i.a = o.a join other using (a) left anti join other q on q.a = i.a + 9",
        "select explode(c) from things union all select a from other intersect select a from other except select 7",
        "select distinct b rlike '1', b || 'x', a & 1, t + interval 1 hour, extract(year from t), trim(both 'x' from b), substring(b from 1 for 2), transform(c, x -> x + 1), try_cast(b as int), b ilike any ('a', 'b'), b::int from things",
        "select * from things lateral view outer explode(c) e as v",
        "values (1, 'a'), (2, 'b')",
        "select * from range(3) r, lateral (select * from other o where o.a = r.id)",
        "select b, grouping(b), count(*) from things group by grouping sets ((b), ())",
        "select sum(a) over w from things window w as (partition by b)",
        "with recursive r(n) as (select 1 union all select n + 1 from r where n < 5) select * from r",
        "with hidden as (select 1 as k) select * from hidden where exists (with other as (select k from hidden) select * from other)",
        "SELECT * FROM Things",
        "select * from (select * from things) pivot (sum(a) for b in ('1', '2'))",
    ],
)
def test_queries_over_views(spark, store, text):
    assert guarded_sql(spark, text).count() > 0


@pytest.mark.parametrize(
    "text",
    [
        "select * from parquet.`{path}`",
        "select * from identifier('par' || 'quet.`{path}`')",
        "select * from identifier('things')",
        "select identifier('java_method')('java.lang.Math', 'abs', 1)",
        "select java_method('java.lang.Math', 'abs', 1)",
        "select reflect('java.lang.Math', 'abs', 1)",
        "select try_reflect('java.lang.Math', 'abs', 1)",
        "select `java_method`('java.lang.Math', 'abs', 1)",
        "select builtin.java_method('java.lang.Math', 'abs', 1)",
        "select system.builtin.abs(1)",
        "select shout('a')",
        "execute immediate 'drop table hidden'",
        "execute immediate 'create table made as select 1'",
        "execute immediate 'select 1'",
        "begin drop table hidden; end",
        "begin select 1; end",
        "call something()",
        "select * from hidden",
        "select * from spark_catalog.default.hidden",
        "select * from default.hidden",
        "select * from global_temp.shared",
        "select * from hidden where exists (with hidden as (select 1) select * from hidden)",
        "select * from things where a in (select a from hidden) or exists (with hidden as (select 1) select * from hidden)",
        "with hidden as (select * from hidden) select * from hidden",
        "with x as (select * from hidden), hidden as (select 1) select * from x",
        "table hidden",
        "from hidden select *",
        "insert into other select 1",
        "with x as (select 1) insert into other select * from x",
        "from things insert into other select a",
        "create table made as select 1",
        "drop view things",
        "cache table things",
        "set spark.sql.ansi.enabled = false",
        "set var x = 1",
        "declare x int = 1",
        "use default",
        "add jar 'x.jar'",
        "explain select * from hidden",
        "describe hidden",
        "show tables",
        "refresh table hidden",
        "select transform(a) using 'cat' as (x string) from things",
        "select * from things |> where a > 1",
        "select /*+ repartition(9999) */ * from things",
        "select :x",
        "select * from no_such_function(1)",
        "merge into other using things on other.a = things.a when matched then delete",
        "delete from other",
        "",
        " ",
    ],
)
def test_everything_else_is_refused(spark, store, text):
    with pytest.raises(ValueError):
        guarded_sql(spark, text.format(path=store))
    assert spark.catalog.tableExists("hidden") and not spark.catalog.tableExists("made")
