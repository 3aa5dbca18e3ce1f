import pytest
from pyspark.sql import functions as F

from tomeforge.functions import text as T
from tomeforge.operators import chunks, guard, ledger, search
from tomeforge.sinks import tables
from tomeforge.sources import files
from tomeforge.streaming import incremental


@pytest.mark.parametrize(
    ("events", "start", "tiers"),
    [
        ([("bought", 1, None)], (4, 100), [[3, 100]]),
        ([("bought", 2, None)], (2, 50), []),
        ([("removed", 3, None)], (3, None), []),
        ([("added", 5, None)], None, [[5, None]]),
        ([("added", 4, None), ("visible", 4, 200), ("bought", 1, 200)], None, [[3, 200]]),
        ([("visible", 4, 200)], None, [[4, 200]]),
        ([("visible", 4, None)], None, [[4, None]]),
        ([("added", 2, None), ("visible", 2, 150), ("visible", 2, None)], None, [[2, 150]]),
        ([("added", 1, None), ("visible", 1, 9), ("hid_item", 0, None)], None, []),
    ],
)
def test_replay(events, start, tiers):
    assert ledger.replay(events, start) == tiers


def test_inventory(spark):
    rows = [("o", "i", "2020-01-01", 1, "added", 4, None), ("o", "i", "2020-01-02", 2, "visible", 4, 200.0), ("o", "i", "2020-01-02", 3, "bought", 1, 200.0)]
    df = spark.createDataFrame(rows, "owner string, item string, event_at string, id int, action string, quantity int, price_unit double")
    assert [tuple(r) for r in ledger.inventory(df).collect()] == [("o", "i", 200.0, 3, 1, "listed")]


def test_normalised_and_missing(spark):
    df = spark.createDataFrame([("Curses don't wear off", [["dont wear"], ["x", "OFF!"], ["gone"]])], "a string, f array<array<string>>")
    r = df.select(T.normalised(F.col("a")), T.missing_facts(F.col("a"), F.col("f"))).first()
    assert r[0] == "curses dont wear off" and r[1] == [["gone"]]


def test_query_terms():
    assert search.query_terms("what does the butter recipe need") == ["butter", "recipe", "need"]
    assert search.query_terms("what is the") == ["what", "is", "the"]


def test_guard(spark):
    spark.range(500).createOrReplaceTempView("numbers")
    assert guard.guarded_sql(spark, "with a as (select id from numbers) select * from a").count() == 201
    for bad in ("drop view numbers", "insert into numbers values (1)", "create table t as select 1", "select java_method('java.lang.Math','abs',1)", "select * from parquet.`/tmp`", "", "set a=1"):
        with pytest.raises(ValueError):
            guard.guarded_sql(spark, bad)


def test_reassembled(spark):
    df = spark.createDataFrame([("d", None), ("d_chunk_10", "d"), ("d_chunk_2", "d"), ("e", None)], "id string, parent_id string")
    for wanted in ("d", "d_chunk_2"):
        assert [r.id for r in search.reassembled(df, wanted).collect()] == ["d", "d_chunk_2", "d_chunk_10"]


def test_chunks():
    out = chunks.split("a b " * 600)
    assert len(out) > 2 and all(len(x) <= chunks.BUDGET + chunks.OVERLAP + 1 for x in out)
    assert chunks.split("") == [""]


def test_sources(spark, tmp_path):
    (tmp_path / "items.json").write_text('{"item_1": {"Name": "Bottle"}, "item_x": {}}')
    assert sorted((r.key, r.id) for r in files.json_table(spark, str(tmp_path / "items.json")).collect()) == [("item_1", 1), ("item_x", None)]
    (tmp_path / "Big_Page_0123abcd.txt").write_text("x")
    (tmp_path / "plain.txt").write_text("y")
    assert [r.title for r in files.wiki_pages(spark, str(tmp_path)).collect()] == ["Big Page"]
    (tmp_path / "Chat-1.log").write_text("one\n\ntwo\n")
    assert sorted(tuple(r) for r in files.log_lines(spark, str(tmp_path)).collect()) == [("Chat-1.log", 1, "one"), ("Chat-1.log", 2, ""), ("Chat-1.log", 3, "two")]
    (tmp_path / "goals.json").write_text('[{"Id": 4}, {"Id": 5}]')
    (tmp_path / "Marks.json").write_text('{"A": [{"Name": "x"}]}')
    assert sorted((r.tbl, r.key, r.raw) for r in files.json_tables(spark, str(tmp_path)).collect() if r.tbl != "items") == [("goals", "0", '{"Id":4}'), ("goals", "1", '{"Id":5}'), ("marks", "A", '[{"Name":"x"}]')]
    assert files.json_table(spark, str(tmp_path / "none.json")).count() == 0 and files.json_tables(spark, str(tmp_path / "nowhere")).count() == 0
    (tmp_path / "Other_0123abce.txt").write_text("z")
    (tmp_path / "map.json").write_text('{"pages": {"Big Page": {"filename": "Other_0123abce.txt"}}}')
    pages = files.wiki_pages(spark, str(tmp_path), files.title_map(spark, str(tmp_path / "map.json")))
    assert sorted((r.filename, r.title) for r in pages.collect()) == [("Big_Page_0123abcd.txt", "Big Page"), ("Other_0123abce.txt", "Big Page_2")]
    (tmp_path / "old_tales_curated.txt").write_text("t")
    assert [tuple(r) for r in files.curated(spark, str(tmp_path)).collect()] == [("curated_old_tales_curated", "curated", "curated", "Old Tales", "t")]


def test_sqlite(spark, tmp_path):
    import sqlite3

    with sqlite3.connect(tmp_path / "a.db") as c:
        c.execute("create table t (id integer, name text, price real)")
        c.executemany("insert into t values (?, ?, ?)", [(1, "x", 2.5), (2, None, None)])
    assert files.sqlite_tables(str(tmp_path / "a.db")) == {"t": [("id", "INTEGER"), ("name", "TEXT"), ("price", "REAL")]}
    assert sorted(tuple(r) for r in files.sqlite_table(spark, str(tmp_path / "a.db"), "t").collect()) == [(1, "x", 2.5), (2, None, None)]
    with pytest.raises(ValueError, match="no table"):
        files.sqlite_table(spark, str(tmp_path / "a.db"), "u")


def test_sqlite_in_ranges_with_a_journal(spark, tmp_path):
    import sqlite3

    c = sqlite3.connect(tmp_path / "b.db")
    c.execute("pragma journal_mode = wal")
    c.execute("create table t (a int, b blob, c text)")
    c.execute("create table w (k text primary key, v real) without rowid")
    c.execute("create table e (x int)")
    c.executemany("insert into t values (?, ?, ?)", [(i, bytes([i % 256]), f"é{i}") for i in range(1000)])
    c.execute("delete from t where a % 7 = 0")
    c.executemany("insert into w values (?, ?)", [("p", 1.5), ("q", None)])
    c.commit()  # still open, so the rows are in the journal
    found = files.sqlite_table(spark, str(tmp_path / "b.db"), "t", rows=90)
    assert found.rdd.getNumPartitions() == 12 and sorted((r.a, bytes(r.b), r.c) for r in found.collect()) == [(i, bytes([i % 256]), f"é{i}") for i in range(1000) if i % 7]
    assert sorted(tuple(r) for r in files.sqlite_table(spark, str(tmp_path / "b.db"), "w").collect()) == [("p", 1.5), ("q", None)]
    assert files.sqlite_table(spark, str(tmp_path / "b.db"), "e").count() == 0
    c.close()


def test_store(spark, tmp_path):
    store = tables.Store(spark, str(tmp_path / "store"))
    rows = lambda *r: spark.createDataFrame(list(r), "id int, name string")
    store.upsert("t", rows((1, "a"), (2, "b")), ["id"])
    store.upsert("t", rows((2, "c"), (3, "d")), ["id"])
    assert sorted(tuple(r) for r in store.read("t").collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert store.append_new("log", rows((1, "a"), (5, "b"))) == 2 and store.append_new("log", rows((5, "b"), (6, "c"))) == 1
    assert store.append_new("log", rows((6, "c"))) == 0 and store.mark("log") == 6 and store.read("log").count() == 3
    assert store.copy_if_newer("whole", rows((1, "a")), 7) == 1 and store.copy_if_newer("whole", rows((1, "a"), (2, "b")), 7) == 0
    assert store.copy_if_newer("whole", rows((1, "a"), (2, "b")), 8) == 2
    store.replace_files("chat", spark.createDataFrame([("f", 1), ("g", 2)], "source_file string, n int"))
    store.replace_files("chat", spark.createDataFrame([("g", 3), ("g", 4)], "source_file string, n int"))
    assert sorted((r.source_file, r.n) for r in store.read("chat").collect()) == [("f", 1), ("g", 3), ("g", 4)]
    assert not store.converge("log", store.read("log")) and store.converge("log", rows((1, "a")).withColumn("more", F.lit(1)))
    assert store.read("log").count() == 0 and store.mark("log") is None
    before = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "source_file string, stamp string")
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "source_file string, stamp string")
    assert dict(tables.changed_files(now, before).collect()) == {"b": "modified", "c": "deleted", "d": "new"}


def test_replay_keeps_what_was_sold_before_it_came():
    sold_first = [("bought", 5, None), ("visible", 3, 7.0), ("added", 4, None)]
    assert ledger.replay(sold_first) == [[4, None]]
    stock = ledger.Stock()
    for e in (("added", 4, None), ("visible", 2, 9.0), ("visible", 2, 8.0), ("bought", 3, 8.0)):
        stock.apply(*e)
    assert stock.final() == [(9.0, 1)] and stock.status() == "listed"
    bare = ledger.Stock()
    for e in (("added", 4, None), ("bought", 1, 6.0)):
        bare.apply(*e)
    assert bare.final() == [(6.0, 3)]


def test_inventory_from_a_count(spark):
    events = [("o", "i", "2020-01-01 10:00", 1, "added", 9, None), ("o", "i", "2020-02-01 10:00", 2, "bought", 1, 5.0), ("o", "j", "2020-02-01 10:00", 3, "added", 2, None), ("o", "k", "2019-01-01 10:00", 4, "visible", 2, 3.0), ("o", "l", "2020-02-01", 5, "unknown", 2, 3.0), ("o", "m", "2020-01-30", 6, "visible", 1, None)]
    counts = [("o", "i", 4, 5.0, "2020-01-15 00:00"), ("o", "i", 7, 5.0, "2020-01-10 00:00"), ("o", "i", -1, 5.0, "2020-03-10 00:00"), ("o", "n", 2, None, "2020-01-10 00:00"), ("o", "n", 2, None, "short")]
    ev = spark.createDataFrame(events, "owner string, item string, event_at string, id int, action string, quantity int, price_unit double")
    base = spark.createDataFrame(counts, "owner string, item string, quantity int, price_unit double, recorded_at string")
    out = sorted((r.item, r.price, r.quantity, r.status) for r in ledger.inventory(ev, base, as_of="2020-02-10").collect())
    assert out == [("i", 5.0, 3, "listed"), ("j", None, 2, "added, never priced"), ("m", None, 1, "snapshot has no price"), ("n", None, 2, "snapshot has no price")]


def test_incremental(spark, tmp_path):
    new, mark = incremental.above_mark(spark.range(5), "id", 2)
    assert mark == 4 and new.count() == 2
    src, out, ck = (str(tmp_path / x) for x in ("s", "o", "c"))
    spark.range(3).write.parquet(src)
    for _ in range(2):
        incremental.append_new_files(spark, src, spark.range(1).schema, out, ck)
    assert spark.read.parquet(out).count() == 3


def test_whole_tables_are_registered(spark):
    from tomeforge import catalog

    d = "/root/testdata/sf0.001"
    own = catalog.queries()
    lines, names = spark.read.parquet(f"{d}/lineitem.parquet"), spark.read.parquet(f"{d}/supplier.parquet")
    met = lines.join(names, (lines.l_suppkey == names.s_suppkey) | (lines.l_partkey == names.s_suppkey)).select("s_name").distinct()
    assert own["either_key_join"](spark, d).select("s_name").distinct().count() == met.count()
    words = spark.read.parquet(f"{d}/documents.parquet").filter("lower(text) rlike '[a-z0-9]'")
    assert own["postings"](spark, d).select("doc_id").distinct().count() == words.select("doc_id").distinct().count()
