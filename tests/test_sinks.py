"""Tables whose data and mark come into force together, and what a lost change leaves behind."""

import duckdb
import pytest

from tomeforge import catalog
from tomeforge.sinks import tables
from tomeforge.sinks.versions import Versions


def rows(spark, *r):
    return spark.createDataFrame(list(r), "id int, name string")


def ids(store, name="t"):
    return sorted(r.id for r in store.read(name).collect())


def test_versions(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "v"))
    assert v.latest() == (-1, None)
    assert v.commit({"a": "é"}, -1) == 0 and v.commit({"a": 2}, 0) == 1 and v.latest() == (1, {"a": 2}) and v.read(0) == {"a": "é"}
    with pytest.raises(OSError):
        v.commit({"a": 3}, 0)
    assert v.latest() == (1, {"a": 2}) and len(v.names(str(tmp_path / "v"))) == len([p for p in (tmp_path / "v").iterdir() if p.suffix == ".json"])
    v.forget(1)
    assert v.numbers() == [1]


def test_a_lost_change_leaves_data_and_mark(spark, tmp_path, monkeypatch):
    store = tables.Store(spark, str(tmp_path))
    store.append_new("t", rows(spark, (1, "a"), (2, "b")))

    def lost(*_):
        raise RuntimeError("lost")

    for change in (lambda: store.append_new("t", rows(spark, (3, "c"))), lambda: store.replace("t", rows(spark, (9, "z"))), lambda: store.upsert("t", rows(spark, (1, "z")), ["id"])):
        with monkeypatch.context() as m:
            m.setattr(Versions, "commit", lost)  # after the data have been written
            with pytest.raises(RuntimeError):
                change()
        assert ids(store) == [1, 2] and store.mark("t") == 2
    assert store.append_new("t", rows(spark, (2, "b"), (3, "c"), (None, "d"))) == 1 and ids(store) == [1, 2, 3] and store.mark("t") == 3
    assert store.append_new("t", rows(spark)) == 0 and store.append_new("u", rows(spark)) == 0 and ids(store, "u") == []


def test_readers_keep_the_table_they_began_with(spark, tmp_path):
    store = tables.Store(spark, str(tmp_path))
    store.replace("t", rows(spark, (1, "a")))
    begun = store.read("t")
    store.replace("t", rows(spark, (2, "b")))
    assert [r.id for r in begun.collect()] == [1] and ids(store) == [2]
    store.replace("t", rows(spark, (3, "c")))
    assert len(Versions(spark, "x").names(f"{tmp_path}/t/parts")) == 2


def test_files_are_replaced_one_by_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "PARTS", 3)
    store = tables.Store(spark, str(tmp_path))
    frame = lambda *r: spark.createDataFrame(list(r), "source_file string, n int")
    want = {}
    for step in range(6):
        new = {f"f{(step * 2 + k) % 5}": step * 10 + k for k in range(2)}
        store.replace_files("chat", frame(*new.items()))
        want |= new
        assert dict((r.source_file, r.n) for r in store.read("chat").collect()) == want
        assert len(store.state("chat")["parts"]) <= 4


def test_another_writer_comes_first(spark, tmp_path, monkeypatch):
    a, b = tables.Store(spark, str(tmp_path)), tables.Store(spark, str(tmp_path))
    a.append_new("t", rows(spark, (1, "a")))
    with monkeypatch.context() as m:
        m.setattr(a, "_write", lambda *x, real=a._write: (b.append_new("t", rows(spark, (2, "b"))), real(*x))[1])
        with pytest.raises(OSError):
            a.append_new("t", rows(spark, (2, "b"), (3, "c")))
    assert ids(a) == [1, 2] and a.mark("t") == 2
    assert a.append_new("t", rows(spark, (2, "b"), (3, "c"))) == 1 and ids(a) == [1, 2, 3]


def test_an_order_of_key_zero_is_upserted_as_sql_has_it(spark, tmp_path):
    found = [(0, "O", 1.0), (1, "O", 2.0), (2, "F", 3.0), (3, "P", 4.0)]
    spark.createDataFrame(found, "o_orderkey long, o_orderstatus string, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    c = duckdb.connect()
    c.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    got = catalog.queries()["store_upsert"](spark, str(tmp_path)).select("o_orderkey", "o_orderstatus", "o_totalprice").collect()
    assert sorted(map(tuple, got)) == sorted(c.execute(catalog.oracle_sql()["store_upsert"]).fetchall()) == [(-1, "O", 2.0), (0, "O", 1.0), (0, "O", 1.0), (1, "O", 2.0), (2, "F", 0.0), (3, "P", 4.0)]
