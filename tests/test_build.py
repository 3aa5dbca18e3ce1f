"""Building a store and keeping it up to date, on invented sources."""

import json
import os

import pytest

from tomeforge import build
from tomeforge.operators import search
from tomeforge.sinks.tables import Store


@pytest.fixture
def sources(tmp_path):
    for name in ("tables", "wiki", "curated", "chat"):
        (tmp_path / name).mkdir()
    put = lambda name, text: (tmp_path / name).write_text(text)
    put("tables/items.json", json.dumps({"item_1": {"Name": "Clay Pot", "InternalName": "PotClay", "Value": 5, "Keywords": ["Pot"]}, "item_2": {"Name": "Café Cup", "InternalName": "Cup"}}))
    put("tables/npcs.json", json.dumps({"NPC_Ida": {"Name": "Ida", "Desc": "cooks"}}))
    put("tables/sources_items.json", json.dumps({"item_1": {"entries": [{"type": "Barter", "npc": "NPC_Ida"}]}}))
    put("wiki/Pine_Hut_0123abcd.txt", "A hut of pine wood that stands on the hill above the old town, {{Item|Clay Pot}}s within.")
    put("curated/old_tales_curated.txt", "Tales of the hut.")
    put("chat/Chat-20-01-01.log", "20-01-01 10:00:00\t[Trade] Cy: selling clay pot\n")
    return tmp_path


def refreshed(spark, top):
    return build.refresh(spark, str(top / "store"), **{k: str(top / k) for k in ("tables", "wiki", "curated", "chat")})


def touch(path, text):
    path.write_text(text)
    os.utime(path, (path.stat().st_atime, path.stat().st_mtime + 5))


def test_build_and_refresh(spark, sources, monkeypatch):
    store = Store(spark, str(sources / "store"))
    first = refreshed(spark, sources)
    assert set(first) == {s.name for s in build.steps({"tables": "x", "wiki": "x"})}
    docs = {r.id: r for r in store.read("documents").collect()}
    assert {"item_1", "item_2", "npc_NPC_Ida", "wiki_Pine Hut", "curated_old_tales_curated", "source_items_item_1"} <= set(docs)
    assert "Clay Pots within" in docs["wiki_Pine Hut"].text
    index = search.Index(spark, str(sources / "store" / "documents_index"), "id")
    assert {r.id for r in index.search("hut").collect()} == {"wiki_Pine Hut", "curated_old_tales_curated"} and "item_2" in {r.id for r in index.search("cafe").collect()}
    assert [(r.channel, r.speaker, r.text) for r in store.read("chat_events").collect()] == [("Trade", "Cy", "selling clay pot")]
    assert refreshed(spark, sources) == []

    # one page: its documents and what is made of them, and nothing else
    touch(sources / "wiki/Pine_Hut_0123abcd.txt", "The hut on the hill burnt down many years ago, and nobody has been there since then.")
    assert refreshed(spark, sources) == ["wiki_pages", "pages_parsed", "documents", "documents_indexed", "counts"]
    assert {r.id for r in index.search("burnt").collect()} == {"wiki_Pine Hut"} and len(index.manifest()["segments"]) == 2
    # a log
    touch(sources / "chat/Chat-20-01-02.log", "20-01-02 10:00:00\t[Help] Di: hello\n")
    assert refreshed(spark, sources) == ["chat"] and sorted(r.speaker for r in store.read("chat_events").collect()) == ["Cy", "Di"]

    # cut off in the middle: what is done stays done
    touch(sources / "tables/items.json", json.dumps({"item_2": {"Name": "Café Cup", "InternalName": "Cup", "Value": 9}}))

    def lost(b):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(build, "_documents", lost)
        with pytest.raises(RuntimeError):
            refreshed(spark, sources)
    assert [r.name for r in store.read("items").collect()] == ["Café Cup"] and "item_1" in {r.id for r in store.read("documents").collect()}
    assert set(refreshed(spark, sources)) == {"documents", "documents_indexed", "names_indexed", "counts"}
    assert "item_1" not in {r.id for r in index.documents().collect()}
    assert {r.tbl: r.n for r in store.read("counts").collect()}["items"] == 1


def test_without_sources(spark, tmp_path):
    ran = build.refresh(spark, str(tmp_path / "store"))
    store = Store(spark, str(tmp_path / "store"))
    assert len(ran) == len(build.steps({})) and store.read("documents").count() == 0 and store.read("chat_events").count() == 0


def test_a_step_cannot_need_itself(spark, tmp_path):
    loop = [build.Step("a", lambda b: None, ("b",)), build.Step("b", lambda b: None, ("a",))]
    with pytest.raises(ValueError, match="needs itself"):
        build.Build(spark, Store(spark, str(tmp_path))).run(loop)


def test_mirror(spark, tmp_path):
    import sqlite3

    c = sqlite3.connect(tmp_path / "a.db")
    c.executescript("create table log (id integer primary key, t text); create table state (k text, snapshot int); create table bag (k text);")
    c.executescript("insert into log (t) values ('a'), ('b'); insert into state values ('x', 1); insert into bag values ('p');")
    c.commit()
    store = Store(spark, str(tmp_path / "store"))
    run = lambda: build.mirror(spark, store, str(tmp_path / "a.db"), {"log": "id", "none": "id"}, {"state": "snapshot"}, ("bag",))
    assert run() == {"log": 2, "none": 0, "state": 1, "bag": 1} and run() == {"log": 0, "none": 0, "state": 0, "bag": 1}
    c.executescript("insert into log (t) values ('c'); insert into state values ('y', 2); delete from bag;")
    c.commit()
    assert run() == {"log": 1, "none": 0, "state": 2, "bag": 0} and sorted(r.t for r in store.read("log").collect()) == ["a", "b", "c"]
    c.executescript("alter table log add column more real;")
    c.commit()
    assert run()["log"] == 3 and store.read("log").columns == ["id", "t", "more"] and store.mark("log") == 3
    c.close()
