"""The tools on an invented store."""

import json

import pytest
from pyspark.sql import functions as F

from tomeforge.engine import Engine, capped
from tomeforge.functions import wiki
from tomeforge.operators import search


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("index"))
    docs = spark.createDataFrame([("d1", None, "Pine Soup", "curated", "Soup of pine. Pines grow on hills."), ("d2", None, "Clay Pot", "items", "A pot for soup."), ("d2_chunk_0", "d2", "Clay Pot", "items", "pot one"), ("d2_chunk_1", "d2", "Clay Pot", "items", "pot two"), ("d3", None, None, "npcs", "Nobody cooks.")], "id string, parent_id string, name string, tbl string, text string")
    names = spark.createDataFrame([(1, "Pine Soup", "recipe", "needs pine"), (2, "Pine Cone", "item", "falls from pines"), (3, "Ida the Cook", "npc", "knows pine soup")], "id int, name string, type string, snippet string")
    sheet = {"Report": "CharacterSheet", "ServerName": "S", "Skills": {"Tea Art": {"Level": 12, "BonusLevels": 2, "Abilities": ["Stir", "Odd"]}, "Dig": {"Level": 40}, "Unknown": {"Abilities": ["Wave"]}}, "Currencies": {"GOLD": 5, "GEMS": 0}, "ActiveQuests": ["a", "b"], "CompletedQuests": [f"q{i}" for i in range(45)], "NPCs": {"Ida": {"FavorLevel": "Friends"}, "Bo": {"FavorLevel": "Neutral"}}}
    tables = {
        "documents": docs,
        "entity_names": names,
        "wiki_pages": spark.createDataFrame([("Pine Soup", "'''Pine''' {{Quote|x|tasty}} [[Tree|trees]]\n== Use ==\nEat."), ("Pine Cone", "c"), ("Pine Hut", "h")], "title string, text string"),
        "char_reports": spark.createDataFrame([("Al", "2020-01-02", json.dumps(sheet)), ("Al", "2020-01-09", json.dumps({"Report": "Storage"}))], "character string, ts string, report string"),
        "player_items": spark.createDataFrame([("Al", 1, "Clay Pot", "Rare", "Chest", 2, 5.0, "{}", "2020-01-03")], "character string, type_id int, name string, rarity string, storage string, stack int, value double, report string, ts string"),
        "abilities": spark.createDataFrame([("Stir", "Stir Well", "Tea Art", 1), ("Pour", "Pour", "tea art", 9), ("Dig1", "Dig", "Dig", 1)], "internal_name string, name string, skill string, level int"),
        "items": spark.createDataFrame([("ClayPot", "Clay Pot", 12.0, 1), ("ClayPotBig", "Big Clay Pot", 30.0, 2), ("Frock", "Frock", 5.0, 3), ("FrockRecipe", "Tailoring: Frock", 700.0, 4), ("FrockRecipe2", "Tailoring: Fine Frock", 900.0, 5)], "internal_name string, name string, value double, code int"),
        "sources": spark.createDataFrame([("item_1", 0, '{"type": "Barter", "npc": "NPC_Ida"}'), ("item_1", 1, '{"type": "Quest", "questId": 7}'), ("item_1", 2, '{"recipeId": 99}'), ("item_1", 3, '{"itemTypeId": 5}'), ("item_2", 0, '{"npc": "x"}')], "item_key string, seq int, entries string"),
        "npcs": spark.createDataFrame([("NPC_Ida", "Ida the Cook")], "key string, name string"),
        "stall_price_observations": spark.createDataFrame([("2020-01-08", "Clay Pot", 1, 11.0, "Corner", "Bo", "ocr", "chipped"), ("2020-01-09", "Clay Pot", 2, 0.0, None, None, None, None)], "observed_at string, item_name string, quantity int, price_unit double, stall_label string, owner_name string, source string, notes string"),
        "quests": spark.createDataFrame([(7, "Pots Wanted", json.dumps([{"Type": "Collect", "ItemName": "ClayPot", "Number": 4}]), json.dumps([{"T": "WorkOrderCurrency", "Amount": 2000}, {"T": "SkillXp", "Skill": "Dig", "Xp": 50}]))], "id int, name string, objectives string, rewards string"),
        "stall_events": spark.createDataFrame([(1, "Al", "Clay Pot", "2020-01-01 10:00", "2020-01-01 10:00", "added", None, 5, None, None, 0), (2, "Al", "Clay Pot", "2020-01-01 11:00", "2020-01-01 11:00", "visible", None, 5, 9.0, None, 0), (3, "Al", "Clay Pot", "2020-01-02 10:00", "2020-01-02 10:00", "bought", "Di", 2, 9.0, 18.0, 0), (4, "Al", "Rope", "2020-01-02 10:00", "2020-01-02 10:00", "added", None, 1, None, None, 0)], "id int, owner string, item string, event_at string, event_timestamp string, action string, player string, quantity int, price_unit double, price_total double, ignored int"),
        "chat_events": spark.createDataFrame([("20-01-01", "Trade", "Cy", "selling clay pot 500 each"), ("20-01-02", "Trade", "Di", "who wants a clay pot?"), ("20-01-03", "Combat", "Di", "clay pot 500g")], "ts string, channel string, speaker string, text string"),
    }
    corpus = search.Index(spark, f"{root}/corpus", "id").build(docs, "text", "name")
    entities = search.Index(spark, f"{root}/names", "id").build(names, "name", "snippet")
    return Engine(spark, tables, corpus, entities, as_of="2020-02-01")


def test_search_tools(engine):
    out = engine.call("corpus_search", query="what is the pine soup?", k=2)
    assert out.startswith("2 results:\n- d1 | Pine Soup (curated) | Soup of pine.")
    assert "items" not in engine.call("corpus_search", corpus="tool", query="soup pot")
    assert engine.call("corpus_search", query="xyzzy") == "0 results."
    assert engine.call("corpus_get_doc", id="d2_chunk_1") == "3 part(s):\n## d2\nA pot for soup.\n---\n## d2_chunk_0\npot one\n---\n## d2_chunk_1\npot two"
    assert engine.call("find_entities", query="pine soup").startswith("2 results:")
    assert engine.call("find_entities", query="pine", type="item") == "1 results:\n- item — Pine Cone — falls from pines"
    assert engine.call("find_entities", query='"the cook"').endswith("Ida the Cook — knows pine soup")
    assert engine.call("get_page", title="pine soup") == "# Pine Soup\nPine tasty trees\n\n## Use\nEat."
    assert engine.call("get_page", title="pine") == "Ambiguous: 'pine' matches 3 pages. Call get_page again with one of: Pine Hut, Pine Cone, Pine Soup"
    assert engine.call("get_page", title="oak") == "No wiki page matching 'oak'." and "missing required argument" in engine.call("get_page")


def test_sql_and_errors(engine):
    assert engine.call("sql_query", sql="select name, value from items where code < 3 order by value") == "2 rows.\n| name | value |\n| --- | --- |\n| Clay Pot | 12 |\n| Big Clay Pot | 30 |"
    long = engine.call("sql_query", sql="select i.id, repeat('x', 150) t from range(150) i").split("\n")
    assert len("\n".join(long)) <= 12_000 and all(x.startswith("|") for x in long[1:3]) and any("rows in the middle are left out" in x for x in long) and long[-1].startswith("| 149 |")
    assert "error" in engine.call("sql_query", sql="drop view items") and "SQL error" in engine.call("sql_query", sql="selec 1")
    assert engine.call("nothing").startswith("Unknown tool: nothing")
    assert len(capped("line\n" * 5000)) < 12_100


def test_player_sections(engine):
    ask = lambda section, **a: engine.call("player_state", section=section, **a)
    assert ask("summary").splitlines() == ["Al, as of 2020-01-02", "Highest skills (3): Dig 40+0, Tea Art 12+2, Unknown ?+0", "Currencies (1): gold: 5", "2 active quests", "45 completed quests", "Server: S"]
    assert ask("skills").splitlines()[1].startswith("Skills (3): Dig 40+0") and ask("currencies").endswith("Currencies (1): gold: 5")
    assert ask("quests").splitlines()[1] == "Active quests (2): a, b" and ask("quests").splitlines()[2].startswith("Completed quests (45, the first 40): q0, ")
    assert ask("favor").splitlines()[1] == "Persons who are not neutral (1): Ida (Friends)"
    assert ask("items", query="pot").startswith("Things of Al, as of 2020-01-03\n| type_id") and ask("items", query="zz") == "Al has nothing like 'zz'."
    assert ask("abilities", skill="Tea Art").splitlines()[1:] == ["Learnt (1): Stir Well", "To be learnt, by level (1):", "- 9: Pour [Pour]", "On the sheet, but not in the tables (1): Odd", "Learnt, of no skill (1): Wave"]
    assert "no abilities of a skill" in ask("abilities", skill="Cup") and "can't be told" in ask("abilities", skill="Dig")
    assert "unknown section" in ask("shoes")


def test_stall(engine):
    ask = lambda section, **a: engine.call("player_state", section=section, **a)
    assert ask("stall", query="clay pots").splitlines() == [
        "Value in the tables (1) - what a vendor pays at least, not a price that anyone asked for:",
        "- Clay Pot: 12",
        "Work orders (1):",
        "- 4 x Clay Pot pays 2,000 (500 a piece) and 50 Dig experience: Pots Wanted (quest 7)",
        "Prices below are of this stall's own listings and sales; they are no sample of the market.",
        "Sold, oldest first (1) - each is a sale of its own:",
        "- 2020-01-02 10:00: 2 x Clay Pot for 9 each, 18 in all, to Di",
        "Asked for, oldest first (1) - may not have been sold:",
        "- 2020-01-01 11:00: 5 x Clay Pot for 9 each (visible)",
        "Seen at other stalls, newest first (2):",
        "- 2020-01-09: 2 x Clay Pot, without a price yet",
        "- 2020-01-08: 1 x Clay Pot, 11 each, at Corner, of Bo, by ocr, chipped",
        "Where it comes from (3):",
        "- Barter: Ida the Cook",
        "- Quest: Pots Wanted",
        "- source: 99",
    ]
    chat = ask("stall", query="clay pot").splitlines()
    assert "- 20-01-01 Trade Cy: selling clay pot 500 each" in chat and not any("who wants" in x or "500g" in x for x in chat)
    # things without any price: the recipe of that name is what is traded, and all of a family are listed
    assert ask("stall", query="Frock").splitlines() == ["Value in the tables (1) - what a vendor pays at least, not a price that anyone asked for:", "- Tailoring: Frock: 700", "Recipes of that name (2):", "- Tailoring: Fine Frock: 900", "- Tailoring: Frock: 700", "The stall has no history of 'Frock'.", "Where it comes from: not known either"]
    assert ask("stall", query="Rope").splitlines() == ["The stall has no prices of 'Rope'.", "Where it comes from: not known either"]
    assert ask("stall").splitlines()[1].startswith("Sold, oldest first (1)")
    assert ask("stall_inventory").splitlines() == ["Listed now (1):", "- Clay Pot: 3 in all, 3 for 9 each", "Without a price (1):", "- Rope: 1 (added, never priced)"]
    assert ask("stall_inventory", query="moon") == "The stall never held anything like 'moon'."


def test_index_refresh(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta"), (3, "gamma")], "id int, text string")
    index = search.Index(spark, str(tmp_path / "i"), "id").build(docs, "text")
    index.refresh(spark.createDataFrame([(2, "alpha"), (4, "alpha")], "id int, text string"), spark.createDataFrame([(1,)], "id int"))
    assert sorted(r.id for r in index.search("alpha").collect()) == [2, 4] and index.search("beta").count() == 0


def test_index_and_direct_search_agree(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    index = search.Index(spark, str(tmp_path / "i"), "doc_id").build(docs, "text")
    own = [(r.doc_id, round(r.score, 6)) for r in index.search("what is the edan and thion").collect()]
    assert own == [(r.doc_id, round(r.score, 6)) for r in search.ranked(docs, "doc_id", "text", "what is the edan and thion").collect()]


def test_markup(spark):
    assert wiki.plain("{{MOB|loc = hill|level = 3|{{Item|Cup}}}}") == "loc: hill\nlevel: 3\nCup"
    assert wiki.plain("a [[File:x.png]]b [[c]] [[d|e]] <br>f") == "a b c e f"
    assert wiki.plain("|name = x\n__TOC__\n{| t |}") == "x\n\n t "
    assert wiki.plain("x {{never closed") == "x " and wiki.plain("Learn {{msg:BASEPAGENAME}}", "Tea") == "Learn Tea"
    df = spark.createDataFrame([("plain", "t"), ("''b''", "t"), (None, "t")], "x string, t string")
    assert [r[0] for r in df.select(wiki.plain_text(F.col("x"), F.col("t"))).collect()] == ["plain", "b", None]
