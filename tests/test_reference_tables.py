import hashlib
import json

from pyspark.sql import functions as F

from tomeforge.operators import chat, sync
from tomeforge.sources import game_tables


def keyed(spark, records):
    rows = [(k, int(k.rsplit("_", 1)[-1]) if k.rsplit("_", 1)[-1].isdigit() else None, json.dumps(r)) for k, r in records.items()]
    return spark.createDataFrame(rows, "key string, id long, raw string")


def test_items_and_recipes(spark):
    items = keyed(spark, {"item_1": {"Name": "Cracked Urn", "InternalName": "UrnCracked", "Keywords": ["UrnKind", "Lint_X"], "Value": 10, "MaxStackSize": 10}, "item_2": {"Name": "Hoe", "SkillReqs": {"Gardening": 5}, "EffectDescs": ["a", "b"], "Value": 250.0}, "item_3": [1]})
    out = {r.code: r for r in game_tables.mapped("items", items).collect()}
    assert set(out) == {1, 2}
    assert (out[1].name, out[1].internal_name, out[1].keywords, out[1].value, out[1].stack) == ("Cracked Urn", "UrnCracked", "UrnKind", 10.0, 10)
    assert "Lint_X" in out[1].raw and out[2].skill_reqs == "Gardening 5" and out[2].effect_descs == "a | b" and out[2].value == 250.0
    recipes = keyed(spark, {"recipe_7": {"Name": "Tallow", "ResultItems": [{"ItemCode": 8123, "StackSize": 3}], "Keywords": ["WaxWork"], "Ingredients": [{"ItemCode": 1, "StackSize": 2}, {"ItemKeys": ["Resin", "Pine"], "Desc": "Any resin", "StackSize": 1}]}})
    r = game_tables.mapped("recipes", recipes).first()
    assert (r.result_items, r.keywords) == ("8123x3", "WaxWork")
    parts = [tuple(x) for x in game_tables.ingredients(recipes).orderBy("seq").collect()]
    assert parts == [(7, 0, 1, None, None, 2), (7, 1, None, "Resin | Pine", "Any resin", 1)]


def test_every_mapping_and_overflow(spark):
    one = keyed(spark, {"x_1": {"Name": "N", "XpAmounts": [10, 20, 30], "InternalName": "T"}, "x_2": {}})
    for name in game_tables.MAPPINGS:
        assert game_tables.mapped(name, one).count() == 2
    assert game_tables.mapped("areas", one).columns == ["id", "tbl", "raw"]
    levels = game_tables.xp_levels(game_tables.mapped("xptables", one)).orderBy("level").collect()
    assert [(x.level, x.xp_needed, x.cumulative_xp) for x in levels] == [(1, 10, 10), (2, 20, 30), (3, 30, 60)]
    skill = game_tables.mapped("skills", keyed(spark, {"Knotwork": {"Id": 3, "Combat": True}})).first()
    assert (skill.id, skill.name, skill.combat) == (3, "Knotwork", 1)
    s = game_tables.sources({"items": keyed(spark, {"item_1": {"entries": [{"type": "A"}, {"type": "B"}]}})})
    assert sorted((r.item_key, r.seq, r.source_table) for r in s.collect()) == [("item_1", 0, "items"), ("item_1", 1, "items")]


def test_entity_names(spark):
    items = game_tables.mapped("items", keyed(spark, {"item_1": {"Name": "Tallow", "InternalName": "TallowTub"}}))
    skills = game_tables.mapped("skills", keyed(spark, {"Joinery": {"Id": 1, "Description": "d"}}))
    out = sorted((r.name, r.type) for r in game_tables.entity_names({"items": items, "skills": skills}).collect())
    assert out == [("Joinery", "skill"), ("Tallow", "item"), ("TallowTub", "item")]


def test_chat_fold(spark):
    stamp = "26-06-11 08:00:0"
    lines = [
        ("a", f"{stamp}1\t[Trade] Ann: selling"), ("a", "ripe plums"), ("a", "[Item: Plum]"), ("a", ""),
        ("a", f"{stamp}2\t**** Entering Area: Harrowmere"), ("a", "[Item: Blue Lantern] [Recipe: Stew]"), ("a", "[Tonight's invasion]"),
        ("a", f"{stamp}3\t[Status] done: yes"), ("a", f"{stamp}4\tgarbage"), ("a", f"{stamp}5\t[Item: Egg] [Item: Ham]"),
        ("b", "no row yet"), ("b", f"{stamp}6\t[Global] Bo: "), ("b", "[ZK-8]"),
    ]
    number = {"a": 0, "b": 0}
    rows = []
    for f, value in lines:
        number[f] += 1
        rows.append((f, number[f], value))
    out = chat.folded(spark.createDataFrame(rows, "source_file string, line_no int, value string")).orderBy("source_file", "line_no").collect()
    assert [(r.source_file, r.line_no, r.channel, r.speaker, r.text) for r in out] == [
        ("a", 1, "Trade", "Ann", "selling ripe plums [Item: Plum]"),
        ("a", 5, "system", None, "**** Entering Area: Harrowmere"),
        ("a", 6, "item", None, "Blue Lantern; Stew"),
        ("a", 7, "system", None, "[Tonight's invasion]"),
        ("a", 8, "Status", None, "done: yes"),
        ("a", 10, "item", None, "Egg; Ham"),
        ("b", 2, "Global", "Bo", " [ZK-8]"),
    ]


def test_stable_names(spark):
    titles = ["Big Page", "a/b: c", "!!!", "con", "x" * 200, "Été"]
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    out = {r.t: r.n for r in df.select("t", sync.stable_name(F.col("t")).alias("n")).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()[:8]
    stems = ["Big_Page", "ab_c", "page", "con_", "x" * 150, "Été"]
    assert out == {t: f"{s}_{sha(t)}.txt" for t, s in zip(titles, stems, strict=True)}


def test_plans(spark):
    current = spark.createDataFrame([("same", "1", False), ("newer", "2", False), ("gone", "1", False), ("found", "1", False), ("held", None, True)], "title string, touched string, blocked boolean")
    known = spark.createDataFrame([("same", "1", "s.txt"), ("newer", "1", "n.txt"), ("gone", "1", "g.txt"), ("old", "1", "o.txt")], "title string, touched string, filename string")
    files = spark.createDataFrame([("same",), ("newer",), ("found",), ("held",)], "title string")
    assert dict(sync.page_plan(current, known, files).collect()) == {"same": "skip", "newer": "download", "gone": "download", "found": "adopt", "held": "blocked"}
    disk = spark.createDataFrame([("s.txt",), ("stray.txt",)], "filename string")
    assert dict(sync.purge_plan(current, known, disk).collect()) == {"o.txt": "stale", "stray.txt": "orphan"}


def test_refined_actions(spark):
    rows = [(1, "unknown", None, None, None, "Al paid 431 Councils to hire Bo for another 24 hours."), (2, "unknown", None, None, None, "Cy sent a note to shop owner"), (3, "unknown", None, None, None, "Al hid Clay Pot from shoppers"), (4, "unknown", None, None, None, 'Al set shop tag to "Hi"'), (5, "unknown", None, None, None, "else"), (6, "bought", "Di", "Gem", 5, "Al hid X from shoppers")]
    df = spark.createDataFrame(rows, "id int, action string, player string, item string, price_total int, raw_message string")
    out = {r.id: (r.action, r.player, r.item, r.price_total) for r in sync.refined_actions(df).collect()}
    assert out == {1: ("hire_stall", None, None, 431), 2: ("visitor_note", "Cy", None, None), 3: ("hid_item", None, "Clay Pot", None), 4: ("shop_tag", None, '"Hi"', None), 5: ("unknown", None, None, None), 6: ("bought", "Di", "Gem", 5)}
