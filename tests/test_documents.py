"""Builders on invented records, chunks, lookups and listings."""

import json

import pytest
from pyspark.sql import functions as F

from tomeforge.documents import builders
from tomeforge.operators import chunks, guard, lookup, reports


def keyed(spark, records):
    return spark.createDataFrame([(k, None, json.dumps(v)) for k, v in records.items()], "key string, id long, raw string")


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


ITEMS = {"item_7": {"Name": "Tin Cup", "InternalName": "TinCup", "Keywords": ["Cup", "Metal"], "Description": "Holds tea.", "MaxStackSize": 5, "Value": 12.0, "EquipSlot": "OffHand", "SkillReqs": {"Tea": 4, "Art": 2}, "EffectDescs": ["{HEAT}{3}", "Shines.", "{COLD}{-2}"], "BestowRecipes": [3, 99]}}


def test_item(spark):
    r = one(builders.items(keyed(spark, ITEMS), keyed(spark, {"HEAT": {"Label": "Heat Taken"}}), keyed(spark, {"recipe_3": {"Name": "Brew"}}), spark.createDataFrame([("tin cup", "Mining", 9)], "key string, skill string, level int")))
    assert r.text == "Item: Tin Cup\n\nInternal Name:\nTinCup\n\nKeywords:\nCup, Metal\n\nUsage:\nHolds tea.\n\nDescription:\nHolds tea.\n\nStack Size:\n5\n\nValue:\n12\n\n\nSlot: OffHand\nRequires Art skill level 2\nRequires Tea skill level 4\nStat: Heat Taken +3\nShines.\nStat: COLD -2\nBestows Recipe: Brew\nBestows Recipe: Unknown Recipe (99)\n\nGather Requirement:\nRequires Mining skill level 9 to gather"
    assert (r.id, r.name, r.facts["value"], r.facts["skill_reqs"], r.facts["keywords"]) == ("item_7", "Tin Cup", "12", "Art 2 | Tea 4", "Cup | Metal")


def test_recipe(spark):
    raw = {"recipe_1": {"Name": "Tea", "Skill": "Brewing", "SkillLevelReq": 3, "Description": "Hot.", "Ingredients": [{"ItemCode": 7, "StackSize": 2}, {"ItemKeys": ["Leaf", "Herb"], "Desc": "Any leaf"}, {"ItemKeys": ["Water"]}, {}], "ResultItems": [{"ItemCode": 8, "StackSize": 1}], "RewardSkill": "Cooking", "RewardSkillXp": 5, "RewardSkillXpFirstTime": 20, "RewardSkillXpDropOffPct": 0.1, "RewardSkillXpDropOffLevel": 9}}
    r = one(builders.recipes(keyed(spark, raw), keyed(spark, ITEMS)))
    assert r.text == "Recipe: Tea\n\nSkill:\nBrewing\n\nRequired Skill Level:\n3\n\nDescription:\nHot.\n\nIngredients:\n- Tin Cup x2\n- Any leaf (category: Leaf, Herb) x1\n- Any item matching: Water x1\n- Unknown ingredient\n\nProduces:\n- Unknown Item (8) x1\nItem codes (ingredients: 7; results: 8).\n\n\nRewards:\nAwards Cooking XP: +5, first-time +20\nReward Skill: Cooking\nXP Drop-off: -10%, after level 9"
    assert r.facts["ingredients"] == "Tin Cup | Any leaf | Water | Unknown ingredient" and r.facts["reward_skill"] == "Cooking"


def test_skill_quest_ability_npc(spark):
    s = one(builders.skills(keyed(spark, {"Tea": {"Description": "d", "Rewards": {"10_Bonus": {"Recipe": "A"}, "2": {"Title": "B"}}, "AdvancementHints": {"5": "drink"}, "Parents": ["Art"], "AuxCombat": True, "MaxBonusLevels": 25}})))
    assert s.text == "Skill: Tea\n\nDescription:\nd\n\nRewards:\n- Level 2: Title = B\n- Level 10 (Bonus): Recipe = A\n\nAdvancement Hints:\n- Level 5: drink\n\nParents:\nArt\n\nType: Auxiliary Combat\nMax Bonus Levels: 25"
    q = one(builders.quests(keyed(spark, {"quest_1": {"Name": "Q", "Description": "d", "DisplayedLocation": "Hill", "Objectives": [{"Type": "Kill", "Description": "rats", "Number": 3}], "Requirements": ["Be kind", {"T": "MinSkillLevel", "Skill": "Tea", "Level": 2}, [{"T": "QuestCompleted", "Quest": "Z"}, {"T": "Odd"}]], "Rewards": [{"T": "SkillXp", "Xp": 9, "Skill": "Tea"}, {"T": "Currency", "Currency": "HillRenown", "Amount": 4}], "Rewards_Items": [{"Item": "Cup"}]}, "quest_2": {"Keywords": ["Lint_NotObtainable"]}})))
    assert q.text == "Quest: Q\n\nDescription:\nd\n\nLocation: Hill\n\nObjectives:\n- Kill: rats (x3, target: )\n\nRequirements:\n- Be kind\n- Skill Tea >= 2\n- Completed quest: Z\n\nRewards:\n- +9 Tea XP\n- +4 Hill Renown\n- Item: Cup x1"
    assert q.facts == {"reward_skills": "Tea", "location": "Hill"}
    a = one(builders.abilities(keyed(spark, {"ability_1": {"Name": "Jab", "Skill": "Tea", "Level": 3, "PvE": {"Damage": 7}, "Keywords": ["Fast"]}, "ability_2": {"Keywords": ["Lint_MonsterAbility"]}})))
    assert a.text == "Ability: Jab\n\nDescription:\n\n\nSkill: Tea\nDamage Type: \nTarget: \nLevel: 3\nReset Time: 0s\n\nPvE: Damage=7, PowerCost=0, RageCost=0, Range=0\n\nKeywords: Fast"
    n = one(builders.npcs(keyed(spark, {"NPC_Ida": {"Name": "Ida", "Desc": "d", "AreaFriendlyName": "Hill", "Services": [{"Type": "Store", "Favor": "Friends"}, {"Type": "Training", "Skills": ["Tea", "Art"]}], "Preferences": [{"Desire": "Love", "Name": "Cups"}, {"Desire": "Hate"}]}})))
    assert n.text == "NPC: Ida\n\nDescription:\nd\n\nLocation: Hill\n\nServices:\n- Store (Favor: Friends)\n- Training - Skills: Tea, Art\n\nGift preferences:\n- Love: Cups"


def test_smaller_builders(spark):
    b = builders
    assert b.effects(keyed(spark, {"e1": {"Name": "E", "Desc": "d", "Keywords": ["K"]}, "e2": {"Name": "F"}})).select("text").collect() == [("Effect: E\n\nDescription:\nd\n\nKeywords: K",)]
    assert one(b.lorebooks(keyed(spark, {"b": {"Title": "T", "Text": "''Old'' <b>tale</b>", "Category": "C"}}))).text == "Lore Book: T\n\nCategory: C\nLocation: \n\nContent:\nOld tale"
    assert one(b.goals(keyed(spark, {"0": {"Id": 4, "Label": "L", "Zone": "Z", "LargeHint": "h"}}))).id == "goal_4"
    assert one(b.areas(keyed(spark, {"A": {"FriendlyName": "Hill"}}))).text == "Area: Hill\n\nShort Name: \nInternal ID: A"
    assert one(b.item_uses(keyed(spark, {"item_7": {"RecipesThatUseItem": [1, 2]}, "item_8": {"RecipesThatUseItem": []}}), keyed(spark, ITEMS))).text == "Item Usage: Tin Cup\n\nUsed in 2 recipes:\nRecipe IDs: 1, 2"
    marks = spark.createDataFrame([("A", None, json.dumps([{"Name": "M", "Type": "Well", "Loc": "x:1", "Desc": "d"}, 5, {"Name": "N"}]))], "key string, id long, raw string")
    assert sorted(r.id for r in b.landmarks(marks).collect()) == ["landmark_A_M_0", "landmark_A_N_2"]
    assert one(b.titles(keyed(spark, {"t": {"Title": "Sir"}}))).text == "Player Title: Sir"
    assert one(b.vaults(keyed(spark, {"v": {"Area": "A", "NumSlots": 3, "HasAssociatedNpc": True}}))).text == "Storage Vault: Vault v\n\nArea: A\nSlots: 3\nHas Associated NPC: True"
    assert one(b.advancement(keyed(spark, {"a": {"InternalName": "I", "Level_1": {"MAX": 4}, "X": 2}}))).text == "Advancement Table: I\n\n- Level_1:\n  MAX: 4\n- X: 2"
    assert one(b.behaviours(keyed(spark, {"Wolf": {"Comment": "c", "Abilities": {"Bite": {"minLevel": 2}, "Bad": 1}}}))).text.endswith("Abilities:\n- Bite (levels 2-max)")
    assert one(b.attributes(keyed(spark, {"HEAT": {"Label": "Heat", "DefaultValue": 1}}))).text == "Attribute: Heat\n\nInternal Name: HEAT\nDefault Value: 1\nDisplay Rule: \nDisplay Type:"
    s = one(b.source_entries(keyed(spark, {"item_7": {"entries": [{"type": "NpcGift", "npc": "NPC_Ida"}, {"type": "Barter", "npc": "NPC_Raim"}, {"Type": "Skill", "Skill": "Tea"}]}, "item_9": {"entries": []}}), "items", keyed(spark, ITEMS), keyed(spark, {"NPC_Ida": {"Name": "Ida"}})))
    assert (s.id, s.name, s.text) == ("source_items_item_7", "Tin Cup Sources", "Source: Tin Cup\n\nFound in sources_items:\n- Gifted to Ida\n- Barter from Raim\n- Skill (Tea skill)")
    assert one(b.treasures(keyed(spark, {"p": {"InternalName": "P", "Slots": ["Head", "None"], "Tiers": {"id_1": {"MinLevel": 1, "MinRarity": "Rare", "EffectDescs": ["a", "b"]}}}}))).text == "Treasure Item: P\n\nSkill: \nSuffix: \nSlots: Head\n\nTiers:\n- id_1: Level 1-?, Rare: a, b"
    assert one(b.xp_tables(keyed(spark, {"x": {"InternalName": "None", "XpAmounts": [5, 9]}, "y": {}}))).text == "XP Table: x\n\nXP required per level:\nLevel 1: 5 XP\nLevel 2: 9 XP"
    k = b.ability_keywords(keyed(spark, {"0": {"MustHaveAbilityKeywords": ["b", "a"]}, "1": {"MustHaveAbilityKeywords": ["a", "b"], "AttributesThatDeltaCritChance": ["z"]}})).collect()
    assert sorted(len(r.id) for r in k) == [22, 24] and {r.name for r in k} == {"Keyword Combo: a,b"}
    every = b.assembled([b.titles(keyed(spark, {"t": {"Title": "Sir"}})), b.areas(keyed(spark, {"A": {}})).withColumn("name", F.lit(None).cast("string"))])
    assert sorted(r.name for r in every.collect()) == ["A", "Sir"]


def test_chunks_by_characters():
    para = "One two three. Four five six! Seven"
    assert chunks.by_characters("short", 10) == ["short"]
    assert chunks.by_characters("aaa\n\nbbb\n\nccc", 10) == ["aaa\n\nbbb", "ccc"]
    assert chunks.by_characters(para, 20) == ["One two three.", "Four five six! Seven"]
    assert chunks.by_characters("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5]
    assert "".join(chunks.by_characters("word " * 500, 100)).replace(" ", "") == "word" * 500
    with pytest.raises(ValueError):
        chunks.by_characters("x", 0)


def test_chunks_by_tokens():
    count = chunks.words_and_marks
    text = "\n\n".join(" ".join(f"w{i}" for i in range(n)) for n in (3, 4, 30, 2))
    parts = chunks.by_tokens(text, 10, count)
    assert all(count(p) <= 10 for p in parts) and " ".join(parts).split() == text.split()
    assert chunks.by_tokens("a b", 10, count) == ["a b"]


def test_chunk_overlap_and_lineage(spark):
    assert chunks.overlapping(["alpha beta", "gamma"], 8) == ["alpha beta", "beta gamma"]
    assert chunks.overlapping(["ab", "c"]) == ["ab", "ab c"]
    df = spark.createDataFrame([("a", "item", "short"), ("b", "item", "word " * 400), ("c", "lorebook", "tale " * 300), ("d", None, None)], "id string, type string, text string")
    out = chunks.chunked(df, "id", "text", "type").collect()
    assert {r.id for r in out if r.parent_id is None} == {"a", "d"}
    for p, limit in (("b", 1024), ("c", 1000)):
        own = sorted((r for r in out if r.parent_id == p), key=lambda r: r.chunk_index)
        assert len(own) == own[0].chunk_count > 1 and all(len(r.text) <= limit + 101 for r in own) and own[0].id == f"{p}_chunk_0"


def test_guard_refuses_whatever_is_no_view(spark):
    spark.range(5).createOrReplaceTempView("seen")
    good = ("select 'java_method' as x from seen", "with a as (select * from seen) select (select max(id) from a) from a", "select * from seen, explode(array(1, 2))", "select id from seen where id in (select id from seen)")
    for q in good:
        assert guard.guarded_sql(spark, q).count() > 0
    bad = ("select * from `com.databricks.spark.csv`.`/tmp/x.csv`", "select * from seen where id in (select value from text.`/etc/hosts`)", "select (select count(*) from parquet.`/tmp/x`)", "with a as (select * from json.`/tmp/x`) select 1 from seen", "select reflect('java.lang.System', 'getenv') from seen", "select * from seen union select * from nowhere", "select * from default.seen", "cache table seen", "select try_reflect('java.lang.System', 'getenv')")
    for q in bad:
        with pytest.raises(ValueError):
            guard.guarded_sql(spark, q)


def test_lookups(spark):
    df = spark.createDataFrame([(1, "Oak Bow"), (2, "oak"), (3, "Oaks Bow Long"), (4, None)], "id int, name string")
    assert [r.id for r in lookup.exact_else_like(df, "name", "OAK").collect()] == [2]
    assert sorted(r.id for r in lookup.exact_else_like(df, "name", "bows").collect()) == [1, 3]
    assert one(lookup.shortest_match(df, "name", "bow")).id == 1
    assert sorted(r.id for r in lookup.prefix_family(df, "name", ("Oak", "Oaks"), "long").collect()) == [3]
    assert df.filter(lookup.none_of(F.col("name"), ("oak",))).count() == 2
    tree = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 10)], "parent int, child int")
    assert sorted(tuple(r) for r in lookup.closure(tree, spark.createDataFrame([(1,)], "node int"), 2).collect()) == [(1, 0), (2, 1), (3, 2)]


def test_markdown(spark):
    df = spark.createDataFrame([(1.0, "a|b"), (2.5, None)], "x double, y string")
    assert reports.markdown_table(df) == "2 rows.\n| x | y |\n| --- | --- |\n| 1 | a\\|b |\n| 2.5 |  |"
    assert reports.markdown_table(df, 1).endswith("…[truncated at 1 rows]") and reports.markdown_table(df.limit(0)).startswith("0 rows.")
