"""Computed documents on invented records."""

import json

from tomeforge.documents import computed


def keyed(spark, records):
    return spark.createDataFrame([(k, int(k.rsplit("_", 1)[-1]) if k.rsplit("_", 1)[-1].isdigit() else None, json.dumps(v)) for k, v in records.items()], "key string, id long, raw string")


def texts(df):
    return {r.id: r.text for r in df.collect()}


RECIPES = {"recipe_1": {"Name": "Mug", "Skill": "Clay", "SkillLevelReq": 3, "RewardSkillXp": 10, "RewardSkillXpFirstTime": 40, "RewardSkillXpDropOffLevel": 8, "RewardSkillXpDropOffPct": 0.25}, "recipe_2": {"Name": "Jar", "Skill": "Clay", "SkillLevelReq": 9}, "recipe_3": {"Name": "Pick Cap", "Skill": "Foraging", "RewardSkill": "Clay", "ItemMenuKeywordReq": "Mushroom2", "SkillLevelReq": 5}, "recipe_4": {"Name": "Land Trout", "Skill": "Fishing", "ItemMenuKeywordReq": "Trout", "SkillLevelReq": 7}}


def test_rankings(spark):
    assert texts(computed.recipe_rankings(keyed(spark, RECIPES)))["summary_clay"] == "Clay recipes ranked by skill level:\n1. Jar (9)\n2. Mug (3)"
    items = keyed(spark, {"item_1": {"Name": "Red Cap", "Keywords": ["Mushroom2"]}, "item_2": {"Name": "Big Trout", "Keywords": ["Trout", "Mushroom9"]}, "item_3": {"Name": "", "Keywords": ["Trout"]}})
    gathered = computed.gathering_rankings(items, keyed(spark, RECIPES))
    assert texts(gathered) == {"summary_gathering_mycology": "Mycology items ranked by required skill level:\n1. Red Cap (5)", "summary_gathering_fishing": "Fishing items ranked by required skill level:\n1. Big Trout (7)"}
    pages = spark.createDataFrame([("Mycology", "| {{Item|Red Cap}} || 5? || x\n| {{Item|Blue Cap}} || 12\n| {{Item|Odd}} || n/a"), ("Myconic", "| {{Item|Red Cap}} || 8"), ("Else", "| {{Item|No}} || 1")], "title string, text string")
    wiki = computed.harvest_rankings(pages)
    assert texts(wiki) == {"summary_wiki_mycology": "Mycology items ranked by required skill level (wiki):\n1. Blue Cap (12)\n2. Red Cap (8)"}
    assert sorted(r.id for r in computed.better_rankings(gathered, wiki).collect()) == ["summary_gathering_fishing", "summary_wiki_mycology"]
    assert sorted(tuple(r) for r in computed.harvest_levels(pages).collect()) == [("blue cap", "Mycology", 12), ("red cap", "Mycology", 8)]


def test_gifts_and_combat(spark):
    items = keyed(spark, {"item_1": {"Name": "Drum", "Keywords": ["SmallDrum", "Loot", "Lint_X", "A=1"]}, "item_2": {"Name": "Drum", "Keywords": ["Music"]}, "item_3": {"Name": "Bell"}})
    sources = keyed(spark, {"item_1": {"entries": [{"type": "NpcGift", "npc": "NPC_A"}, {"type": "Barter", "npc": "NPC_A"}]}, "item_3": {"entries": [{"type": "NpcGift", "npc": "NPC_A"}, {"type": "NpcGift", "npc": "NPC_None"}]}})
    out = computed.gift_lists(items, sources, keyed(spark, {"NPC_A": {"Name": "Old Ann"}}))
    assert texts(out) == {"summary_gifts_old_ann": "Old Ann accepts these items as gifts:\n- Bell\n- Drum\n  (type: Music)\n  (type: Small Drum)"}
    tables = keyed(spark, {"1_Wolf": {"InternalName": "Wolf", "Level_1": {computed.COMBAT_XP: 5.0}, "Level_2": {computed.COMBAT_XP: 7}}, "2_Bear": {"Level_1": {computed.COMBAT_XP: 9}, "Level_x": {}, "Level_3": {"O": 1}}})
    found = texts(computed.combat_xp(tables))
    assert list(found) == ["combatxp_1"] and found["combatxp_1"].endswith("highest first:\n\n- 2_Bear: 9\n- Wolf: 5")


def test_profile_and_leveling(spark):
    skills = keyed(spark, {"Clay": {"Name": "Clay Work", "Description": "d", "XpTable": "Slow", "Rewards": {"5": {"Recipe": "R"}}}, "Dig": {"Name": "Digging", "Rewards": {"10": {"BonusToSkill": "Clay"}, "20_x": {"BonusToSkill": "Clay"}}}})
    quests = keyed(spark, {"quest_1": {"Name": "Pots", "Rewards": [{"T": "SkillXp", "Skill": "Clay"}]}, "quest_2": {"Name": "Deep", "Objectives": [{"Requirements": [[{"T": "MinSkillLevel", "Skill": "Clay", "Level": 2}]]}]}, "quest_3": {"Name": "Out", "Keywords": ["Lint_NotObtainable"], "Rewards": [{"T": "SkillXp", "Skill": "Clay"}]}})
    npcs = keyed(spark, {"NPC_A": {"Name": "Ann", "AreaFriendlyName": "Hill", "Services": [{"Type": "Training", "Skills": ["Clay"]}, {"Type": "Training", "Skills": ["Clay", "Dig"]}]}})
    abilities = keyed(spark, {"ability_1": {"Name": "Knead", "Skill": "Clay", "Description": "Press", "PvE": {"PowerCost": 3}, "ResetTime": 2}})
    xp = keyed(spark, {"x1": {"InternalName": "Slow", "XpAmounts": [10, 20, 30, 40]}})
    levels = keyed(spark, {"7_Clay": {"Level_1": {"HP": 1}, "Level_2": {"HP": 1}, "Level_5": {"HP": 4}}})
    out = texts(computed.skill_profiles(skills, abilities, keyed(spark, RECIPES), quests, npcs, xp, levels))
    assert out["skillprofile_Clay"] == "Skill Profile: Clay Work\n\nInternal Key: Clay\n\nDescription:\nd\n\nType: Non-Combat\n\nRewards:\n- Level 5: Recipe = R\n\nAbilities (1):\n- Knead — Press. Power 3. Reuse 2s\n\nAdvancement:\n- Level 1-4: HP = 1\n- Level 5: HP = 4\n\nXP Table (Slow):\n- Level 1: 10 XP\n- Level 2: 20 XP\n- Level 3: 30 XP\n- Level 4: 40 XP\n\nRecipes:\n- Mug (level 3)\n- Pick Cap (level 5)\n- Jar (level 9)\n\nQuests:\n- Pots\n- Deep\n\nTrainers:\n- Ann (Hill)\n\nSynergy Levels (bonus levels received from other skills):\n- Digging: level 10, 20"
    guide = computed.leveling_guides(skills, keyed(spark, RECIPES), xp).collect()
    assert [g.id for g in guide] == ["leveling_Clay"]
    assert "Total: 100 cumulative XP to reach the highest shown level (9)." in guide[0].text and "- Mug [lvl 3]: +10 XP, first +40, drop after 8 (25%)" in guide[0].text
    assert "- Level 3: 30 XP (cumulative 60)" in guide[0].text and guide[0].facts["shown_recipe_count"] == "3"
    many = {f"recipe_{i}": {"Name": f"N{i:03d} " + "x" * 200, "Skill": "Clay", "SkillLevelReq": i} for i in range(80)}
    long = computed.leveling_guides(skills, keyed(spark, many), xp).collect()[0]
    assert len(long.text) <= computed.GUIDE and int(long.facts["shown_recipe_count"]) < 60 and "more recipes (from level" in long.text
