"""Wiki pages as documents, on invented pages."""

from tomeforge.documents import wiki_docs


def frame(spark, rows):
    return spark.createDataFrame(rows, "title string, text string")


def test_sections_and_tables(spark):
    long = "This is a sentence that is long enough to be kept as a section of its own."
    text = f"Lead. {long}\n== Use of & for ==\n{long} <!-- hidden -->\n{{| class=x\n! Name !! Level\n|-\n| [[Cup|Tin Cup]] || 4\n|-\n| Pot || 5\nmore\n|}}\n== Use of & for ==\n{long}\n=== Short ===\nx"
    out = {r.id: r.text for r in wiki_docs.page_documents(frame(spark, [("My Page", text), ("Empty", None)])).collect()}
    assert out == {"wiki_My Page": f"Lead. {long}", "wiki_My Page_Use_of_and_for": long, "wiki_My Page_Use_of_and_for_2": long, "wiki_My_Page_table_0_coverage": "My Page table covers: Tin Cup, Pot", "wiki_My_Page_table_0_row_0": "My Page table row: Tin Cup | 4", "wiki_My_Page_table_0_row_1": "My Page table row: Pot | 5 more"}


def test_creatures(spark):
    text = "{{MOB infobox|\n| type = Insect\n| lootlevel = 3\n}}\nThe '''Moth''' is a [[Bug|small bug]].\n== X ==\n{{MOB Location\n| area = [[Hill (zone)|Hill]]\n}}{{MOB Location | area = Lake }}[[Category:Lake Creatures]][[Category:Marsh Creatures]]"
    out = wiki_docs.creatures(frame(spark, [("Big Moth", text), ("Rock", "no place")])).collect()
    assert [(r.id, r.text) for r in out] == [("creature_Big_Moth", "Creature Locations: Big Moth\nType: Insect\nLocations: Hill, Lake, Marsh\nDescription: The Moth is a small bug.\nBig Moth is an Insect creature. It can be found in Hill, Lake, Marsh.")]


def test_growing_and_topics(spark):
    table = "! Item !! Growing Time\n| {{Item|Blue Cap}} || 5 || 2h || dirt || dung || full || new\n| {{Item|Red Cap}} || || 1h || a || b || c || -"
    out = wiki_docs.growing(frame(spark, [("Mycology", table), ("Else", "x")])).collect()
    assert [r.text for r in out] == ["Mycology growing table (per item, wiki):\n- Blue Cap: Mycology level 5; grows in 2h; adequate substrate dirt; very well in dung; moon phases: robust in full, poor in new\n- Red Cap: Mycology level N/A; grows in 1h; adequate substrate a; very well in b; moon phases: robust in c"]
    files = spark.createDataFrame([(f"f{i}.txt", "Trains you at Level 3") for i in range(4)] + [("g.txt", "the level of the area")], "filename string, text string")
    found = wiki_docs.topics(files).collect()
    assert [(r.topic, r.n) for r in found] == [("skill_trainers", 4)] and found[0].text.startswith("==Skill Trainers==\nAuto-generated from 4 wiki sources.\n\nSource: f0.txt\nTrains you")
