"""Parsed pages from a cache, trades, tool calls, results capped by rows."""

import re

import pytest
from pyspark.sql import functions as F

from tomeforge.documents import barter, wiki_docs
from tomeforge.operators import calls, reports
from tomeforge.sinks.tables import Store


def test_parse_cache(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    long = "A sentence that is long enough to be kept as a section of its own."
    frame = lambda *rows: spark.createDataFrame(list(rows), "title string, text string, stamp string")
    run = lambda *rows, **k: {r.title: (r.fresh, len(r.parts)) for r in wiki_docs.cached_pages(store, frame(*rows), **k).collect()}
    assert run(("A", long, "1"), ("B", "short", "1"), ("C", None, "1"), ("D", long, None)) == {"A": (True, 1), "B": (True, 0), "C": (True, 0), "D": (True, 1)}
    # unchanged ones are not read again, even if their text differs; those that went are forgotten
    assert run(("A", "not looked at", "1"), ("B", long, "2"), ("D", long, None)) == {"A": (False, 1), "B": (True, 1), "D": (True, 1)}
    assert run(("A", "", "1"), ("C", long, "1")) == {"A": (False, 1), "C": (True, 1)}
    assert run(("A", "", "1"), parser=wiki_docs.PARSER + 1) == {"A": (True, 0)}
    assert run() == {}
    docs = wiki_docs.as_documents(wiki_docs.cached_pages(store, frame(("A B", long, "1"))))
    assert [(r.id, r.text) for r in docs.collect()] == [("wiki_A B", long)]


def test_facts_become_sections(spark):
    text = "{{MOB infobox|type=Bird}}\n== Training ==\n{{NPC training row|ability=Deep {{pipe}} digging for a long time in many places|cost=9}}\n{|\n|-\n| {{Item|Cup|x}}<br> || '''5'''\n|}"
    out = {r.id: r.text for r in wiki_docs.page_documents(spark.createDataFrame([("P", text)], "title string, text string")).collect()}
    assert out == {"wiki_P_Training": "Teaches: Deep : digging for a long time in many places - cost 9", "wiki_P_table_0_coverage": "P table covers: Cup", "wiki_P_table_0_row_0": "P table row: Cup | 5"}


def brute_trades(items, offers, rows, covers):
    out = {}
    for key, name in items:
        groups, seen = [], set()
        for _, _, person in sorted((p, w, w) for k, p, w in offers if k == key):
            for table in sorted({r[1] for r in rows if r[0] == person}):
                if table in seen or not covers.get(table) or not name:
                    continue
                asked = [" | ".join(c[:-1]) for w, t, _, c in sorted(rows, key=lambda r: r[2]) if (w, t) == (person, table) and len(c) > 1 and re.search(r"\b" + re.escape(name.lower()) + r"\b", c[-1].lower())]
                if asked:
                    seen.add(table)
                    groups.append(f"Barter: {person} gives {name} in exchange for {', '.join(list(dict.fromkeys(asked))[:3])}.\nBarter options at {person}: {covers[table]}")
        if groups:
            out[key] = "\n".join(groups[:2])
    return out


def test_trades(spark):
    items = [("i1", "Royal Jelly"), ("i2", "Jelly"), ("i3", "Über-Tonic X"), ("i4", None), ("i5", "***"), ("i6", "Nothing")]
    offers = [("i1", 1, "Ida"), ("i1", 0, "Bo"), ("i2", 0, "Ida"), ("i3", 0, "Bo"), ("i3", 1, "Cy"), ("i4", 0, "Bo"), ("i5", 0, "Bo"), ("i6", 0, "Ida")]
    rows = [("Ida", "t1", i, c) for i, c in enumerate((["2 Sticks", "a royal jelly!"], ["2 Sticks", "Royal Jelly x3"], ["Wax", "Bowl", "Royal  Jelly"], ["Wax", "Bowl", "Royal Jelly"], ["Ore", "royal jelly"], ["Gem", "Royal Jelly"], ["Royal Jelly", "Jellyfish"], ["alone Royal Jelly"]))]
    rows += [("Bo", "t2", 0, ["Oil", "my Über-tonic X."]), ("Bo", "t3", 0, ["Oil", "Royal Jelly"]), ("Bo", "t4", 0, ["Tea", "Royal Jelly"]), ("Cy", "t5", 0, ["Tea", "über tonic x"]), ("Bo", "t6", 0, ["Salt", "Royal Jelly"])]
    covers = {"t1": "a, b", "t2": "c", "t3": "", "t4": "d", "t5": "e", "t6": "f"}
    frames = (spark.createDataFrame(items, "item_key string, name string"), spark.createDataFrame(offers, "item_key string, place int, person string"), spark.createDataFrame(rows, "person string, table_id string, row int, cells array<string>"), spark.createDataFrame(list(covers.items()), "table_id string, text string"))
    found = barter.trades(*frames)
    want = brute_trades(items, offers, rows, covers)
    assert {r.item_key: r.trades for r in found.collect()} == want and set(want) == {"i1", "i2", "i3"}
    docs = spark.createDataFrame([("d1", "i2", "\n How to get it"), ("d2", "i9", " x"), ("d3", None, None), ("d4", "i2", None)], "id string, item_key string, text string")
    assert {r.id: r.text for r in barter.with_trades(docs, found).collect()} == {"d1": want["i2"] + "\n\nHow to get it", "d2": " x", "d3": None, "d4": want["i2"] + "\n\n"}
    assert barter.trades(*(f.limit(0) for f in frames)).count() == 0


def test_sequences_are_made_once_for_each_text_of_a_cell(spark, monkeypatch):
    made = spark.sparkContext.accumulator(0)

    def runs(words, longest):
        made.add(1)
        return sorted({" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)})

    monkeypatch.setattr(barter, "sequences", lambda words, longest: F.udf(runs, "array<string>")(words, F.lit(longest)))
    rows = spark.range(400).selectExpr("concat('p', id % 40) as person", "concat('t', id % 40) as table_id", "id as row", "array(cast(id as string), 'and', if(id % 2 = 0, 'one red cup', 'one blue cup')) as cells")
    items = spark.createDataFrame([("i1", "Red Cup"), ("i2", "Blue Cup")], "item_key string, name string")
    offers = spark.range(80).selectExpr("if(id % 2 = 0, 'i1', 'i2') as item_key", "id % 40 as place", "concat('p', id % 40) as person")
    covers = spark.range(40).selectExpr("concat('t', id) as table_id", "'all' as text")
    found = {r.item_key: r.trades.splitlines()[0] for r in barter.trades(items, offers, rows, covers).collect()}
    assert found == {"i1": "Barter: p0 gives Red Cup in exchange for 0 | and, 40 | and, 80 | and.", "i2": "Barter: p1 gives Blue Cup in exchange for 1 | and, 41 | and, 81 | and."}
    assert 0 < made.value < 100  # not a time for each of the 400 rows


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ('a\n```tool\n{"name": "find", "args": {"query": "x  y", "k": 3, "o": {"a": [1]}}}\n```\nb', [("find", {"query": "x  y", "k": "3", "o": '{"a":[1]}'}, None)]),
        ("```tool \nno json\n```", [(None, None, "no json")]),
        ('```tool\n{"args": {}}```', [(None, None, '{"args": {}}')]),
        ('```tool\n{"name": ""}\n```', [(None, None, '{"name": ""}')]),
        ('```tool\n["name"]\n```', [(None, None, '["name"]')]),
        ('```tool\n{"name": "x"} tail\n```', [(None, None, '{"name": "x"} tail')]),
        ('```tool\n{"name": "x"}, {"name": "y"}\n```', [(None, None, '{"name": "x"}, {"name": "y"}')]),
        ('```tool\n{"name": "x"\n```', [(None, None, '{"name": "x"')]),
        ("```tool\n" + "z" * 300 + "\n```", [(None, None, "z" * 200)]),
        ('```json\n{"name": "x"}\n``` ```tool\nnever closed {"name": "x"}', []),
        ('<function=get.it><parameter=q> "a \\"b" </parameter><parameter=n>5</parameter><parameter=q>last\n one</parameter></function> <function=open>never', [("get.it", {"n": "5", "q": "last\n one"}, None)]),
        ("<function=a></function><function=b c></function>", [("a", {}, None)]),
        ('<function=f><parameter=s>"in quotes"</parameter></function>```tool\n{"name": "first"}\n```', [("first", None, None), ("f", {"s": "in quotes"}, None)]),
        (None, []),
        ("", []),
    ],
)
def test_tool_calls(spark, text, found):
    rows = calls.tool_calls(spark.createDataFrame([(1, text)], "id int, text string"), "id").orderBy("place").collect()
    assert [(r.name, r.args, r.raw) for r in rows] == found and [r.place for r in rows] == list(range(len(found)))


def test_previews(spark):
    rows = [({"sql": "select  1\n", "k": "2"},), ({"query": " ", "title": "T"},), ({"b": "2", "a": "1"},), ({"query": "x" * 300},), (None,), ({},)]
    out = [r[0] for r in spark.createDataFrame(rows, "args map<string,string>").select(calls.preview(F.col("args"))).collect()]
    assert out == ["select 1", "T", '{"a":"1","b":"2"}', "x" * 100, "", "{}"]


def test_middle_out(spark):
    lines = [f"row {i} " + "x" * (i % 7) for i in range(200)]
    kept = reports.middle_out(spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)] + [(2, 0, "short"), (2, 1, None)], "g int, i int, line string"), ["g"], ["i"], "line", 500).collect()
    one = sorted(r.i for r in kept if r.g == 1)
    assert sum(len(lines[i]) + 1 for i in one) <= 500 and {r.n_left_out for r in kept if r.g == 1} == {200 - len(one)}
    assert one == [i for i in range(200) if i in one] and one[0] == 0 and one[-1] == 199 and sorted(r.i for r in kept if r.g == 2) == [0, 1]
    text = reports.middle_out_text(["head"], lines, 565)  # the same room, the head and the note aside
    assert text.split("\n")[1:] == [lines[i] for i in one if i < 100] + [f"({200 - len(one)} rows in the middle are left out)"] + [lines[i] for i in one if i >= 100]
    assert reports.middle_out_text(["head"], lines[:3], 500) == "\n".join(["head", *lines[:3]])
