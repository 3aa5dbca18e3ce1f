"""The written index: what it finds, how it changes, and what a lost change leaves behind."""

import random

import pytest

from tomeforge.functions import words as W
from tomeforge.operators import matching, search

SCHEMA = "id int, name string, text string"


def test_words():
    assert W.words("Café, CAFÉ! Über_größe 12½ straße Ångström Ελληνικά ЁЖ") == ["cafe", "cafe", "uber", "große", "12½", "straße", "angstrom", "ελληνικα", "еж"]
    assert W.words(None) == W.words("") == W.words(" -_- ") == []
    assert search.query_terms("what is the Café?") == ["cafe"]


def test_postings_hold_places(spark):
    docs = spark.createDataFrame([(1, "b a b", None), (2, None, ""), (3, "A", "b")], "id long, x string, y string")
    assert sorted((r.id, r.term, r.field, r.tf, r.dl, r.places) for r in W.postings(docs, "id", "x", "y").collect()) == [(1, "a", 0, 1, 3, [1]), (1, "b", 0, 2, 3, [0, 2]), (3, "a", 0, 1, 2, [0]), (3, "b", 1, 1, 2, [0])]
    assert [r._words for r in W.sized(docs, "x", "y").orderBy("id").collect()] == [3, 0, 2]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = [(1, "Café", "the old café by the sea"), (2, "Cafe two", "über the hills"), (3, None, "sea old the"), (4, "Sea", None), (5, "", "the hills are old and the sea is near"), (6, "a b", "b c")]
    return search.Index(spark, str(tmp_path_factory.mktemp("i")), "id").build(spark.createDataFrame(rows, SCHEMA), "name", "text")


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("Café", {1, 2}),
        ("cafe", {1, 2}),
        ("ÜBER", {2}),
        ("uber", {2}),
        ('"the sea"', {1, 5}),
        ("the + sea", {1, 5}),
        ('"old the"', {3}),
        ("sea old", {1, 3, 5}),
        ("sea AND old NOT hills", {1, 3}),
        ("hills OR sea NOT old", {2, 4, 5}),
        ("(hills OR sea) NOT old", {2, 4}),
        ("hil*", {2, 5}),
        ('"the hil" *', {2, 5}),
        ("name: cafe", {1, 2}),
        ("- name: cafe", {1}),
        ("{name text}: sea NOT name: sea", {1, 3, 5}),
        ("name: (a OR sea)", {4, 6}),
        ("^ sea", {3, 4}),
        ("text: ^ the", {1, 5}),
        ("NEAR(hills sea, 4)", {5}),
        ("NEAR(hills sea, 3)", set()),
        ("NEAR(sea hills, 4)", {5}),
        ('NEAR("the old" sea)', {1}),
        ("NEAR(old the sea, 1)", {3}),
        ("NEAR(a c)", set()),  # in two columns
        ('"b b"', set()),
        ("near AND sea", {5}),
        ("xyzzy", set()),
        ("the (sea", {1, 5}),  # no expression, so a phrase
        ("the: sea", {1, 5}),  # no such column, so a phrase
        ("old AND", {5}),
        ("sea; old", {3}),
        ("sea-old", {3}),
    ],
)
def test_expressions(index, text, found):
    assert {r.id for r in index.scores(index.expression(text)).collect()} == found


@pytest.mark.parametrize("text", ["(", "a)", "AND", "a OR", "NOT a", "a NEAR(", "NEAR()", "NEAR(a, b)", "{name", "nome: a", "-name", "a ;", '"a', "a +", "* a"])
def test_what_is_no_expression(text):
    with pytest.raises(matching.BadExpression):
        matching.expression(text, ("name",))


def score_rows(index, question="sea hills old"):
    return [(r.id, round(r.score, 9)) for r in index.search(question, 20).collect()]


def test_changes_equal_a_full_rebuild(spark, tmp_path):
    """Any order of changes gives the scores of an index built at once; segments that no change touches stay as they are."""
    rng = random.Random(1)
    text = lambda: " ".join(rng.choice(["sea", "hills", "old", "x", "y"]) for _ in range(rng.randint(0, 8)))
    live = {i: text() for i in range(10)}
    frame = lambda d: spark.createDataFrame([(i, None, t) for i, t in d.items()], SCHEMA)
    index = search.Index(spark, str(tmp_path / "a"), "id").build(frame(live), "text", "name")
    for step in range(6):
        before = index.manifest()
        changed = {rng.randrange(10 + 3 * step): text() for _ in range(3)}
        gone = [i for i in rng.sample(sorted(live), 2) if i not in changed]
        index.refresh(frame(changed), spark.createDataFrame([(i,) for i in gone], "id int"))
        live = {i: t for i, t in {**live, **changed}.items() if i not in gone}
        after = index.manifest()
        assert after["n"] == len(live) and after["words"] == sum(len(t.split()) for t in live.values())
        assert len(set(after["segments"]) - set(before["segments"])) == 1
    assert len(index.manifest()["segments"]) < 6
    whole = search.Index(spark, str(tmp_path / "b"), "id").build(frame(live), "text", "name")
    assert score_rows(index) == score_rows(whole) and sorted(r.id for r in index.documents().collect()) == sorted(live)
    assert index.vacuum() > 0 and score_rows(index) == score_rows(whole) and index.vacuum() == 0


@pytest.mark.parametrize("fails", ["dead", "segment", "commit", "rename"])
def test_a_lost_change_leaves_the_old_index(spark, tmp_path, monkeypatch, fails):
    frame = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    index = search.Index(spark, str(tmp_path), "id").build(frame((1, None, "sea"), (2, None, "old")), "text")
    before = score_rows(index)

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        if fails == "rename":
            m.setattr(index, "_write", lambda *a, real=index._write: (search.Index(spark, str(tmp_path), "id").refresh(frame((9, None, "x"))), real(*a))[1])  # another change comes first
        else:
            m.setattr(*{"dead": (search.W, "sized"), "segment": (index, "_write"), "commit": (index, "_commit")}[fails], lost)
        with pytest.raises((RuntimeError, OSError)):
            index.refresh(frame((1, None, "hills"), (3, None, "sea")))
    if fails == "rename":
        assert index.manifest()["n"] == 3
        index.refresh(frame(), spark.createDataFrame([(9,)], "id int"))
    assert score_rows(index) == before
    index.vacuum()
    assert score_rows(index) == before
    index.refresh(frame((1, None, "hills"), (3, None, "sea")))
    assert [i for i, _ in score_rows(index, "sea")] == [3]


def test_empty_index(spark, tmp_path):
    index = search.Index(spark, str(tmp_path), "id").build(spark.createDataFrame([], SCHEMA), "text")
    assert index.search("sea").count() == 0 and search.ranked(spark.createDataFrame([], SCHEMA), "id", "text", "sea").count() == 0
    index.refresh(spark.createDataFrame([(1, None, "Sea")], SCHEMA))
    assert [r.id for r in index.search("sea").collect()] == [1]
