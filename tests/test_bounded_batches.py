"""What tasks hold at once is bounded: chunks and postings are given out in small pieces, and a price is looked for in one pass."""

import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tomeforge.functions import text as T
from tomeforge.functions import words as W
from tomeforge.operators import chunks


@pytest.fixture
def given_to_arrow(spark, monkeypatch):
    """The function that a DataFrame gives to mapInArrow, to be run here."""
    kept = []

    def keep(self, run, schema):
        kept.append(run)
        return self.sparkSession.createDataFrame([], schema)

    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", keep)
    return kept


def test_chunks_are_given_out_in_small_pieces(spark, given_to_arrow):
    text = "A sentence of some words. " * 800
    chunks.chunked(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text")
    n = 500
    batch = pa.RecordBatch.from_pydict({"id": [str(i) for i in range(n)], "kind": [""] * n, "text": [text] * n})
    out = list(given_to_arrow[0](iter([batch, batch.slice(0, 0)])))
    assert all(sum(map(len, b.column(4).to_pylist())) < 1.2 * (1 << 20) + len(text) for b in out)
    want = chunks.split(text)
    rows = [tuple(r.values()) for b in out for r in b.to_pylist()]
    assert rows == [(f"{i}_chunk_{k}", str(i), k, len(want), p) for i in range(n) for k, p in enumerate(want)]


def test_postings_are_given_out_in_small_pieces(spark, given_to_arrow):
    W.postings(spark.createDataFrame([(1, "x")], "id long, text string"), "id", "text", places=False)
    n, each = 150, 1500
    batch = pa.RecordBatch.from_pydict({"id": list(range(n)), "text": [" ".join(f"w{k}" for k in range(each))] * n})
    out = list(given_to_arrow[0](iter([batch])))
    assert max(b.num_rows for b in out) < 50_000 and sum(b.num_rows for b in out) == n * each
    rows = [(r["id"], r["term"], r["tf"], r["dl"]) for b in out for r in b.to_pylist()]
    assert rows == [(i, f"w{k}", 1, each) for i in range(n) for k in range(each)]


def test_a_price_is_found_in_one_pass(spark):
    found = {"5 gold": True, "5, . gold": True, "5.gold": True, "500each": True, "x5 gold": False, "5 golden": False, "@5": True, "@ , 5": True, "@ ,5": False, "@x5": False, "for 1,00": True, "for 99": False, "for 99.123": False, "12,345": True, "1.2345": False, "1234": False, "": False, "_5 c": False, "5 @ c": False}
    rows = [(t, w) for t, w in found.items()] + [(None, False), ("1234 ; " * 8000, False), ("1234 ; " * 8000 + "each", True)]
    began = time.time()
    got = spark.createDataFrame(rows, "t string, w boolean").select("t", "w", T.has_price(F.col("t")).alias("g")).collect()
    assert [(r.t or "")[:20] for r in got if r.g != r.w] == []
    assert time.time() - began < 20  # the text was split anew for each number
