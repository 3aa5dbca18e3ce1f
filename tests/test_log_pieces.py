"""Logs that are read and folded in pieces give what whole files give."""

import random

from tomeforge.operators import chat
from tomeforge.sources import files


def test_pieces_equal_whole_files(spark, tmp_path):
    rng = random.Random(3)
    shapes = ["20-01-01 10:00:00\t[Trade] Cy: hello {}", "more {}", "[Item: A{}]", "20-01-01 10:00:00\t[Error] oh {}", "", "20-01-01 10:00:00\tnothing", "[the bell {}]", "[Item: B{}] [Recipe: C]", "20-01-01 10:00:00\t[Status] got [Item: X{}]"]
    for name, n, end in (("Chat-1.log", 700, "\r\n"), ("Chat-2.log", 400, "\n"), ("Chat-3.log", 0, ""), ("Chat-4.log", 1, ""), ("other.log", 5, "\n")):
        (tmp_path / name).write_bytes(end.join([rng.choice(shapes).format(i) for i in range(n)] + [""] * (n > 1)).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
        pieces = files.log_pieces(spark, str(tmp_path))
        got = sorted(map(tuple, pieces.select("source_file", "line_no", "value").collect()))
        assert pieces.select("source_file", "piece").distinct().count() > 15
        folded = sorted(map(tuple, chat.folded(pieces, piece="piece").collect()), key=str)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    whole = files.log_lines(spark, str(tmp_path))
    assert got == sorted((r.source_file, r.line_no, r.value) for r in whole.collect() if not (r.source_file == "Chat-3.log" and r.value == ""))
    assert folded == sorted(map(tuple, chat.folded(whole).collect()), key=str) and len(folded) > 300
    assert files.log_pieces(spark, str(tmp_path / "none")).count() == 0
