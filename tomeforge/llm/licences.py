"""Licence notices in texts: a trained classifier of every word window, confirmed by comparison with templates.

Windows run over the whole text, line breaks or not; each template has windows of near its own length that overlap by more than it.
Physical lines are windows too. Training is on the templates below (whole and among other words) and on ordinary paragraphs,
a set that is fixed and does not grow. The classifier is a softmax regression on sparse word 1- and
2-grams (those of the training) with a class of its own for what is no notice, calibrated on notices among words held out from training. Scoring is DataFrame operations only.
"""

from __future__ import annotations

import math
import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomeforge.llm.common import Workspace

#: Notices in use for each family: sentences of its licence text and of the notices that name it, and its SPDX identifiers.
TEMPLATES = {
    "apache": (
        "licensed under the apache license version 2.0",
        "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
        "spdx license identifier apache 2.0",
    ),
    "mit": (
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability",
        "spdx license identifier mit",
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation",
        "licensed under the bsd license",
        "released under the 3 clause bsd license",
        "spdx license identifier bsd 3 clause",
        "spdx license identifier bsd 2 clause",
    ),
    "gpl": (
        "this work is licensed under the gnu general public license version 3",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "you should have received a copy of the gnu general public license along with this program",
        "spdx license identifier gpl 3.0",
        "spdx license identifier gpl 2.0 only",
        "spdx license identifier gpl 3.0 or later",
        "distributed under the gpl v3",
    ),
    "lgpl": (
        "licensed under the gnu lesser general public license version 2.1",
        "under the terms of the gnu lesser general public license as published by the free software foundation",
        "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
        "you should have received a copy of the gnu lesser general public license along with this library",
        "spdx license identifier lgpl 2.1",
        "spdx license identifier lgpl 3.0 or later",
    ),
    "agpl": (
        "licensed under the gnu affero general public license version 3",
        "under the terms of the gnu affero general public license as published by the free software foundation",
        "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
        "you should have received a copy of the gnu affero general public license along with this program",
        "spdx license identifier agpl 3.0",
        "spdx license identifier agpl 3.0 or later",
    ),
    "mpl": ("this source code form is subject to the terms of the mozilla public license v 2.0", "licensed under the mozilla public license version 2.0", "spdx license identifier mpl 2.0"),
    "epl": ("this program and the accompanying materials are made available under the terms of the eclipse public license v 2.0", "licensed under the eclipse public license version 2.0", "spdx license identifier epl 2.0"),
    "eupl": ("licensed under the eupl version 1.2", "licensed under the eupl version 1.2 or as soon they will be approved by the european commission subsequent versions of the eupl", "spdx license identifier eupl 1.2"),
    "isc": (
        "released under the isc license",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        "provided that the above copyright notice and this permission notice appear in all copies",
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
        "spdx license identifier isc",
    ),
    "cc-by": ("licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license", "spdx license identifier cc by 4.0"),
    "cc-by-sa": ("licensed under cc by sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license", "spdx license identifier cc by sa 4.0"),
    "cc-by-nc": ("licensed under cc by nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license", "spdx license identifier cc by nc 4.0"),
    "cc0": ("released under cc0 1.0", "released under cc0 1.0 universal public domain dedication", "to the extent possible under law the author has waived all copyright and related rights to this work", "spdx license identifier cc0 1.0"),
    "unlicense": ("this is free and unencumbered software released into the public domain", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary", "spdx license identifier unlicense"),
}
#: Notices of each family in other words; training never has them, and the temperature and the unknown class are set on them.
VARIANTS = {
    "apache": ("this project is available under the terms of the apache license version 2.0", "apache license version 2.0 applies to all files"),
    "mit": ("this project is licensed under the terms of the mit license", "copies are permitted under the mit license"),
    "bsd": ("this library is licensed under the 3 clause bsd license", "use is governed by a bsd license"),
    "gpl": ("this program is released under the gnu general public license version 2", "available under the terms of the gnu general public license"),
    "lgpl": ("this library is released under the gnu lesser general public license version 3", "available under the terms of the gnu lesser general public license"),
    "agpl": ("this server is released under the gnu affero general public license version 3", "available under the terms of the gnu affero general public license"),
    "mpl": ("this module is made available under the mozilla public license version 2.0", "subject to the mozilla public license"),
    "epl": ("this plugin is released under the eclipse public license version 2.0", "available under the terms of the eclipse public license"),
    "eupl": ("this tool is licensed under the eupl version 1.1", "available under the eupl"),
    "isc": ("this package is licensed under the isc license", "available under the terms of the isc license"),
    "cc-by": ("the text is available under a creative commons attribution 4.0 license", "photos are licensed under cc by 4.0 by their authors"),
    "cc-by-sa": ("the text is available under a creative commons attribution sharealike 4.0 license", "photos are licensed under cc by sa 4.0 by their authors"),
    "cc-by-nc": ("the text is available under a creative commons attribution noncommercial 4.0 license", "photos are licensed under cc by nc 4.0 by their authors"),
    "cc0": ("the data are dedicated to the public domain under cc0 1.0 universal", "waived all copyright under cc0 1.0"),
    "unlicense": ("this library is released into the public domain under the unlicense", "free and unencumbered software"),
}
#: Paragraphs with one of these words that are no notice.
OTHER = ("all rights reserved", "a driving license is required for this job", "she lost her driver license in the city", "the warranty covers parts and labour for two years", "no part of this book may be copied without permission", "copyright law protects authors of books and music", "ask for permission before you enter the building", "the license fee of the public broadcaster rose again", "his fishing licence was valid until may", "the software was released in spring and sold well", "the public library is free for any person", "the mit campus lies in cambridge", "an apache helicopter landed near the source of the river", "a general said the foundation had published the terms", "redistribution of wealth was debated", "the gnu is a large antelope", "this work is hard and the conditions are met rarely", "subject to the law of the land", "permission denied", "licensed premises close at ten", "the court granted a copy of the documents", "copyright")
#: Words that stand around the notices and in the ordinary windows on which the classifier is calibrated; training has none of them but for common ones.
HELD = "the of and a to in is for on or with as was at it river morning table seven garden window music teacher winter market letter paper road under this work by version software public any person copy house history small great number between often year during country family story light public water"
#: Words of a window; the next one begins a third of it later.
WINDOWS = (8, 12, 18, 28, 42)
UNKNOWN = "unknown"
#: Known words of a partition in which windows are judged: some 5 windows each, of 0.2 KB.
FOUND = 131_072


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def grams_of(words: list[str], sizes=(1, 2)) -> set[str]:
    return {" ".join(words[i : i + n]) for n in sizes for i in range(len(words) - n + 1)}


def window_of(n: int) -> int:
    """Words of the windows for a template of n words: some window holds it whole, with two words to spare."""
    return next(w for w in WINDOWS if w - w // 3 + 1 >= n + 2)


def gate_words(weights: dict[str, list[float]], alike: float) -> list[str]:
    """Words of which every text has one that holds `alike` of the 2-grams of any template; common words last."""
    out: set[str] = set()
    for c, ts in enumerate(TEMPLATES.values()):
        for t in ts:
            pairs = grams_of(words_of(t), (2,))
            left = sorted(set(words_of(t)), key=lambda w: (w not in out, len(w) < 2 or w in HELD.split(), weights[w][-1] - weights[w][c], w))
            while sum(not out & set(p.split()) for p in pairs) >= math.ceil(alike * len(pairs) - 1e-9):
                out.add(left.pop(0))
    return sorted(out)


def gate_pairs(weights: dict[str, list[float]], alike: float) -> list[str]:
    """2-grams of which every text has one that holds `alike` of the 2-grams of any template: of each template one more than may be missing."""
    out: set[str] = set()
    for c, ts in enumerate(TEMPLATES.values()):
        for t in ts:
            pairs = grams_of(words_of(t), (2,))
            missing = len(pairs) - math.ceil(alike * len(pairs) - 1e-9)
            out.update(sorted(pairs, key=lambda p: (weights[p][-1] - weights[p][c], p))[: missing + 1])
    return sorted(out)


def calibrated(classes: tuple[str, ...], weights: dict[str, list[float]], bias: list[float]) -> tuple[float, float]:
    """(temperature, shift of the unknown class) of the least log loss on windows of notices in words that training doesn't have, on the
    first third of templates, which is no notice, and on ordinary words."""
    rng, held, z, y = random.Random(11), HELD.split(), [], []
    noise = lambda n: [rng.choice(held) for _ in range(n)]
    for c, family in enumerate(TEMPLATES):
        for t in VARIANTS[family]:
            w = words_of(t)
            for more in (0, window_of(len(w)) - len(w), 10, 20):
                at = rng.randint(0, more)
                z.append(noise(at) + w + noise(more - at))
                y.append(c)
        for t in TEMPLATES[family]:
            w = words_of(t)
            z += [noise(window_of(len(w)) - len(w) // 3) + w[: len(w) // 3], noise(window_of(len(w)))]
            y += [len(classes) - 1] * 2
    known = [[weights[g] for g in grams_of(w) if g in weights] for w in z]
    logits = np.array([np.array(bias) + (np.sum(k, 0) / math.sqrt(len(k)) if k else 0) for k in known])

    def loss(temperature: float, shift: float) -> float:
        v = logits / temperature
        v[:, -1] += shift
        v -= v.max(1, keepdims=True)
        return float((np.log(np.exp(v).sum(1)) - v[np.arange(len(y)), y]).mean())

    return min(((t, u) for t in np.geomspace(0.1, 4, 30).tolist() for u in np.linspace(-4, 4, 33).tolist()), key=lambda x: loss(*x))


@lru_cache(maxsize=1)
def trained(rounds: int = 60, rate: float = 1.5, decay: float = 1e-4) -> tuple[tuple[str, ...], dict[str, list[float]], list[float]]:
    """(classes, weights of each gram, biases) by gradient descent on the fixed examples, calibrated."""
    rng = random.Random(7)
    classes = (*TEMPLATES, UNKNOWN)
    examples: list[tuple[set[str], int]] = []
    filler = words_of(" ".join(OTHER))
    for c, family in enumerate(TEMPLATES):
        for t in TEMPLATES[family]:
            w = words_of(t)
            examples += [(grams_of(w), c)] * 3
            for _ in range(4):  # in a sentence
                examples.append((grams_of(rng.sample(filler, 4) + w + rng.sample(filler, 4)), c))
            for _ in range(4):  # in a window
                more = window_of(len(w)) - len(w)
                at = rng.randint(0, more)
                examples.append((grams_of(rng.sample(filler, at) + w + rng.sample(filler, more - at)), c))
    for t in OTHER:
        w = words_of(t)
        examples += [(grams_of(w), len(classes) - 1)] * 2
    examples += [(grams_of(rng.sample(filler, rng.randint(1, 12))), len(classes) - 1) for _ in range(150)]
    examples.append((set(), len(classes) - 1))
    weights = {g: [0.0] * len(classes) for x, _ in examples for g in x}
    bias = [0.0] * len(classes)
    for _ in range(rounds):
        step: dict[str, list[float]] = {}
        shift = [0.0] * len(classes)
        for x, y in examples:
            scale = 1 / math.sqrt(len(x) or 1)
            z = [b + scale * sum(weights[g][k] for g in x) for k, b in enumerate(bias)]
            top = max(z)
            e = [math.exp(v - top) for v in z]
            total = sum(e)
            d = [v / total - (k == y) for k, v in enumerate(e)]
            for k, v in enumerate(d):
                shift[k] += v
            for g in x:
                s = step.setdefault(g, [0.0] * len(classes))
                for k, v in enumerate(d):
                    s[k] += v * scale
        n = len(examples)
        for g, s in step.items():
            weights[g] = [w * (1 - decay) - rate * 8 * v / n for w, v in zip(weights[g], s, strict=True)]
        bias = [b - rate * v / n for b, v in zip(bias, shift, strict=True)]
    temperature, shift = calibrated(classes, weights, bias)
    weights = {g: [v / temperature for v in w] for g, w in weights.items()}
    bias = [b / temperature for b in bias]
    bias[-1] += shift
    return classes, weights, bias


def occurrences(documents: DataFrame, ids: dict[str, int], gate: list[str], text: str, key: str) -> DataFrame:
    """(row, pos, word, pair, line, whole, gated) of every word that training has, from one scan of whole texts: numbers of the word and of its 2-gram with
    the next word (null: not known), the line it is in, whether the 2-gram is too, whether the text has a word of `gate`. One more row for each document has
    word 0, doc_id and n_windows."""
    spark = documents.sparkSession
    docs = documents.select(F.col(key).alias("doc_id"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text")).withColumn("row", F.monotonically_increasing_id())
    docs = docs.select("row", "doc_id", F.transform(F.split("text", "\n"), lambda x: F.regexp_extract_all(x, F.lit("[a-z0-9]+"), F.lit(0))).alias("lines"))
    along = F.concat(F.array(F.lit(-1)), F.flatten(F.transform("lines", lambda x, j: F.array_repeat(j, F.size(x)))))
    docs = docs.select("row", "doc_id", "lines", F.concat(F.array(F.lit("")), F.flatten("lines")).alias("words"), along.alias("along"))
    n_windows = sum((F.ceil((F.size("words") - 1) / F.lit(w // 3)) for w in WINDOWS), F.size(F.filter("lines", lambda x: F.size(x) > 0))).cast("long")
    gated = F.arrays_overlap("words", F.array(*[F.lit(w) for w in gate]))
    docs = docs.select("row", "doc_id", "words", "along", n_windows.alias("n_windows"), gated.alias("gated"))
    at = F.arrays_zip(F.col("words").alias("gram"), F.expr("slice(words, 2, size(words))").alias("next"), F.col("along").alias("line"), F.expr("slice(along, 2, size(along))").alias("beyond"))
    # outer, as Spark would put a filter for empty arrays before the scan's projections and so make the words twice; no array is empty
    docs = docs.select("row", "doc_id", "n_windows", "gated", F.posexplode_outer(at).alias("pos", "at"))
    docs = docs.select("row", "doc_id", "n_windows", "gated", (F.col("pos") - 1).alias("pos"), "at.*")
    known = lambda size, name: F.broadcast(spark.createDataFrame([(g, i) for g, i in {"": 0, **ids}.items() if len(g.split(" ")) == size], f"gram string, {name} int"))
    docs = docs.join(known(1, "word"), "gram")
    docs = docs.withColumn("gram", F.concat("gram", F.lit(" "), "next")).join(known(2, "pair"), "gram", "left")
    mark = lambda c: F.when(F.col("word") == 0, F.col(c)).alias(c)
    return docs.select("row", "pos", "word", "pair", "line", F.coalesce(F.col("line") == F.col("beyond"), F.lit(False)).alias("whole"), "gated", mark("doc_id"), mark("n_windows"))


def in_windows(found: DataFrame) -> DataFrame:
    """(row, kind, k, gram): the known grams of each window, each once: where it occurs first. kind is the window's words, 0 for lines."""
    both = F.array(F.struct(F.col("word").alias("gram"), F.lit(1).alias("size"), F.lit(True).alias("whole")), F.struct(F.col("pair").alias("gram"), F.lit(2).alias("size"), F.col("whole")))
    grams = found.filter("word > 0").select("row", "pos", "line", F.explode(both).alias("g")).filter("g.gram is not null").select("row", "pos", "line", "g.*")
    along = Window.partitionBy("row", "gram").orderBy("pos")
    grams = grams.withColumn("last", F.lag("pos").over(along)).withColumn("above", F.lag("line").over(along))
    kinds = F.explode(F.array(*[F.struct(F.lit(w).alias("kind"), F.lit(max(w // 3, 1)).alias("step")) for w in (0, *WINDOWS)])).alias("w")
    grams = grams.select("*", kinds).select("row", "gram", "pos", "size", "line", "whole", "last", "above", "w.*")
    low = F.expr("if(kind = 0, line, greatest(0, (pos + size - kind + step - 1) div step, last div step + 1))").cast("int")
    high = F.expr("if(kind = 0, if(whole and not above <=> line, line, line - 1), pos div step)").cast("int")
    grams = grams.select("row", "kind", "gram", low.alias("low"), high.alias("high")).filter("low <= high")
    return grams.select("row", "kind", F.explode_outer(F.sequence("low", "high")).alias("k"), "gram")


def in_places(found: DataFrame, places: DataFrame) -> DataFrame:
    """in_windows of these windows (row, kind, k) alone, found by the stretches of the longest window's words that they touch."""
    longest = WINDOWS[-1]
    grid = places.filter("kind > 0").withColumn("start", F.expr("k * (kind div 3)")).withColumn("stretch", F.expr(f"explode(sequence(start div {longest}, (start + kind - 1) div {longest}))"))
    grid = grid.join(found.withColumn("stretch", F.expr(f"cast(pos div {longest} as bigint)")), ["row", "stretch"]).filter("pos between start and start + kind - 1")
    grid = grid.select("row", "kind", "k", "word", F.expr("if(pos < start + kind - 1, pair, null)").alias("pair"))
    lines = places.filter("kind = 0").join(found.withColumnRenamed("line", "k"), ["row", "k"]).select("row", "kind", "k", "word", F.expr("if(whole, pair, null)").alias("pair"))
    return grid.unionByName(lines).select("row", "kind", "k", F.explode(F.array("word", "pair")).alias("gram")).filter("gram is not null").distinct()


def judgements(grams: DataFrame, table: DataFrame, classes: tuple[str, ...], bias: list[float]) -> DataFrame:
    """(row, kind, k, class, p, p0, p1 …) of windows that hold known grams: the likeliest class (ties: the first by name), its probability and each family's."""
    families = range(len(classes) - 1)
    sums = grams.join(F.broadcast(table), "gram").groupBy("row", "kind", "k").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"w{c}").alias(f"w{c}") for c in families])
    odds = sums.select("row", "kind", "k", *[F.exp(F.col(f"w{c}") / F.sqrt("n") + (bias[c] - bias[-1])).alias(f"e{c}") for c in families])
    odds = odds.select("*", sum((F.col(f"e{c}") for c in families), F.lit(1.0)).alias("all"), F.greatest(F.lit(1.0), *[f"e{c}" for c in families]).alias("top"))
    e = {name: F.col(f"e{c}") if c in families else F.lit(1.0) for c, name in enumerate(classes)}
    best = F.coalesce(*[F.when(e[name] == F.col("top"), F.lit(name)) for name in sorted(classes)])
    return odds.select("row", "kind", "k", best.alias("class"), (F.col("top") / F.col("all")).alias("p"), *[(F.col(f"e{c}") / F.col("all")).alias(f"p{c}") for c in families])


def licence_notices(documents: DataFrame, least: float = 0.5, alike: float = 0.6, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of documents: doc_id, n_notices, families (sorted, comma-joined), family, score; n_windows, n_named, guess, guess_score.

    The classifier judges every window of words (of the whole text, or a line). A window counts as a notice of the likeliest family if that family's
    probability is at least `least` and `alike` of the 2-grams of one of its templates are in the window. Windows of one notice count once: notices of a
    family with few words between them are one, unless its template's 2-grams repeat. family and score are those
    of the likeliest notice (ties: the first family by name), `unknown` where a text has no notice, with the highest probability of
    its windows that are like a template, 1 without any.
    The last four columns hold what the classifier alone says, like a template or not: the number of windows, of those that it gives to a family with at
    least `least`, and the family with the highest probability in any window, with that probability (ties: the first by name; in a text
    without words, or a window without words of the training, the biases decide).
    Null, empty and wordless texts have none. Repeated rows are scored each for itself; an empty table
    gives no rows; other columns are ignored.
    """
    spark = documents.sparkSession
    ws = Workspace(spark, "licences")
    classes, weights, bias = trained()
    ids = {g: i for i, g in enumerate(weights, 1)}
    families = range(len(classes) - 1)
    # the tables hold the training's grams only, a few thousand rows
    table = spark.createDataFrame([(ids[g], *(v - w[-1] for v in w[:-1])) for g, w in weights.items()], f"gram int, {', '.join(f'w{c} double' for c in families)}")
    shapes = [(f, f"{f}/{i}", len(g), window_of(len(words_of(t))), ids[p]) for f, ts in TEMPLATES.items() for i, t in enumerate(ts) for g in [grams_of(words_of(t), (2,))] for p in g]
    shapes = F.broadcast(spark.createDataFrame(shapes, "class string, template string, size int, kind int, pair int"))
    found = ws.save(occurrences(documents, ids, gate_words(weights, alike), text, key), "found")
    # every window: sums by window need no table, as all of a row is in one partition
    dealt = found.filter("word > 0").select("row", "pos", "word", "pair", "line", "whole").repartition(1 + found.count() // FOUND, "row")
    every = judgements(in_windows(dealt), table, classes, bias).withColumn("named", ((F.col("p") >= least) & (F.col("class") != UNKNOWN)).cast("long"))
    every = ws.save(every.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.sum("named").alias("n_named"), *[F.max(f"p{c}").alias(f"p{c}") for c in families]), "every")
    # a text without a word of the gate, or without one of these 2-grams, has no window that is like a template
    near = found.filter("word > 0 and gated").select("row", "pos", "word", "pair", "line", "whole")
    telling = near.filter(F.col("pair").isin([ids[p] for p in gate_pairs(weights, alike)])).select("row").distinct()
    near = ws.save(near.join(telling, "row", "left_semi"), "near")
    # a hit is a 2-gram of a template in a window (row, kind, k); kind is the window's words, 0 for lines
    met = near.select("row", F.col("pos").cast("long").alias("pos"), "line", "whole", "pair").join(shapes, "pair")
    within = F.expr("explode(sequence(greatest(0, cast(ceil((pos + 2 - kind) / (kind div 3)) as int)), cast(pos div (kind div 3) as int)))")
    grid = met.select("row", "kind", within.alias("k"), "class", "template", "size", "pair", "pos")
    whole = met.filter("whole").select("row", F.lit(0).alias("kind"), F.col("line").alias("k"), "class", "template", "size", "pair", "pos")
    hits = ws.save(grid.unionByName(whole), "hits")
    place = ["row", "kind", "k"]
    like = hits.groupBy(*place, "class", "template").agg((F.count_distinct("pair") / F.max("size")).alias("share"))
    like = ws.save(like.filter(F.col("share") >= alike).drop("share"), "like")
    judged = ws.save(judgements(in_places(near, like.select(*place).distinct()), table, classes, bias).select(*place, "class", "p"), "judged")
    notices = ws.save(like.join(judged.filter(F.col("p") >= least), [*place, "class"]), "notices")
    held = hits.join(notices.select(*place, "template"), [*place, "template"], "left_semi").select("row", "class", "template", "size", "pair", "pos").distinct()
    along = Window.partitionBy("row", "class").orderBy("pos")
    held = held.withColumn("new", (F.col("pos") - F.lag("pos").over(along) > WINDOWS[-1]).cast("int")).withColumn("part", F.sum(F.coalesce("new", F.lit(0))).over(along))
    held = ws.save(held.drop("new"), "held")
    # where families share all of a notice's hits, the one with most hits there has it: a part of a longer notice is none
    spans = held.select("row", "class", "part", "pos").distinct().withColumn("hits", F.count(F.lit(1)).over(Window.partitionBy("row", "class", "part")))
    owner = F.row_number().over(Window.partitionBy("row", "pos").orderBy(F.desc("hits"), "class"))
    held = held.join(spans.withColumn("owner", owner).filter("owner = 1").select("row", "class", "part").distinct(), ["row", "class", "part"], "left_semi")
    held = held.groupBy("row", "class", "part", "template", "pair").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    held = held.groupBy("row", "class", "part", "template").agg(F.sort_array(F.collect_list("n"), asc=False).alias("n"), F.ceil(F.max("size") * F.lit(alike) - 1e-9).cast("int").alias("need"))
    held = held.groupBy("row", "class", "part").agg(F.max(F.coalesce(F.try_element_at("n", "need"), F.lit(0))).alias("n"))
    named = ws.save(held.groupBy("row", "class").agg(F.greatest(F.sum("n"), F.lit(1)).alias("n")), "named")
    counts = named.groupBy("row").agg(F.sum("n").alias("n_notices"), F.array_join(F.array_sort(F.collect_set("class")), ",").alias("families"))
    first = notices.join(named, ["row", "class"], "left_semi").groupBy("row").agg(F.min(F.struct((-F.col("p")).alias("q"), F.col("class").alias("class"))).alias("first"))
    top = judged.groupBy("row").agg(F.max("p").alias("top"))
    docs = found.filter("word = 0").select("row", "doc_id", "n_windows").join(every, "row", "left")
    # what the biases alone give to each family, in windows without a known gram
    odds = [math.exp(b - bias[-1]) for b in bias[:-1]]
    idle = (F.col("n_windows") == 0) | (F.coalesce("n", F.lit(0)) < F.col("n_windows"))
    ps = {classes[c]: F.greatest(F.col(f"p{c}"), F.when(idle, F.lit(o / (1 + sum(odds))))) for c, o in enumerate(odds)}
    docs = docs.withColumn("guess_score", F.greatest(*ps.values()))
    docs = docs.withColumn("guess", F.coalesce(*[F.when(ps[name] == F.col("guess_score"), F.lit(name)) for name in sorted(ps)]))
    out = docs.join(top, "row", "left").join(first, "row", "left").join(counts, "row", "left")
    score = F.coalesce(-F.col("first.q"), "top", F.lit(1.0)).alias("score")
    notices = (F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"), F.coalesce("families", F.lit("")).alias("families"), F.coalesce("first.class", F.lit(UNKNOWN)).alias("family"), score)
    return out.select("doc_id", *notices, "n_windows", F.coalesce("n_named", F.lit(0)).cast("long").alias("n_named"), "guess", "guess_score")
