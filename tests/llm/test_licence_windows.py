"""Licence notices against a plain version of the windows, the comparison with templates and the classifier; notices in other words and of other families."""

import math
import random
import re

import pytest

from tomeforge.llm import licences as L

ALIKE, LEAST = 0.6, 0.5


def brute(text):
    """(family, score) of a text whose notices are of one family."""
    classes, weights, bias = L.trained()
    words = re.findall("[a-z0-9]+", (text or "").lower())
    windows = [(re.findall("[a-z0-9]+", line), 0) for line in (text or "").lower().split("\n")]
    windows += [(words[k * (n // 3) : k * (n // 3) + n], n) for n in L.WINDOWS for k in range(len(words) // (n // 3) + 1)]
    found, top = [], None
    for w, kind in windows:
        pairs = L.grams_of(w, (2,))
        like = set()
        for family, templates in L.TEMPLATES.items():
            for t in templates:
                own = L.grams_of(L.words_of(t), (2,))
                if (not kind or kind == L.window_of(len(L.words_of(t)))) and len(own & pairs) >= ALIKE * len(own) - 1e-9:
                    like.add(family)
        if not like:
            continue
        known = [weights[g] for g in L.grams_of(w) if g in weights]
        z = [b + sum(k[i] for k in known) / math.sqrt(len(known)) for i, b in enumerate(bias)]
        best = max(range(len(z)), key=lambda i: (z[i], [-ord(c) for c in classes[i]]))
        p = 1 / sum(math.exp(v - z[best]) for v in z)
        top = max(p, top or 0)
        if classes[best] in like and p >= LEAST:
            found.append((-p, classes[best]))
    return (min(found)[1], -min(found)[0]) if found else (L.UNKNOWN, 1.0 if top is None else top)


def test_same_as_the_plain_version(spark):
    rng = random.Random(8)
    filler = "river morning table seven Garden window music, teacher winter market letter paper road small great number between. the of and a".split(" ")
    noise = lambda n: [rng.choice(filler) for _ in range(n)]
    rows = [None, "", "licence", " ".join(noise(300))]
    for family, templates in L.TEMPLATES.items():
        for t in rng.sample(templates, 2) if len(templates) > 1 else templates:
            w = t.split()
            rows += [" ".join(noise(rng.randint(0, 40)) + w + noise(rng.randint(0, 40))), "\n".join(" ".join(x) for x in (noise(9), w, noise(5)))]
            rows.append(" ".join(noise(5) + w[: len(w) // 2] + noise(12)))  # half of one
    out = {r.doc_id: r for r in L.licence_notices(spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string")).collect()}
    agreed = 0
    for i, text in enumerate(rows):
        family, score = brute(text)
        assert out[i].family == family and out[i].score == pytest.approx(score, abs=1e-9), text
        assert (out[i].n_notices > 0) == (family != L.UNKNOWN)
        agreed += family != L.UNKNOWN
    assert agreed > 50


def test_families_are_told_apart(spark):
    texts = {
        "gpl": ["// SPDX-License-Identifier: GPL-2.0-only\nint x;", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
        "lgpl": ["This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License.", "SPDX-License-Identifier: LGPL-2.1-or-later"],
        "agpl": ["You should have received a copy of the GNU Affero General Public License along with this program."],
        "isc": ["Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS'],
        "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
        "eupl": ["Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL"],
        "bsd": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
        "mit": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS', "# SPDX-License-Identifier: MIT"],
        "": ["the public library released a copy of the software under the terms of the city", "licence to kill"],
    }
    rows = [(f"{f}/{i}/{n}", t) for f, ts in texts.items() for i, t in enumerate(ts) for n in range(2)] + [(None, texts["mit"][1])]
    out = L.licence_notices(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert len(out) == len(rows) and all(r.families == ("mit" if r.doc_id is None else r.doc_id.split("/")[0]) and r.n_notices == bool(r.families) for r in out)


def test_variants_are_not_in_training():
    for family, notices in L.VARIANTS.items():
        assert family in L.TEMPLATES and not any(L.words_of(v) == L.words_of(t) for v in notices for ts in L.TEMPLATES.values() for t in ts)


def judged(text):
    """(windows, those given to a family, family with the highest probability, that probability) of all windows, each scored by itself."""
    classes, weights, bias = L.trained()
    words = re.findall("[a-z0-9]+", (text or "").lower())
    windows = [w for line in (text or "").lower().split("\n") if (w := re.findall("[a-z0-9]+", line))]
    windows += [words[a : a + n] for n in L.WINDOWS for a in range(0, len(words), n // 3)]
    best, named = {}, 0
    for w in windows or [[]]:
        known = [weights[g] for g in L.grams_of(w) if g in weights]
        z = [b + sum(k[i] for k in known) / math.sqrt(len(known) or 1) for i, b in enumerate(bias)]
        e = [math.exp(v - max(z)) for v in z]
        p = {c: v / sum(e) for c, v in zip(classes, e, strict=True)}
        named += max(p.values()) >= LEAST and max(p, key=p.get) != L.UNKNOWN
        for c in classes[:-1]:
            best[c] = max(best.get(c, 0), p[c])
    guess = max(best, key=best.get)
    return len(windows), named, guess, best[guess]


def test_every_window_is_judged(spark):
    """Texts that are like no template have the classifier's own probability too, and notices in other words are named."""
    rng = random.Random(5)
    filler = "river morning table seven Garden window music, teacher winter the of and a\n to under mit\n\n general 2 qxv zzy".split(" ")
    noise = lambda n: [rng.choice(filler) for _ in range(n)]
    rows = [None, "", " \n\n. ", "qxv", "qxv " * 500, "qxv\n" * 20, "The and THE and the\nand the", "under the", "\nunder\n\nthe terms\nof the\nof the", *(" ".join(noise(n)) for n in (1, 7, 8, 42, 43, 300))]
    other = [(f, " ".join(noise(rng.randint(0, 30)) + [t] + noise(rng.randint(0, 30)))) for f, ts in L.VARIANTS.items() for t in ts]
    rows += [t for _, t in other] + [" ".join(noise(5) + [ts[0]] + noise(9)) for ts in L.TEMPLATES.values()]
    out = {r.doc_id: r for r in L.licence_notices(spark.createDataFrame([*enumerate(rows), (-1, rows[-1]), (-1, rows[-1])], "doc_id int, text string")).collect()}
    for i, text in enumerate(rows):
        n, named, guess, p = judged(text)
        assert (out[i].n_windows, out[i].n_named, out[i].guess) == (n, named, guess), text
        assert out[i].guess_score == pytest.approx(p, abs=1e-9), text
    for c in out[-1].__fields__[1:]:
        same = out[len(rows) - 1][c]
        assert out[-1][c] == (pytest.approx(same, abs=1e-9) if isinstance(same, float) else same)
    unconfirmed = [i for i, r in out.items() if r.n_named and not r.n_notices]
    assert len(unconfirmed) > 5 and all(0 < r.guess_score < 1 for r in out.values())
