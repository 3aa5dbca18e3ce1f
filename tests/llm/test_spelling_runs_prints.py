"""op11 to op13 against brute force, with their edge cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from tomeforge.llm import bytesops, queries, simhash, spelling, tandem

SCHEMA = "doc_id long, text string, id long, word string, runs int, print string, root int"  # columns that clash with internal names
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, "y", 3) for i, t in rows], SCHEMA)


def test_long_texts_are_cut_between_runs():
    inside = np.array([c == "x" for c in "xx..xxxxxxx.x..xx"])
    for limit in range(1, 20):
        ends = bytesops.cut_long(inside, limit)
        assert ends[-1] == len(inside) and all(not (inside[e - 1] and inside[e]) for e in ends[:-1])
    assert bytesops.cut_long(inside[:0]) == []


def brute_words(rows, spoil, least):
    counts = collections.Counter()
    for i, t in rows:
        for x in re.findall("[A-Za-zÀ-ÿ]+", (t or "").translate(LOW)):
            h = zlib.crc32(f"{'' if i is None else i}:{x}".encode())
            if spoil and h % spoil == 0:
                x = x[: h % len(x)] + x[h % len(x) + 1 :]
            counts[x] += len(x) >= least
    return {x: n for x, n in counts.items() if n}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts, least):
    w = {x: n for x, n in counts.items() if n >= least}
    near = {x: [y for y in w if one_apart(x, y)] for x in w}
    best = {x: min(near[x], key=lambda y: (-w[y], y)) if near[x] else None for x in w}
    form = {x: y if y and w[y] >= 2 * w[x] else None for x, y in best.items()}

    def root(x):
        return root(form[x]) if form[x] else x

    return sorted((x, form[x], root(x), n, len(near[x]), w[form[x]] if form[x] else None) for x, n in w.items())


def word_rows():
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdé") for _ in range(rng.randint(4, 9))) for _ in range(40)]
    text = lambda n: " ".join(rng.choice(base) if rng.random() < 0.8 else (lambda x, k: x[:k] + rng.choice("abcÉx") + x[k + rng.randint(0, 1) :])(rng.choice(base), rng.randrange(5)) for _ in range(n))
    rows = [(i, text(rng.randint(0, 200))) for i in range(30)] + [(None, text(50)), (7, None), (8, ""), (9, "12 - 34"), (7, "A×B÷CDEĀfghij")]
    return rows + [(40, "B" * 3000 + " " + "b" * 2999), (41, ("b" * 3000 + "1") * 3), (41, "b" * 2999)] + rows[:3]


@pytest.mark.parametrize("spoil", [None, 5, 97])
def test_word_counts(spark, monkeypatch, spoil):
    monkeypatch.setattr(spelling, "SIDE_BY_SIDE", 6)
    rows = word_rows()
    got = {r.word: r.n for r in spelling.word_counts(frame(spark, rows), 5, spoil).collect()}
    assert got == brute_words(rows, spoil, 5)


def test_word_counts_of_a_text_over_a_megabyte(spark):
    text = "Alphá beta, " * 120_000 + "z" * 1_500_000 + " tail"
    assert len(text.encode()) > 2 * bytesops.SLICE_BYTES
    for spoil in (None, 3):
        assert {r.word: r.n for r in spelling.word_counts(frame(spark, [(1, text), (2, "x")]), 4, spoil).collect()} == brute_words([(1, text), (2, "x")], spoil, 4)


def test_deletions():
    words = ["aab", "", "x", "ééé", "abcab"]
    owner, key, low, high = spelling.deletions(words)
    seen = {}
    for o, k, a, b in zip(owner.tolist(), key.tolist(), low.tolist(), high.tolist(), strict=True):
        left = {words[o]} if a < 0 else {words[o][:i] + words[o][i + 1 :] for i in range(a, b + 1)}
        assert len(left) == 1 and seen.setdefault(k, left) == left
    assert len(seen) == len({x for w in words for x in [w, *(w[:i] + w[i + 1 :] for i in range(len(w)))]})


def test_spelling_variants(spark):
    counts = brute_words(word_rows(), 5, 4)
    counts |= {"chain": 3, "chains": 6, "chainst": 12, "hchainst": 24, "tiesa": 5, "tiesb": 50, "tiesc": 50, "Ābcde": 9, "ābcde": 3, "ab": 5, "ba": 5}
    got = spelling.spelling_variants(spark.createDataFrame([(w, n) for w, n in counts.items()] + [(None, 9), ("chain", 0)], "word string, n long"), 3)
    assert sorted(map(tuple, got.collect())) == brute_variants(counts, 3)
    assert spelling.spelling_variants(spark.createDataFrame([], "word string, n long")).count() == 0


def brute_runs(w, least):
    best = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            if w[i] == w[i + p]:
                j = i
                while j + p < len(w) and w[j] == w[j + p]:
                    j += 1
                if j + p - i >= max(least, 2 * p):
                    best.setdefault((i, j + p - i), p)
                i = j
            i += 1
    return sorted(((s, n, p) for (s, n), p in best.items()), key=lambda x: (x[0], x[2]))


@pytest.mark.parametrize("block", [3, 1 << 20])
def test_runs_by_brute_force(monkeypatch, block):
    monkeypatch.setattr(tandem, "AT_ONCE", block)
    rng = random.Random(12)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 4)):
            w = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(0, 40))]
            if w and rng.random() < 0.4:
                a = rng.randrange(len(w))
                w = w[:a] + [w[a + (i - a) % (1 + (len(w) - a) // 3)] for i in range(a, len(w))]
            texts.append(w)
        of = np.repeat(np.arange(len(texts)), list(map(len, texts)))
        first = np.cumsum([0, *map(len, texts)])
        s, e, p = tandem.runs(of, np.array([x for w in texts for x in w], np.int64), 2)
        assert list(zip(s.tolist(), (e - s).tolist(), p.tolist(), strict=True)) == [(a + first[i], n, q) for i, w in enumerate(texts) for a, n, q in brute_runs(w, 2)]


def test_periodic_words_of_any_length():
    """One word n times, and a word sequence with a run at nearly every place (Fibonacci)."""
    none = np.zeros(200_000, np.int64)
    assert [x.tolist() for x in tandem.runs(none, none, 12)] == [[0], [200_000], [1]]
    f, g = [0], [0, 1]
    while len(g) < 500:
        f, g = g, g + f
    s, e, p = tandem.runs(none[: len(g)], np.array(g), 2)
    assert list(zip(s.tolist(), (e - s).tolist(), p.tolist(), strict=True)) == brute_runs(g, 2)


def brute_op12(i, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(i).encode())
    if i is not None and h % 10 == 0 and w:
        a, g, n = h // 10 % len(w), h // 10, len(w)
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
    found = brute_runs(w, 12)
    gone = {k for s, n, p in found for k in range(s + p, s + n)}
    top = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else (None,) * 3
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (i, len(found), *top, 1000 * top[1] // top[2] if found else None, sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_op12_query(spark, tmp_path):
    rng = random.Random(13)
    rows = [(i, " \n".join(rng.choice("ab cdefghé") for _ in range(rng.randint(0, 60)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \t\n\x0b"), (None, "a b " * 20), (None, None), (203, "one"), (204, ("x y z " * 9 + "q ") * 3), *rows[:5]]
    rows.append((205, "lorem ipsum dolor " * 70_000))  # over a megabyte
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = [tuple(r) for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r[:2]) + r[6:]
    assert sorted(out, key=key) == sorted((brute_op12(i, t) if len(t or "") < 10_000 else (i, 1, 0, 210_000, 3, 70_000_000, hashlib.sha256(b"0,210000,3\n").hexdigest(), hashlib.sha256(b"lorem ipsum dolor").hexdigest()) for i, t in rows), key=key)
    assert tandem.periodic_runs(frame(spark, [])).count() == 0


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints(spark, monkeypatch):
    rng = random.Random(14)
    words = lambda n: " ".join(rng.choice(["A", "bß", "Ç", "dd", "e"]) for _ in range(n))
    rows = [(i, words(n)) for i, n in enumerate((0, 1, 2, 3, 4, 5, 30, 100))] + [(20, None), (21, " \n"), (22, words(60) + " " + "y" * 300), (None, "Q r s t")]
    want = {(i, brute_print(t)) for i, t in rows}
    assert {(r.doc_id, r.print % (1 << 64)) for r in simhash.fingerprints(frame(spark, rows)).collect()} == want
    long = words(900_000)  # over a megabyte, piece by piece
    assert len(long.encode()) > bytesops.SLICE_BYTES
    assert [r.print % (1 << 64) for r in simhash.fingerprints(frame(spark, [(1, long)])).collect()] == [brute_print(long)]
    for n, k in ((1, 3), (2, 3), (3, 3), (50, 3), (50, 1), (50, 5)):  # pieces shorter than a shingle
        data = np.frombuffer(bytesops.FOLD[np.frombuffer(words(n).encode(), np.uint8)].tobytes(), np.uint8)
        whole = simhash.bit_counts(data, np.array([0, len(data)]), k)
        monkeypatch.setattr(simhash, "cut_long", lambda inside: bytesops.cut_long(inside, 4))
        parts = simhash._long_text(data, k)
        assert whole[1].tolist() == parts[1].tolist() and np.array_equal(whole[0], parts[0])


@pytest.mark.parametrize("limit", [1, 4, simhash.LIST])
def test_near_fingerprints(spark, limit):
    """Links by brute force, with lists compared pair by pair and by their centres."""
    rng = random.Random(15)
    prints = {0}
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 14)):
            prints.add(x)
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
    prints = sorted(prints)
    root = {x: x for x in prints}
    for a in prints:
        for b in prints:
            if a != b and (a ^ b).bit_count() <= 3 and root[a] != root[b]:
                x, y = root[a], root[b]
                root = {k: x if v == y else v for k, v in root.items()}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    ws = simhash.Workspace(spark, "test")
    got = collections.defaultdict(set)
    for r in simhash.near_fingerprints(spark.createDataFrame([(signed(x),) for x in prints], "print long"), ws, limit).collect():
        got[r.root].add(r.node)
    want = collections.defaultdict(set)
    for x, v in root.items():
        want[v].add(signed(x))
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_near_duplicates(spark):
    rng = random.Random(16)
    base = [f"w{rng.randrange(900)}" for _ in range(400)]
    rows = [(i, " ".join(base[:200] + ([f"x{i}"] if i % 2 else []) + base[200:])) for i in range(10, 30)] + [(1, None), (2, ""), (3, "one two"), (4, "one two"), (4, "Other words here"), (None, " ".join(base)), (None, "none of these")]
    got = {(r.doc_id, r.print % (1 << 64)): r.component_id for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    prints = [(i, brute_print(t)) for i, t in rows]
    comp = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 3 and comp[a] != comp[b]:
                x, y = comp[a], comp[b]
                comp = [x if c == y else c for c in comp]
    want = {p: min((prints[j][0] for j in range(len(rows)) if comp[j] == comp[i] and prints[j][0] is not None), default=None) for i, p in enumerate(prints)}
    assert got == want and simhash.near_duplicates(frame(spark, [])).count() == 0
