"""Operators against brute force, round trips and held-out accuracy, and their edge cases."""

import hashlib
import random
import re
import textwrap
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tomeforge.llm import ann, decontaminate, huffman, langid, licences, ngram_join, packing, quality, sharding, tokens, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, part long, component_id long"
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    base = [[rng.choice(words) for _ in range(n)] for n in (5, 8, 13, 40, 90, 200)]
    texts = [None, "", " \n ", "one", "One two", "one  two", "a b c", "é ß A", "x" * 5000 + " y", "the " * 3000]
    for b in base:
        for _ in range(8):
            c = list(b)
            for _ in range(rng.randint(0, max(1, len(b) // 15))):
                c[rng.randrange(len(c))] = rng.choice(words)
            texts.append(" ".join(c))
    rows = [(i, t, "en", None, None if t is None else len(t), 1, 2, 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)  # extra columns clash with internal names


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_ngram_join(docs, empty):
    out = {r.doc_id: r for r in ngram_join.ngram_jaccard_join(docs).collect()}
    sets = {}
    for r in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(LOW))
        sets[r.doc_id] = {tuple(w)} if 0 < len(w) < 4 else {tuple(w[j : j + 4]) for j in range(len(w) - 3)}
    root = {i: i for i in sets}
    links = dict.fromkeys(sets, 0)
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            i, u = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if a != b and u and 100 * i >= 85 * u:
                links[a] += 1
                x, y = root[a], root[b]
                if x != y:
                    root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    assert {i: (r.n_shingles, r.component_id, r.n_links) for i, r in out.items()} == {i: (len(sets[i]), root[i], links[i]) for i in sets}
    assert ngram_join.ngram_jaccard_join(empty).count() == 0


def brute_join(rows, k, percent):
    """(set size, component, links) of each row, and its component's first row, by comparing all pairs."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)) for _, t in rows]
    sets = [{tuple(w)} if 0 < len(w) < k else {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} for w in words]
    root, links = list(range(len(rows))), [0] * len(rows)
    for a in range(len(rows)):
        for b in range(len(rows)):
            i, u = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if a != b and u and 100 * i >= percent * u:
                links[a] += 1
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    least = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in root}
    return [(rows[i][0], len(sets[i]), least[root[i]], links[i]) for i in range(len(rows))], root


@pytest.mark.parametrize(("k", "percent", "broadcast"), [(4, 85, 1_000_000), (5, 80, 0)])
def test_ngram_join_with_repeated_and_null_ids(spark, monkeypatch, k, percent, broadcast):
    """Ids that repeat over different texts, null ids, exact copies, repeated rows, a large near-copy group over several blocks."""
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rng = random.Random(k)
    word = lambda: f"w{rng.randrange(5000)}"
    base, other = [word() for _ in range(120)], [word() for _ in range(60)]
    edit = lambda x, n: " ".join(w if i not in n else word() for i, w in enumerate(x))
    rows = [(1, edit(base, ())), (1, edit(other, ())), (2, edit(base, (3,))), (3, edit(other, (50,))), (None, edit(base, (70,))), (None, edit(other, ())), (None, " ".join(word() for _ in range(30))), (7, None), (None, None), (8, ""), (9, "one two"), (9, "one  TWO")]
    rows += [(20 + i, edit(base, rng.sample(range(120), rng.randrange(1, 5)))) for i in range(60)] + [(200, edit(base, ()))] * 5
    rows += [(300 + i, " ".join(base[:70] + [word() for _ in range(60)])) for i in range(10)]  # a passage that many share
    want, root = brute_join(rows, k, percent)
    out = ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in out), key=key) == sorted(want, key=key)
    assert len({r.component for r in out if r.component is not None}) == len({r for r, w in zip(root, want, strict=True) if w[1]})


def test_support_bound_keeps_every_link():
    """Whoever links has too few n-grams missing to go: checked on the counts that a bucket makes."""
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 1 << 63, 200, dtype=np.uint64) * np.uint64(2))
    sets = [np.unique(np.append(np.delete(base, rng.integers(0, len(base), 15)), rng.integers(0, 1 << 63, 10, dtype=np.uint64))) for _ in range(6)]
    for a, x in enumerate(sets):
        y = np.concatenate([s for b, s in enumerate(sets) if b != a])
        linked = any(100 * len(np.intersect1d(x, s)) >= 80 * len(np.union1d(x, s)) for b, s in enumerate(sets) if b != a)
        low = ngram_join.lower_part(x)
        missing = low - int(np.isin(x[:low], y).sum())
        assert not linked or 100 * missing <= 20 * len(x)


def test_size_windows_hold_every_pair():
    low, high = ngram_join.size_windows(85, 4000)
    for s in range(1, 600):
        t = 100 * s // 85
        assert ((low <= s) & (t <= high)).any()


@pytest.mark.parametrize("percent", [50, 80, 85, 95])
def test_signatures_meet_for_every_link(percent):
    """Every pair of sets at or over the threshold shares a key, for small, large and sparse sets alike."""
    rng = np.random.default_rng(percent)
    sets = []
    for n in [*range(1, 40), 60, 90, 200, 700] * 8:
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        for _ in range(3):
            new, lost = rng.integers(0, n * (100 - percent) // 130 + 2, 2)
            sets.append(np.unique(np.append(base[lost:] if lost < n else base, rng.integers(0, 1 << 63, new, dtype=np.uint64))))
    nodes = np.array([ngram_join.node_of(s) for s in sets], np.int64)
    held = [set(ngram_join.signatures([s], nodes[i : i + 1], percent)[0].tolist()) for i, s in enumerate(sets)]
    links = 0
    for x in range(0, len(sets), 3):
        for i in range(x, x + 3):
            for j in range(i + 1, x + 3):
                same = len(np.intersect1d(sets[i], sets[j]))
                if nodes[i] != nodes[j] and 100 * same >= percent * (len(sets[i]) + len(sets[j]) - same):
                    links += 1
                    assert held[i] & held[j]
    assert links > 20


def test_packed_keys_come_back():
    rng = np.random.default_rng(0)
    keys, owners = rng.integers(0, 1 << 63, 5000, dtype=np.uint64), np.sort(rng.integers(0, 9, 5000))
    got = set()
    for bucket, *blobs in ngram_join.pack_keys(keys, owners, 3):
        short, own = ngram_join.unpack_keys(*blobs)
        got |= {(bucket, k, o) for k, o in zip(short.tolist(), own.tolist(), strict=True)}
    assert got == {(k % 3, k // 3 % (1 << 48), o) for k, o in zip(keys.tolist(), owners.tolist(), strict=True)}
    assert not list(ngram_join.pack_keys(keys[:0], owners[:0], 3))


def test_tokens_and_files(spark, docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary_path())
    start = 0
    got = {r.doc_id: r for r in huffman.token_files(docs).collect()}
    for r in docs.orderBy("doc_id").collect():
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        o = got[r.doc_id]
        assert (o.start, o.n_tokens, o.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert huffman.token_files(empty).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 1023, 1024, 1025, 5000])
def test_huffman_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 3000).astype(np.uint32)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=3000), 13)
    assert lengths.max(initial=0) <= 13
    keys, sizes = np.array([1, 2, 3]), np.array([0, n, 0])
    null = np.array([True, False, False])
    a, z, b, c = huffman.read_file(huffman.write_file(keys, null, sizes, ids, lengths))
    assert (a == keys).all() and (z == null).all() and (b == sizes).all() and (c == ids).all()


def test_units_are_encoded_as_whole_texts_are(monkeypatch):
    """Case, contractions, composed and split accents, other scripts, odd white space, special tokens' strings, and texts over several slices."""
    from tokenizers import Tokenizer

    t, rng = Tokenizer.from_file(tokens.vocabulary_path()), random.Random(1)
    signs = ["a", "B", "é", "É", "ß", "×", "÷", "1", "'s", "'", "e\u0301", "日本", "Ω", "Σ", "İ", " ", " ", "  ", "\n", ".", ",", "!?", "<|endoftext|>", "<|ENDOFTEXT|>", "don't", "I'LL", "😀", "\x0b", "\x1c", "\u00a0", "_", "ﬁ", "ÿ", "’s", "\x00"]
    texts = [None, "", " "] + ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 40))) for _ in range(800)]
    monkeypatch.setattr(tokens, "SLICE_BYTES", 2000)
    texts.append(" ".join(rng.choice(signs) for _ in range(4000)))
    seen = 0
    for i, j, ids, off in tokens.encoded(pa.array(texts), tokens.vocabulary_path()):
        for x in range(i, j):
            seen += 1
            assert ids[off[x - i] : off[x - i + 1]].tolist() == [*t.encode(texts[x] or "", add_special_tokens=False).ids, 1]
    assert seen == len(texts)


def test_a_full_table_of_units_is_filled_again(monkeypatch):
    monkeypatch.setattr(tokens, "SLOTS", 1 << 10)
    c, rng = tokens.Coder(tokens.vocabulary_path()), random.Random(2)
    for _ in range(8):
        text = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300))
        raw = np.frombuffer(text.encode(), np.uint8)
        assert c.encode(raw, np.array([0, len(raw)]))[0].tolist() == c.tokenizer.encode(text, add_special_tokens=False).ids


def test_token_files_with_null_and_repeated_ids(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary_path())
    rows = [(5, "five one"), (None, "nothing here"), (5, "five two"), (5, "five two"), (None, None), (-3, "minus three"), (9, "")]
    got = huffman.token_files(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    got.sort(key=lambda r: r.start)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    start, want = 0, []
    for i, text in order:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want


def test_packed_pieces_hold_the_ids(spark, docs):
    """Each id in exactly one piece, the end id last, crc of the piece's ids; also with null and repeated ids, and long texts cut."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary_path())
    own = {r.doc_id: r.text for r in docs.collect()}
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for i, x in own.items()}
    pieces = {}
    for r in packing.pack(docs, 64).collect():
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    for i, p in pieces.items():
        p.sort()
        assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:], strict=False)) and sum(p[-1]) == len(ids[i])
    assert pieces.keys() == own.keys()
    odd = packing.pack(spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (1, None)], "doc_id long, text string"), 64).collect()
    assert sorted((r.doc_id or 0, r.doc_tokens) for r in odd) == [(0, 3), (1, 1), (1, 3), (1, 3)]


def test_packing(docs, empty):
    out = packing.pack(docs, 256).toPandas()
    assert (out.groupby("doc_id").length.sum() == out.groupby("doc_id").doc_tokens.first()).all()
    assert out.groupby("sequence_id").length.sum().max() <= 256
    out = out.sort_values(["sequence_id", "offset"])
    assert ((out.groupby("sequence_id").length.cumsum() - out.length) == out.offset).all()
    assert packing.pack(empty).count() == 0


def test_cutting_stock_is_exact():
    weight, demand = np.array([3, 5, 9, 16]), np.array([40, 31, 7, 5])
    plan = packing.cutting_stock(weight, demand, 16)
    assert (sum(t * p for t, p in plan) == demand).all() and all((p * weight).sum() <= 16 for _, p in plan)


def test_decontamination(spark, docs, empty):
    some = {r.doc_id: r.text for r in docs.collect()}
    long = some[45].split()
    tests = [(1, " ".join(long[3:30])), (2, "one"), (3, None), (4, ""), (10, " ".join(long[3:16])), (None, "a b c"), (5, "w1 w2 w3 w4 w5 w6 w7")]
    bench = spark.createDataFrame(tests, "item_id long, text string")
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    windows = {}
    for i, t in tests:
        w = cut(t)
        n = min(13, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[j : j + n]), set()).add("" if i is None else str(i))
    expected = {}
    for i, t in some.items():
        w, hit, items = cut(t), set(), set()
        for x, own in windows.items():
            for j in range(len(w) - len(x) + 1):
                if tuple(w[j : j + len(x)]) == x:
                    hit.update(range(j, j + len(x)))
                    items |= own
        sha = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        expected[i] = (len(w), len(hit), len(items), sha, len(hit) > 0 and 20 * len(hit) >= len(w))
    for size in (decontaminate.INDEX_BYTES, 60):  # one index, and several
        assert {r[0]: tuple(r)[1:] for r in decontaminate.contamination(docs, bench, index_bytes=size).collect()} == expected
    assert decontaminate.contamination(empty, bench).count() == 0
    assert not decontaminate.contamination(docs, bench.limit(0)).filter("n_hit > 0").count()


def test_sharding(docs, empty):
    out = sharding.byte_shards(docs.union(docs.limit(3)), 5).toPandas().sort_values(["shard", "slot"])
    assert len(out) == docs.count() + 3 and out.doc_id.is_monotonic_increasing
    assert (out.groupby("shard").slot.max() + 1 == out.groupby("shard").size()).all()
    assert (out.groupby("shard")["size"].sum() - out["size"].sum() / 5).abs().max() <= out["size"].max()
    assert sharding.byte_shards(empty).count() == 0


def test_url_rules_and_links(spark):
    urls = ["http://A.net/x", "https://b.example.net/en/1?q", "http://b.example.net/fr/", "http://example.com/de/", "http://example.com", "x", None, "http://s.org/fr/", "http://net/?a", "http://notnet/", "http://fan.io/"]
    html = [None] * 10 + ['<a href="http://a.net/">x</a>']
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(zip(urls, html, strict=True))], "page_id long, url string, html string")
    out = {r.page_id: r for r in url_filter.url_verdicts(pages).collect()}
    assert [out[i].rule for i in range(11)] == ["net/", "example.net/en/", "net/", "example.com/de/", None, None, None, "org/fr/", "net/", None, None]
    assert (out[0].host, out[1].path, out[4].path, out[5].host, out[6].host) == ("a.net", "/en/1", "", "", "")
    assert out[10].verdict == "block" and out[9].verdict == "allow" and out[6].verdict == "allow"
    assert url_filter.url_verdicts(pages.limit(0)).count() == 0


def test_url_propagation_is_that_of_a_dense_matrix(spark):
    """Trust along links and distrust against them, //host links, parent domains, hosts that only are linked to, repeated and odd rows."""
    rng = random.Random(8)
    hosts = ["a.net", "b.org", "x.fan.io", "y.fan.io", "c.de", "d.de", "sub.d.de", "e.com"]
    pages, edges = [], {}
    for i in range(60):
        h = rng.choice(hosts)
        to = [rng.choice([*hosts, "far.away.se"]) for _ in range(rng.randrange(3))]
        pages.append((i, f"http://{h}/{rng.choice(['fr/', 'x', ''])}", " ".join(f"<a href={q}{rng.choice(['http:', '', 'HTTPS:'])}//{t.upper()}/z{q}>z</a>" for t, q in zip(to, "\"'  ", strict=False))))
        for t in to:
            edges[h, t] = edges.get((h, t), 0) + 1
    pages += [(None, None, None), (100, "http://", "<a href='//'>"), (0, pages[0][1], None), (101, "http://lonely/", "")]
    out = url_filter.url_verdicts(spark.createDataFrame([(*p, "s", "t") for p in pages], "page_id long, url string, html string, host string, mass string"))
    names = sorted({*hosts, "far.away.se", "away.se", "fan.io", "lonely"})
    for h in names:
        p = h.partition(".")[2]
        if "." in p:
            for e in ((h, p), (p, h)):
                edges[e] = edges.get(e, 0) + 1
    n, at = len(names), {h: i for i, h in enumerate(names)}
    w = np.zeros((n, n))
    for (a, b), k in edges.items():
        if a != b:
            w[at[a], at[b]] += k
    norm = lambda m: m / np.maximum(m.sum(1, keepdims=True), 1)
    judged = {}
    for r in out.collect():
        if r.host:
            judged.setdefault(r.host, []).append(r)
    allow, block = np.zeros(n), np.zeros(n)
    for h, rows in judged.items():
        ruled = [r.verdict if r.rule else None for r in rows]
        allow[at[h]], block[at[h]] = ruled.count("allow") / len(rows), ruled.count("block") / len(rows)
    d = url_filter.DAMPING
    dense = lambda seed, m: (1 - d) * np.linalg.solve(np.eye(n) - d * norm(m).T, seed)
    trust, distrust = dense(allow, w), dense(block, w.T)
    slack = url_filter.TOLERANCE * (1 - d) * (allow.sum() + block.sum()) * d / (1 - d)
    for h, rows in judged.items():
        t, f = trust[at[h]], distrust[at[h]]
        for r in rows:
            assert abs(r.trust - t) <= slack and abs(r.distrust - f) <= slack
            if r.rule is None and abs(f - t - url_filter.THRESHOLD * (1 - d)) > 2 * slack:
                assert r.verdict == ("block" if f - t > url_filter.THRESHOLD * (1 - d) else "allow")
    assert trust[at["x.fan.io"]] + distrust[at["x.fan.io"]] > 0
    nothing = [r for r in out.collect() if not r.host]
    assert all(r.verdict == "allow" and r.rule is None for r in nothing)


def test_language_and_quality(spark, empty):
    d = "/root/testdata/sf0.01/"
    docs, labels = spark.read.parquet(d + "documents.parquet"), spark.read.parquet(d + "labels.parquet")
    p = langid.language_id(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    p = p[p.held_out & (p.lang_pred != "und")]
    assert (p.lang_pred == p.lang).mean() > 0.98
    q = quality.quality_scores(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    assert (q[q.held_out].predicted == q[q.held_out].quality).mean() > 0.95
    assert langid.language_id(empty).count() == 0 and quality.quality_scores(empty, labels).count() == 0


def test_language_and_quality_edges(spark, docs):
    out = {r.doc_id: r for r in langid.language_id(docs).collect()}
    assert [out[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and out[3].lang_pred == "en"
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in quality.quality_scores(docs, none).collect())


def naive_bits(trees, text):
    """Code length by walking from the longest context down, with plain dictionaries: prediction by partial matching, method C."""
    raw, bits = b" " * langid.ORDER + bytes(langid.FOLD[b] for b in text), 0.0
    for i in range(langid.ORDER, len(raw)):
        for k in range(langid.ORDER, -1, -1):
            seen = trees[k].get(raw[i - k : i])
            if not seen:
                continue
            total = sum(seen.values()) + len(seen)
            if raw[i] in seen:
                bits -= np.log2(seen[raw[i]] / total)
                break
            bits -= np.log2(len(seen) / total)
        else:
            bits += 8
    return bits


def test_code_lengths_are_those_of_a_plain_model(monkeypatch):
    """All byte values, two languages, texts shorter than the context, empty ones, and texts over several chunks."""
    monkeypatch.setattr(langid, "CHUNK", 37)
    rng = random.Random(4)
    learn = {"x": ["Das ist ein Haus. " * 3, "été à Noël", "a", ""], "y": ["the house is green " * 4, "日本語 text", "THE"]}
    counts, trees = {}, {}
    for lang, texts in learn.items():
        counts[lang], trees[lang] = {}, [{} for _ in range(langid.ORDER + 1)]
        for t in texts:
            raw = t.encode()
            for c in langid.codes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), 0, len(raw)).tolist():
                counts[lang][c] = counts[lang].get(c, 0) + 1
            padded = b" " * langid.ORDER + bytes(langid.FOLD[b] for b in raw)
            for i in range(langid.ORDER, len(padded)):
                for k in range(langid.ORDER + 1):
                    own = trees[lang][k].setdefault(padded[i - k : i], {})
                    own[padded[i]] = own.get(padded[i], 0) + 1
    model = langid.Model(counts)
    texts = ["", "a", "é", "das Haus is green", "日本 house été", "", "\x00\x7f ~", "".join(rng.choice("dasthe ué日") for _ in range(200))]
    raw = [t.encode() for t in texts]
    got = model.bits(model.tables(), np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    want = [[naive_bits(trees[lang], r) for lang in model.languages] for r in raw]
    assert np.allclose(got, want, rtol=1e-5, atol=1e-4)


def test_noise_is_not_accepted(spark):
    rng = random.Random(6)
    words = ["river", "house", "green", "morning", "walked", "seven", "under", "stone", "the", "and"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(200)), "en") for i in range(200)]
    rows += [(1000, "".join(rng.choice("qxzjkvwpbfQXZJ0379") for _ in range(2000)), None), (1001, None, None), (1002, "", "en"), (None, rows[0][1], None)]
    out = {r.doc_id: r for r in langid.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(out[i].accepted and out[i].lang_pred == "en" for i in [*range(200), None])
    assert not out[1000].accepted and not out[1001].accepted and out[1001].lang_pred == "und" and not out[None].held_out


def test_factorisation_identity():
    m = quality.Machine()
    m.weight[:5] = 0.3
    f, v = np.array([0, 3, 9, 4]), np.array([1, 0.5, 2, 0.25], np.float32)
    z, _ = m.parts(np.array([0]), f, v)
    pairs = sum(m.factor[f[i]] @ m.factor[f[j]] * v[i] * v[j] for i in range(4) for j in range(i))
    assert abs(z[0] - (m.weight[f] @ v + pairs)) < 1e-5


def test_licences(spark, docs, empty):
    rows = [(1, "x y.\nLicensed under the Apache License, Version 2.0.\nz"), (2, "Released under the MIT License."), (3, "Ask for permission before you enter."), (4, None), (5, "Licensed under CC BY-NC 4.0.")]
    out = {r.doc_id: r.families for r in licences.licence_notices(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: "apache", 2: "mit", 3: "", 4: "", 5: "cc-by-nc"}
    assert licences.licence_notices(docs).count() == docs.count() and licences.licence_notices(empty).count() == 0


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 16)).astype("f4")
    x[100:160] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(700, None), (750, [0.0] * 16), (800, [float("nan")] * 16), (850, [None] * 16), (900, [])]
    out = ann.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).toPandas()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    good = 0
    for q, g in out.groupby("query_id"):
        s = u @ u[q]
        s[q] = -9
        good += (g.score.values >= np.sort(s)[-5] - 1e-12).sum()
    assert set(out.query_id) == set(range(0, 600, 50)) and good / (5 * 12) >= 0.9
    assert out[out.query_id == 50].sort_values("rank").vec_id.tolist() == [100, 101, 102, 103, 104]
    assert ann.nearest_neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_nearest_neighbours_of_odd_tables(spark):
    """Repeated and null keys, vectors of two lengths, clashing extra columns, more equal vectors than asked for, huge components, few rows."""
    rows = [(0, [1.0, 0.0], 1, 2), (0, [1.0, 0.0], 1, 2), (None, [1.0, 0.0], 1, 2), (50, [1e300, 1e300, 0.0], 1, 2), (1, [0.0, 1.0, 0.0], 1, 2), (2, [1.0, 1.0], 1, 2)]
    rows += [(100 + i, [3.0, 4.0], 1, 2) for i in range(10)]
    out = ann.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>, node long, query long")).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 6)))
    assert got[0] == [(2, 0.707107), (100, 0.6), (101, 0.6), (102, 0.6), (103, 0.6)]
    assert got[50] == [(1, 0.707107)]
    assert [v for v, _ in got[100]] == [101, 102, 103, 104, 105]


def test_nearest_neighbours_beyond_one_group(spark):
    """12,000 vectors, half uniform and half in clusters: descent to its end has a recall of 0.9 at least."""
    rng, n = np.random.default_rng(4), 12_000
    x = rng.normal(size=(n, 24)).astype("f4")
    x[: n // 2] = 0.3 * x[: n // 2] + rng.normal(size=(60, 24))[rng.integers(0, 60, n // 2)].astype("f4")
    out = ann.nearest_neighbours(spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>").repartition(8)).toPandas()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    good = 0
    for q, g in out.groupby("query_id"):
        s = u @ u[q]
        s[q] = -9
        good += (s[g.vec_id.values] >= np.sort(s)[-5] - 1e-12).sum()
        assert np.allclose(g.score.values, s[g.vec_id.values], atol=1e-9)
    assert good / (5 * 240) >= 0.9


def test_walk_goes_to_its_end(spark):
    """On a chain of nodes that only know the next ones the nearest is many steps away."""
    n = 10
    x = [np.array([np.cos(i / n), np.sin(i / n)], "<f4").tobytes() for i in range(n)]
    nodes = spark.createDataFrame([(i, bytearray(v)) for i, v in enumerate(x)], "node long, unit binary")
    graph = spark.createDataFrame([(i, j, 0.0) for i in range(n) for j in (i - 1, i + 1) if 0 <= j < n], "node long, other long, near float")
    asked = spark.createDataFrame([(7, bytearray(x[-1]), 0)], "query long, from binary, node long")
    found = ann.search_graph(ann.Workspace(spark, "walk-test"), graph, nodes, asked).orderBy("score").toPandas()
    assert found.node.tolist() == list(range(n))


def test_licences_in_long_lines_and_wrapped(spark):
    """Each template is found within a line of 200 words and wrapped at 60 columns, once."""
    rng, rows = random.Random(2), []
    for f, ts in licences.TEMPLATES.items():
        for t in ts:
            prose = [rng.choice(["river", "the", "house", "of", "and", "green", "a", "walked", "morning", "seven"]) for _ in range(200)]
            line = " ".join(prose[:90] + [t] + prose[90:])
            rows += [(len(rows), line, f), (len(rows) + 1, textwrap.fill(line, 60), f)]
    out = {r.doc_id: (r.families, r.n_notices) for r in licences.licence_notices(spark.createDataFrame(rows, "doc_id long, text string, f string")).collect()}
    assert {i: out[i] for i, _, f in rows} == {i: (f, 1) for i, _, f in rows}


def test_licence_copies_and_keywordless_notices(spark):
    rows = [(1, "Released under the MIT License.\n" * 3), (2, "Released under CC0 1.0."), (3, "Distributed under the GPL v3."), (4, "the mit campus is under the hill of the public license fee")]
    out = {r.doc_id: (r.families, r.n_notices) for r in licences.licence_notices(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: ("mit", 3), 2: ("cc0", 1), 3: ("gpl", 1), 4: ("", 0)}
