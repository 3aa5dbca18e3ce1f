"""Word pieces against the tokenizers library, and chunks that keep to a window of tokens."""

import random

import pytest

from tomeforge.functions.wordpiece import WordPieces, words
from tomeforge.operators import chunks

VOCABULARY = ["[UNK]", "[PAD]", *"abcdefghijklmnopqrstuvwxyz0123456789.,!?-#'", *(f"##{c}" for c in "abcdefghijklmnopqrstuvwxyz012"), "the", "##the", "un", "##able", "able", "work", "##ing", "##in", "cafe", "##ß", "東", "京", "##", "12", "##34"]


def library(lower):
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    t = Tokenizer(models.WordPiece({p: i for i, p in enumerate(VOCABULARY)}, unk_token="[UNK]", max_input_chars_per_word=100))
    t.normalizer = normalizers.BertNormalizer(lowercase=lower)
    t.pre_tokenizer = pre_tokenizers.BertPreTokenizer()
    return t


@pytest.mark.parametrize("lower", [True, False])
def test_same_pieces_as_the_library(lower):
    rng, theirs, own = random.Random(5), library(lower), WordPieces(VOCABULARY, lower)
    texts = ["Unworkable CAFÉ, café!", "the東京 thethe", "x" * 100, "x" * 101, "a​b\x00c�d \t\n e　f", "naïve §7 #1234 # ## ###", "ß Straße ẞ", "don't—stop… ½ ²", "é ́", ""]
    signs = "abctheuningworkable  .,!é東\n-#12ßÉ'§​"
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    for t in texts:
        assert own.pieces(t) == theirs.encode(t, add_special_tokens=False).tokens and own(t) == len(own.pieces(t)), t


def test_words():
    assert words(" A-b  c. ") == ["a", "-", "b", "c", "."] and words("É", lower=False) == ["É"] and words("") == []


@pytest.mark.parametrize(("window", "overlap"), [(8, 100), (30, 20), (512, 100)])
def test_chunks_keep_to_the_window(window, overlap):
    rng, count = random.Random(window), WordPieces(VOCABULARY)
    for _ in range(60):
        text = "".join(rng.choice(["the ", "working ", "1234567 ", "\n", "\n\n", "東京", "a" * rng.randint(1, 40) + " ", "?!"]) for _ in range(rng.randint(1, 200)))
        out = chunks.split(text, rng.choice(["", "summary"]), count, 300, overlap, min(25, window), window)
        assert all(count(c) <= window for c in out)
        bare = chunks.split(text, "", count, 300, 0, min(25, window), window)
        assert "".join("".join(bare).split()) == "".join(text.split())  # without overlap nothing is lost or added


def test_chunked_with_a_counter(spark):
    count = WordPieces(VOCABULARY)
    docs = spark.createDataFrame([("a", "the working " * 300), ("b", "short"), ("c", None), ("d", "1" * 3000)], "id string, text string")
    out = chunks.chunked(docs, "id", "text", count=count, window=50).collect()
    assert all(count(r.text) <= 50 for r in out) and {r.id for r in out if r.parent_id is None} == {"b", "c"}
    assert sorted(r.chunk_index for r in out if r.parent_id == "a") == list(range(max(r.chunk_count for r in out if r.parent_id == "a")))
