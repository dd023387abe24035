import json
import os
import random

import numpy as np
import pytest

from roundsman.llm import bpe

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")

PLAIN = [
    None, "", " ", "\n\t", "Hello, world!", "it's we'll I'D", "ΑΣ ΌΣΟΣ İstanbul ǅ", "été", "漢字かな交じり文", "👩‍👩‍👧 ok",
    "aaaaaaaaaaaaaaaaaaaaaaaaa", "abc<|endoftext|>def <|startoftext|>", "<|ENDOFTEXT|>", "12345 ١٢٣", "a\u0085b c​d\x1c\x1fe",
    "x" * 5000, "éêèç ouauxelle", "ﬀ ß ẞ", "!!!???...---", "'''s't''re", "\x00\x01", "supercalifragilisticexpialidocious",
]


@pytest.fixture(scope="module")
def ours():
    with open(VOCABULARY, encoding="utf-8") as f:
        return bpe.Tokenizer(json.load(f))


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(VOCABULARY)


def same(ours, library, texts):
    wanted = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    got = ours.encode_batch(texts)
    for text, w, g in zip(texts, wanted, got, strict=True):
        assert np.frombuffer(g, "<u4").tolist() == w, text
        assert ours.decode(g) == library.decode(w, skip_special_tokens=False), text


def test_texts_as_the_library(ours, library):
    same(ours, library, PLAIN)


def test_random_texts_as_the_library(ours, library):
    rng = random.Random(1)
    letters = "abcdeéñßaaaatttthhheeiinn  '.,-0159\nΣσ漢"
    same(ours, library, ["".join(rng.choices(letters, k=rng.randint(1, 120))) for _ in range(3000)])
    syllables = ["th", "er", "in", "tion", "ou", "aux", "ent", "ing", "ly", "re", "an", "ción", "ll", "s"]
    same(ours, library, [" ".join("".join(rng.choices(syllables, k=rng.randint(1, 7))) for _ in range(40)) for _ in range(500)])


def test_most_words_need_no_merging(ours):
    fresh = bpe.Tokenizer.__new__(bpe.Tokenizer)
    fresh.__dict__.update(ours.__dict__, known={}, exact_words=0)
    words = [t.removesuffix("</w>") for t in list(ours.ids)[1000:6000] if t.isascii() and t.removesuffix("</w>").isalpha()]
    fresh.encode_batch([" ".join(words)])
    assert 0 <= fresh.exact_words < 0.2 * len(words)


def test_every_token_splits_as_its_merges(ours):
    # a proposal may use a token only if the token's own text merges into it
    for text in random.Random(2).sample(list(ours.inner), 300):
        whole = ours.merge(text + "x")
        assert isinstance(whole, list)
    for text in random.Random(3).sample(list(ours.final), 300):
        assert ours.merge(text) == [ours.final[text]]


def test_frame(spark):
    docs = spark.createDataFrame(
        [(1, "Hello hello", "x"), (2, None, "y"), (2, "", None), (None, "a", "z")], "doc_id long, text string, ids string"
    )
    rows = bpe.encode(docs, VOCABULARY, digests=True, decoded=True)
    assert rows.columns[:3] == ["doc_id", "text", "n_tokens"]
    got = {(r.doc_id, r.n_tokens, r.decoded) for r in rows.collect()}
    assert got == {(1, 2, "hello</w> hello</w>"), (2, 0, ""), (None, 1, "a</w>")}
    assert bpe.encode(docs.limit(0), VOCABULARY).count() == 0
