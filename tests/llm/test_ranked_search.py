"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import pytest

from roundsman.llm import ranked_search as R

DOCS, ITEMS = "doc_id long, text string, score string, key string", "item_id string, text string, rank string"


def terms(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def plain(docs, items, top=10):
    split = [(key, terms(text)) for key, text in docs]
    n_docs, n_terms = sum(bool(w) for _, w in split), sum(len(w) for _, w in split)
    df = Counter(t for _, w in split for t in set(w))
    out = []
    for item, text in items:
        scored = []
        for key, words in split:
            tf = Counter(words)
            score = 0
            for t in terms(text):
                if tf[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * (25 + 75 * len(words) * n_docs // n_terms)))
            if score > 0:
                scored.append((-score, key is not None, key or 0, key))
        out += [(item, rank, key, -score) for rank, (score, _, _, key) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def got(spark, docs, items, top=10):
    d = spark.createDataFrame([(*x, "mine", "k") for x in docs], DOCS)
    i = spark.createDataFrame([(*x, "own") for x in items], ITEMS)
    return sorted(map(tuple, R.rank(d, i, top).collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    weight = [1 / (i + 1) for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, weight, k=rng.randrange(1, 60)))) for i in range(400)]
    docs += [(7, "W1 w1 É-é é"), (7, "W1 w1 É-é é"), (None, "w59 w58"), (None, "w59 w58"), (901, None), (902, ""), (903, " -! "), (904, "w3 " * 30_000)]
    items = [(f"i{j}", " ".join(rng.choices(words, k=rng.randrange(1, 12)))) for j in range(25)]
    return docs, items + [("same", "w1 w40 w40"), ("same", "w1 w40 w40"), (None, "É w2"), ("none", None), ("", ""), ("unknown", "nowhere")]


def test_as_scoring_all(spark, corpus, monkeypatch):
    docs, items = corpus
    assert got(spark, docs, items) == plain(docs, items)
    # many segments, windows and blocks of items
    monkeypatch.setattr(R, "SEGMENT", 5000)
    monkeypatch.setattr(R, "WINDOW", 16)
    monkeypatch.setattr(R, "QUERY_BLOCK", 200)
    assert got(spark, docs, items, 3) == plain(docs, items, 3)


@pytest.mark.parametrize("short", [0.0, 1 / 16, 1.0])
def test_share_of_short_lists_changes_nothing(corpus, short, monkeypatch):
    docs, items = corpus
    monkeypatch.setattr(R, "SHORT", short)
    monkeypatch.setattr(R, "WINDOW", 32)
    import pyarrow as pa

    vocabulary, queries = R._query_block([{"text": t or ""} for _, t in items])
    batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in docs], pa.int64()), pa.array([t for _, t in docs])], ["id", "text"])
    (segment,) = list(R._segments(vocabulary)([batch]))
    row = segment.to_pylist()[0]
    df = dict(zip(row["terms"], row["df"]))
    weights = R.np.array([math.floor(1000 * math.log((2 * row["n_docs"] + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(vocabulary))])
    held = R.Lists(row, weights, row["n_docs"], row["n_terms"])
    want = {}
    for item, rank, key, score in plain(docs, [(str(n), t) for n, (_, t) in enumerate(items)], 5):
        want.setdefault(int(item), []).append((rank, score, key))
    for number, query in queries:
        found = [(score, row["ids"][doc]) for score, doc in R.search(held, query, 5)]
        assert found == [(s, k) for _, s, k in sorted(want.get(number, []))]


def test_empty_tables(spark):
    assert got(spark, [], [("a", "b")]) == [] and got(spark, [(1, "b")], []) == []
    assert got(spark, [(1, None), (2, "-")], [("a", "b")]) == []
    assert got(spark, [(2, "x y"), (1, "x y"), (3, "z")], [("a", "x")]) == plain([(2, "x y"), (1, "x y"), (3, "z")], [("a", "x")])
