import random
import re

import numpy as np
import pytest

from roundsman.llm import jaccard_join

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 4:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 4]) for i in range(len(words) - 3)}


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(LETTERS, k=rng.randint(1, 6)))
    passage = [word() for _ in range(60)]
    texts = [None, "", "  \t", "one", "ONE", "one two three", "One  two\nthree", "a b c d", "a b c d", "a b c d e"]
    for group in range(12):
        base = [word() for _ in range(rng.choice([5, 30, 150, 400]))]
        for _ in range(rng.choice([1, 2, 5, 40])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 60))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
        if group % 3 == 0:
            texts += [" ".join([word() for _ in range(80)] + passage) for _ in range(20)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed,grams", [(1, 2_000_000), (2, 3_000)])
def test_components_as_brute_force(spark, monkeypatch, seed, grams):
    monkeypatch.setattr(jaccard_join, "FRAGMENT_GRAMS", grams)
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, same string").repartition(5)
    got = {r.id: (r.n, r.component) for r in jaccard_join.join(docs).collect()}
    assert got == brute(rows)


def test_large_group_needs_few_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PIVOT_GROWTH", 2)
    rng = random.Random(5)
    base = ["w%d" % i for i in range(200)]
    rows = []
    for i in range(120):
        copy = list(base)
        copy[rng.randrange(200)] = "x%d" % i
        copy[rng.randrange(200)] = "y%d" % i
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: (r.n, r.component) for r in jaccard_join.join(docs).collect()}
    assert got == brute(rows)


def test_nothing_to_join(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.join(docs).count() == 0
    docs = spark.createDataFrame([(3, None), (4, "")], "doc_id long, text string")
    assert sorted(jaccard_join.join(docs).collect()) == [(3, 0, 3), (4, 0, 4)]


def test_fragments_leave_a_group_one_by_one():
    fragments, each = jaccard_join.FRAGMENTS_PER_TASK, 500
    rng = np.random.default_rng(3)
    spots = np.repeat(np.arange(fragments, dtype=np.uint64), each)
    gram = spots * np.uint64(2**64 // fragments) + np.uint64(1)
    gram += rng.integers(0, 50, len(gram)).astype(np.uint64)
    low, high = gram.astype(np.uint32), (gram >> np.uint64(32)).astype(np.uint8)
    names = np.array([7, 8], np.int64)
    per = np.full((fragments, 2), each // 2)
    table = jaccard_join._rows([
        (0, 0, names.tobytes(), low.tobytes(), high.tobytes(), jaccard_join._squeeze(np.full(2, 1000), per))
    ])
    batches = jaccard_join._count(fragments, table)
    assert [sorted({r["key"] for r in b.to_pylist() if r["kind"] == 0}) for b in batches] == [[k] for k in range(fragments)]
