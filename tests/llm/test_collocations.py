"""Phrase counts, unary paths and scores against plain counting."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from roundsman.llm import collocations as C

SCHEMA = "text string, lang string, score string"


def plain_counts(rows, longest):
    counts, total = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        lower = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    counts[lang, " ".join(words[i : i + m])] += 1
    return counts, total


def plain(rows, longest, least, top):
    counts, total = plain_counts(rows, longest)
    found = {}
    often = {key: f for key, f in counts.items() if f >= least and " " in key[1]}
    for (lang, phrase), a in often.items():
        words = phrase.split(" ")
        if any(
            at == lang and 100 * f >= 50 * a and len(w := longer.split(" ")) > len(words)
            and any(w[i : i + len(words)] == words for i in range(len(w)))
            for (at, longer), f in often.items()
        ):
            continue
        cuts = []
        for k in range(1, len(words)):
            l, r = counts[lang, " ".join(words[:k])], counts[lang, " ".join(words[k:])]
            cuts.append((1_000_000 * a * a // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        found.setdefault(lang, []).append((-score, -a, phrase.encode(), (phrase, a, l, r, total[lang], score)))
    return {(lang, rank, *row[3]) for lang, all_ in found.items() for rank, row in enumerate(sorted(all_)[:top], 1)}


def got(spark, rows, longest, least, top=2000):
    df = spark.createDataFrame([(*r, "mine") for r in rows], SCHEMA)
    return {(r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in C.collocations(df, longest, least, top=top).collect()}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = ["a", "b", "B", "a\x01", "é", "É", "c d", "the", "\x00", "x"]
    texts = [
        "".join(rng.choice(words) + rng.choice([" "] * 8 + ["  ", "\t", ". ", ",", "\n", "!?"]) for _ in range(rng.randrange(0, 120)))
        for _ in range(60)
    ]
    rows = [(t, rng.choice(["en", "fr", None])) for t in texts] + [(None, "en"), ("", None), (" .,", "de"), ("alone", "de")]
    return rows + [("one passage that many share word for word", "en")] * 12


@pytest.mark.parametrize("longest, least", [(3, 10), (2, 4), (4, 3)])
def test_as_plain_counting(spark, corpus, longest, least):
    assert got(spark, corpus, longest, least) == plain(corpus, longest, least, 2000)
    assert got(spark, corpus, longest, least, 3) == plain(corpus, longest, least, 3)


def test_hot_words_change_the_plan_only(spark, corpus, monkeypatch):
    monkeypatch.setattr(C, "SAMPLE", 1)
    monkeypatch.setattr(C, "HOT_SHARE", 1 / 40)
    monkeypatch.setattr(C, "CHUNK", 300)
    assert got(spark, corpus, 3, 4) == plain(corpus, 3, 4, 2000)
    counts, total = plain_counts(corpus, 3)
    df = spark.createDataFrame([(*r, "") for r in corpus], SCHEMA)
    want = {(*k, n) for k, n in counts.items() if n >= 4} | {(k, "", n) for k, n in total.items() if n}
    assert {(r.lang, r.phrase, r.n) for r in C.phrase_counts(df, 3, 4).collect()} == want


def test_paths(spark):
    rows = [("v w x y z", None)] * 10 + [("q w x", "und")] * 10
    counts = C.phrase_counts(spark.createDataFrame([(*r, "") for r in rows], SCHEMA), 3, 10)
    paths = {(r.phrase, r.path, r.pos, r.inner) for r in C.unary_paths(counts, 3).collect()}
    # "w x" also ends "q w x", so the passage "v w x" stops there; "x y" has one way in and out
    assert paths == {("v w x", "v w x", 0, False), ("q w x", "q w x", 0, False), ("w x y", "w x y", 0, False), ("x y z", "w x y", 1, True)}
    docs = spark.createDataFrame([(*r, "") for r in rows], SCHEMA)
    assert {r.phrase: r.path_words for r in C.collocations(docs).collect()}["x y z"] == 4


def test_long_texts_and_empty_tables(spark):
    docs = spark.createDataFrame([("la la. " * 200_000, "fr", "")], SCHEMA)
    assert [tuple(r) for r in C.collocations(docs).select("phrase", "a", "l", "r", "n", "score").collect()] == [
        ("la la", 200_000, 400_000, 400_000, 400_000, 250_000)
    ]
    one_piece = spark.createDataFrame([("la " * 100_000, "fr", "")], SCHEMA)
    assert C.collocations(one_piece).select("phrase", "a").collect() == [("la la la", 99_998)]
    assert C.collocations(docs.limit(0)).isEmpty()
    # counts beyond 64-bit products
    big = docs.select(F.lit(10**15).alias("a"))
    assert big.select(F.expr("(cast(1000000 as decimal(7,0)) * (cast(a as decimal(19,0)) * cast(a as decimal(19,0)))) div (cast(a as decimal(19,0)) * cast(a as decimal(19,0)))")).first()[0] == 1_000_000
