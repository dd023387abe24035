import hashlib
import random
import re
from collections import Counter

import pytest

from roundsman.llm import substring_dedup, superkmers


def brute(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = {p for k in range(len(w) - window + 1) if seen[tuple(w[k : k + window])] > 1 for p in range(k, k + window)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, vocabulary=400):
    rng = random.Random(seed)
    names = ["".join(rng.choices("abcdeéñ漢", k=rng.randint(1, 7))) for _ in range(vocabulary)]
    some = lambda n: rng.choices(names, k=n)
    passages = [some(60), some(35), some(34), some(300)]
    texts = [None, "", " \n ", "word", " ".join(["same"] * 500), " ".join(["a", "b"] * 60)]
    for _ in range(60):
        parts = some(rng.randint(0, 200))
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(parts))
            parts[at:at] = rng.choice(passages)
        texts.append(rng.choice([" ", "\n", "  "]).join(parts))
    texts += [texts[10]] * 5 + [texts[11] + " tail", "x " + texts[12]]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed,run,vocabulary", [(1, 512, 400), (2, 7, 400), (3, 512, 3)])
def test_as_brute_force(spark, monkeypatch, seed, run, vocabulary):
    monkeypatch.setattr(superkmers, "MAX_RUN", run)
    rows = corpus(seed, vocabulary)
    rows += [rows[9], (9, "other text of the same id"), (None, "no id")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string").repartition(4)
    got = sorted(map(tuple, substring_dedup.removed(docs).collect()), key=str)
    assert got == brute(rows, 35)


def test_kept_text_and_nothing(spark):
    docs = spark.createDataFrame([(1, "a  b\tc"), (2, None)], "doc_id long, text string")
    assert sorted(r.kept for r in substring_dedup.removed(docs, kept_text=True).collect()) == ["", "a b c"]
    assert substring_dedup.removed(docs.limit(0)).count() == 0


def test_many_equal_rows_bring_their_ranges_once(spark):
    """Rows equal in id and text: as many results, and no more ranges than one row has."""
    from roundsman.llm.superkmers import Units, keyed, repeated
    from roundsman.llm.substring_dedup import GRAM, _judge, removed

    text = " ".join(f"w{i}" for i in range(300))
    rows = [(1, text)] * 1500 + [(2, "other " * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = repeated(keyed(docs, "doc_id", "text"), Units(True, 35, GRAM), _judge(35)).collect()
    assert len(found) == 1 and 0 < len(found[0].spans) < 100
    got = removed(docs).groupBy("id", "n_words", "n_removed").count().collect()
    assert sorted(map(tuple, got)) == [(1, 300, 300, 1500), (2, 20, 0, 1)]
