import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from roundsman.llm import suffix_dedup, superkmers


@pytest.mark.parametrize("letters", ["a", "ab", "abc", "abcdefghijklmnop"])
def test_suffix_array_as_sorting(letters):
    rng = random.Random(3)
    for n in [0, 1, 2, 3, 5, 17, 60, 300]:
        for _ in range(20):
            text = "".join(rng.choices(letters, k=n)).encode()
            if rng.random() < 0.4:
                text = text[: n // 3] * 3
            assert suffix_dedup.suffix_array(np.frombuffer(text, np.uint8)) == sorted(range(len(text)), key=lambda i: text[i:])


def brute(rows, window):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i : i + window] for d in data for i in range(len(d) - window + 1))
    out = []
    for (i, _), d in zip(rows, data, strict=True):
        gone = bytearray(len(d))
        for k in range(len(d) - window + 1):
            if seen[d[k : k + window]] > 1:
                gone[k : k + window] = b"\x01" * window
        kept = bytes(c for c, g in zip(d, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    some = lambda n: "".join(rng.choices("abcdeé  漢", k=n))
    passages = [some(250), some(199), some(120), some(900)]
    texts = [None, "", "short", "x" * 700, "ab" * 300, "é" * 100, "line of text\n" * 60]
    for _ in range(40):
        parts = some(rng.randint(0, 1500))
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(parts))
            parts = parts[:at] + rng.choice(passages) + parts[at:]
        texts.append(parts)
    base = some(2500)
    for _ in range(12):  # near copies
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = "#"
        texts.append("".join(copy))
    texts += [texts[10]] * 3 + [texts[11] + "tail"]
    return list(enumerate(texts))


@pytest.mark.parametrize("seed,run,sort", [(1, 512, 1 << 18), (2, 20, 1000)])
def test_as_brute_force(spark, monkeypatch, seed, run, sort):
    monkeypatch.setattr(superkmers, "MAX_RUN", run)
    monkeypatch.setattr(suffix_dedup, "SORTED_BYTES", sort)
    rows = corpus(seed)
    rows += [rows[9], (9, "other"), (None, "no id")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, key string").repartition(4)
    got = sorted(map(tuple, suffix_dedup.removed(docs).collect()), key=str)
    assert got == brute(rows, 200)


def test_nothing(spark):
    docs = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert suffix_dedup.removed(docs, kept_bytes=True).first().kept == b""
    assert suffix_dedup.removed(docs.limit(0)).count() == 0
