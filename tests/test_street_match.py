"""Block comparison of streets against comparing every pair."""

import random

import numpy as np

from roundsman.operators import geocode as G
from roundsman.operators.street_match import compare, edit_distances, spelled


def distance(a, b):
    line = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        line, before = [i], line
        for j, y in enumerate(b, 1):
            line.append(min(before[j] + 1, line[-1] + 1, before[j - 1] + (x != y)))
    return line[-1]


def grams(s):
    padded = f"  {s} "
    return {padded[i : i + 3] for i in range(len(s) + 1)}


def similarity(a, b):
    if not a or not b:
        return 0.0
    both = len(grams(a) & grams(b))
    return (1.0 - distance(a, b) / max(len(a), len(b))) * 0.5 + both / (len(grams(a)) + len(grams(b)) - both) * 0.5


def streets(rng, n):
    parts = ["mou", "lin", "vi", "eux", "pont", "ch", "amps", "gare", "lac", "bo", "is", "fon", "taine", "or", "me"]
    kinds = ["rue", "avenue", "place", "rue de la"]
    names = {f"{rng.choice(kinds)} {''.join(rng.choices(parts, k=6))}" for _ in range(-(-n // 5))}
    return sorted(f"{name} {end}" for name in names for end in ("a", "b", "c", "d", "e"))[:n]


def misspelt(rng, s):
    at = rng.randrange(len(s) + 1)
    return rng.choice([s, s[:at] + s[at + 1 :], s[:at] + "x" + s[at:], s[:at] + "3" + s[at + 1 :], s.replace("e", "")])


def test_distances():
    rng = random.Random(1)
    left = ["", "a", "été", "rue"] + streets(rng, 40)
    right = [misspelt(rng, rng.choice(left)) for _ in left]
    got = edit_distances(*spelled(left), *spelled(right))
    assert got.tolist() == [distance(a, b) for a, b in zip(left, right)]


def test_the_best_of_every_query_are_kept_with_few_distances():
    rng = random.Random(7)
    groups = []
    for n in (150, 3, 40, 1):
        offered = streets(rng, n) + ([""] if n == 40 else [])
        groups.append(([misspelt(rng, rng.choice(offered)) for _ in range(30)] + ["", "zzz"], offered))
    query, street, score, edits = compare(groups, 5)
    found = {}
    for q, s, x in zip(query.tolist(), street.tolist(), score.tolist()):
        found.setdefault(q, set()).add((s, x))
    q = first = pairs = 0
    for asked, offered in groups:
        for text in asked:
            every = sorted(((similarity(text, o), -(first + i)) for i, o in enumerate(offered)), reverse=True)
            least = every[min(5, len(every)) - 1][0]
            # all that reach the fifth similarity, and nothing less
            assert found[q] == {(-i, x) for x, i in every if x >= least}
            q += 1
            pairs += len(offered)
        first += len(offered)
    assert edits < pairs / 2


def test_blocks_of_a_pool(spark, monkeypatch):
    monkeypatch.setattr(G, "BLOCK_STREETS", 8)
    rng = random.Random(3)
    offered = streets(rng, 60)
    asked = sorted({misspelt(rng, s) for s in offered})
    shelves = spark.createDataFrame([("p", "*", s, [(i,)]) for i, s in enumerate(offered)], "pool string, facet string, street string, shelf array<struct<id:long>>")
    wanted = spark.createDataFrame([("p", "*", s) for s in asked] + [("none", "*", "rue")], "pool string, facet string, q_street string")
    rows = G.best_streets(wanted, shelves, 3).collect()
    assert 0 < sum(r.edits for r in rows) <= len(asked) * len(offered)
    for text in asked:
        got = sorted(((r.similarity, -r.first_id) for r in rows if r.q_street == text), reverse=True)[:3]
        assert got == sorted(((similarity(text, o), -i) for i, o in enumerate(offered)), reverse=True)[:3]
    assert np.all([r.street == offered[r.first_id] for r in rows])
