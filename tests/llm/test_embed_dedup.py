import numpy as np
import pytest

from roundsman.llm import embed_dedup


def brute(rows, threshold):
    ok = {i: (g, v) for i, v, g in rows if g is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = {i: set() for i, *_ in rows}
    for i, (g, v) in ok.items():
        for j, (h, w) in ok.items():
            if i < j and g == h and len(v) == len(w):
                a, b = np.array(v, np.float64), np.array(w, np.float64)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                    links[i].add(j)
                    links[j].add(i)
    root = {}
    for i in sorted(links):
        stack = [i] if i not in root else []
        while stack:
            k = stack.pop()
            if k not in root:
                root[k] = i
                stack += links[k]
    return {i: (len(links[i]), root[i]) for i in links}


def rows(seed):
    rng = np.random.default_rng(seed)
    out = []
    for group in range(3):
        for size in (1, 1, 1, 2, 5, 60):
            base = rng.standard_normal(16)
            out += [(base + rng.standard_normal(16) * rng.uniform(0, 0.25), group) for _ in range(size)]
        out += [(base, group)] * 40
        out += [(rng.standard_normal(8), group)] * 2
    rows = [(i, [float(np.float32(x)) for x in v], g) for i, (v, g) in enumerate(out)]
    n = len(rows)
    bad = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] + [1.0] * 15]
    rows += [(n + i, v, 0) for i, v in enumerate(bad)] + [(n + 10, rows[0][1], None), (n + 11, rows[0][1], None)]
    return rows


@pytest.mark.parametrize("seed,block", [(1, 512), (2, 7)])
def test_links_as_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    data = rows(seed)
    frame = spark.createDataFrame([(*r, "x") for r in data], "vec_id long, embedding array<float>, label int, rep string")
    got = {r.id: (r.n_links, r.component) for r in embed_dedup.links(frame, recall=0.999999).collect()}
    want = brute(data, 0.93)
    assert got == want


def test_nothing(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embed_dedup.links(frame).count() == 0


def test_shape_grows_slowly():
    k, tables = embed_dedup.shape(5_000, 0.93)
    far_k, far_tables = embed_dedup.shape(5_000_000, 0.93)
    assert k < far_k < 2 * k and tables < far_tables < 30 * tables
