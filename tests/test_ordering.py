"""Orders against a plain nearest-neighbour walk and scan-order 2-opt."""

import math
import random

import pytest

from roundsman.operators import ordering as O

X = math.inf


def walk(m, points, fixed):
    left, order, here = [p for p in points if p not in (0, fixed)], [], 0
    while left:
        best = min(left, key=lambda p: (m[here][p], p))
        if m[here][best] == X:
            order += left
            break
        order.append(best)
        left.remove(best)
        here = best
    return order + ([fixed] if fixed is not None else [])


def cost(order, m, noon, w):
    total, here = 0.0, 0
    for k, p in enumerate(order):
        total += m[here][p] + (k * w if p in noon else 0)
        here = p
    return total


def improve(order, m, noon, w, lock):
    order, n = list(order), len(order) - lock
    best, better = cost(order, m, noon, w), n >= 4
    while better:
        better = False
        for i in range(n - 1):
            for j in range(i + 1, n):
                trial = order[:i] + order[i : j + 1][::-1] + order[j + 1 :]
                c = cost(trial, m, noon, w)
                if c < best - 1e-9:
                    order, best, better = trial, c, True
    return order


@pytest.fixture(scope="module")
def tours():
    rng = random.Random(21)
    made = {}
    for t in range(12):
        n = rng.choice([2, 3, 5, 6, 8, 9])
        m = [[0 if a == b else (X if rng.random() < (0.3 if t % 4 == 0 else 0.0) else rng.randint(1, 500)) for b in range(n)] for a in range(n)]
        noon = {p for p in range(1, n) if rng.random() < 0.3}
        made[t] = (m, noon, n - 1 if t % 2 and n > 2 else None)
    return made


@pytest.fixture(scope="module")
def tables(spark, tours):
    links = [(t, i, j, float(s)) for t, (m, _, _) in tours.items() for i, row in enumerate(m) for j, s in enumerate(row)]
    points = [(t, i, i in noon, i == end) for t, (m, noon, end) in tours.items() for i in range(len(m))]
    return (
        spark.createDataFrame(points, "tour_id long, i long, avant12h boolean, fixed_end boolean"),
        spark.createDataFrame(links, "tour_id long, i long, j long, seconds double"),
    )


def orders(df):
    out = {}
    for r in df.orderBy("tour_id", "pos").collect():
        out.setdefault(r["tour_id"], []).append((r["pos"], r["i"]))
    assert all([p for p, _ in rows] == list(range(len(rows))) for rows in out.values())
    return {t: [i for _, i in rows] for t, rows in out.items()}


@pytest.mark.parametrize("limit", [256, 0])
def test_walk(tours, tables, monkeypatch, limit):
    monkeypatch.setattr(O, "SMALL_TOUR", limit)
    assert orders(O.nearest_neighbor(*tables)) == {t: walk(m, range(len(m)), end) for t, (m, _, end) in tours.items()}


@pytest.mark.parametrize("limit", [256, 0])
def test_optimize(tours, tables, monkeypatch, limit):
    if limit == 0:  # the per-round way takes a while, so on a few tours
        tables = [df.where("tour_id < 3") for df in tables]
        tours = {t: v for t, v in tours.items() if t < 3}
    monkeypatch.setattr(O, "SMALL_TOUR", limit)
    got = O.optimize(*tables, 60.0)
    expected = {
        t: improve(walk(m, range(len(m)), end), m, noon, 60.0, 0 if end is None else 1) for t, (m, noon, end) in tours.items()
    }
    assert orders(got) == expected
    for r in got.collect():
        order = expected[r["tour_id"]]
        before = order[r["pos"] - 1] if r["pos"] else 0
        assert r["seconds"] == tours[r["tour_id"]][0][before][r["i"]]


def test_mixed_sizes(tours, tables, monkeypatch):
    monkeypatch.setattr(O, "SMALL_TOUR", 6)
    assert orders(O.nearest_neighbor(*tables)) == {t: walk(m, range(len(m)), end) for t, (m, _, end) in tours.items()}


def test_tasks_cut_between_tours(tours, tables, monkeypatch):
    from roundsman.operators import batch_order

    monkeypatch.setattr(batch_order, "_ROWS", 40)
    monkeypatch.setattr(batch_order, "_CELLS", 100)
    assert orders(O.nearest_neighbor(*tables)) == {t: walk(m, range(len(m)), end) for t, (m, _, end) in tours.items()}


def test_cost(spark, tours, tables):
    points, matrix = tables
    plain = points.where("i > 0").selectExpr("tour_id", "i - 1 AS pos", "i", "avant12h")
    got = {r["tour_id"]: r["cost"] for r in O.tour_cost(plain, matrix, 60.0).collect()}
    assert got == {t: cost(range(1, len(m)), m, noon, 60.0) for t, (m, noon, _) in tours.items()}


def test_long_tours_one_at_a_time(tours, tables, monkeypatch):
    """Same orders by the row-wise way that long tours take."""
    from roundsman.operators import batch_order

    monkeypatch.setattr(batch_order, "LONG", 0)
    expected = {
        t: improve(walk(m, range(len(m)), end), m, noon, 60.0, 0 if end is None else 1) for t, (m, noon, end) in tours.items()
    }
    assert orders(O.optimize(*tables, 60.0)) == expected


@pytest.mark.parametrize("share, lock, most", [(0.0, 0, None), (0.05, 1, None), (0.0, 1, 7), (0.3, 0, None)])
def test_row_wise_scan(share, lock, most):
    """Forty stops against re-pricing every reversal, and as many as it takes against all reversals at once."""
    import numpy as np

    from roundsman.operators import batch_order

    rng = random.Random(4)
    for n in (41, 12, 4):
        m = [[0 if a == b else (X if rng.random() < share else rng.randint(1, 500)) for b in range(n)] for a in range(n)]
        noon = {p for p in range(1, n) if rng.random() < 0.2}
        first = walk(m, range(n), n - 1 if lock else None)
        flags, cost_of = np.array([p in noon for p in range(n)]), np.array(m, float)
        got = batch_order.improve_one(cost_of, np.array(first), n - 1 - lock, flags, 60.0, 1e-9, 4, most)
        together = np.array([first])
        batch_order.two_opt(cost_of[None], together, np.array([n - 1]), np.array([n - 1 - lock]), flags[None], 60.0, 1e-9, 4, most)
        assert got.tolist() == together[0].tolist()
        if most is None:
            assert got.tolist() == improve(first, m, noon, 60.0, lock)


def test_a_tour_above_the_boundary(spark):
    """Three hundred stops through the operator: a permutation no reversal improves."""
    import numpy as np

    n = 301
    points = spark.range(n).selectExpr("1L AS tour_id", "id AS i", "id % 9 = 1 AS avant12h", "id = 300 AS fixed_end")
    cost_of = lambda a, b: 0.0 if a == b else float(30 + (a * 3701 + b * 9103 + a * b * 17) % 601)
    matrix = spark.range(n).crossJoin(spark.range(n).withColumnRenamed("id", "j")).selectExpr(
        "1L AS tour_id", "id AS i", "j", "CASE WHEN id = j THEN 0D ELSE CAST(30 + (id * 3701 + j * 9103 + id * j * 17) % 601 AS DOUBLE) END AS seconds"
    )
    order = orders(O.optimize(points, matrix, 60.0))[1]
    assert sorted(order) == list(range(1, n)) and order[-1] == 300
    start = orders(O.nearest_neighbor(points, matrix))[1]
    m = [[cost_of(a, b) for b in range(n)] for a in range(n)]
    noon = {p for p in range(n) if p % 9 == 1}
    assert cost(order, m, noon, 60.0) < cost(start, m, noon, 60.0)
    from roundsman.operators import batch_order

    together = np.array([start])
    flags = np.array([p in noon for p in range(n)])
    batch_order.two_opt(np.array(m)[None], together, np.array([n - 1]), np.array([n - 2]), flags[None], 60.0, 1e-9, 4, 40)
    one = batch_order.improve_one(np.array(m), np.array(start), n - 2, flags, 60.0, 1e-9, 4, 40)
    assert one.tolist() == together[0].tolist()
