"""Travel times and paths: golden matrix, then a plain search on random graphs."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from roundsman.operators import roads as R

X = math.inf
GOLDEN = [
    [0, 6.671695709, 13.343391418, X, 10.447440624],
    [6.671695709, 0, 6.671695709, X, 3.775744915],
    [13.343391418, 6.671695709, 0, X, 10.447440624],
    [X, 3.775744915, X, 0, 7.551489830],
    [X, X, X, X, 0],
]


def test_golden_matrix(spark, mini):
    _, edges, turns = mini
    points = spark.createDataFrame([("t", i, i) for i in range(5)], "tour_id string, i int, node int")
    got = {(r["i"], r["j"]): r["seconds"] for r in R.time_matrix(points, edges, turns).collect()}
    assert got == {(i, j): pytest.approx(GOLDEN[i][j], abs=1e-6) for i in range(5) for j in range(5)}


def test_paths_respect_the_turn(spark, mini):
    _, edges, turns = mini
    pairs = spark.createDataFrame([(0, 4), (3, 4), (3, 0), (2, 2), (4, 0)], "source int, target int")
    got = {(r["source"], r["target"]): r["nodes"] for r in R.shortest_paths(pairs, edges, turns).collect()}
    assert got == {(0, 4): [0, 1, 4], (3, 4): [3, 1, 4], (3, 0): None, (2, 2): [2], (4, 0): None}


def search(edges, turns, source, limit):
    best, heap = {}, []
    for e, u, _, w in edges:
        if u == source and w <= limit:
            heapq.heappush(heap, (w, e))
    follow = {}
    for e, f in turns:
        follow.setdefault(e, []).append(f)
    by_id = {e[0]: e for e in edges}
    while heap:
        d, e = heapq.heappop(heap)
        if e in best:
            continue
        best[e] = d
        for f in follow.get(e, []):
            if f not in best and d + by_id[f][3] <= limit:
                heapq.heappush(heap, (d + by_id[f][3], f))
    times = {}
    for e, d in best.items():
        v = by_id[e][2]
        times[v] = min(times.get(v, X), d)
    times[source] = 0.0
    return times


@pytest.fixture(scope="module")
def town():
    rng = random.Random(11)
    pairs = {(rng.randrange(14), rng.randrange(14)) for _ in range(50)}
    edges = [(k, u, v, float(rng.randint(1, 9))) for k, (u, v) in enumerate(sorted(pairs)) if u != v]
    turns = [(a[0], b[0]) for a in edges for b in edges if a[2] == b[1] and rng.random() < 0.7]
    return edges, turns


def test_times_on_a_random_graph(spark, town):
    edges, turns = town
    e = spark.createDataFrame(edges, "e int, u int, v int, w float")
    t = spark.createDataFrame(turns, "e int, f int")
    sources = spark.createDataFrame([(i,) for i in range(14)], "source int")
    got = {}
    for r in R.shortest_times(sources, e, t, 20.0).collect():
        got.setdefault(r["source"], {})[r["node"]] = r["seconds"]
    assert got == {s: search(edges, turns, s, 20.0) for s in range(14)}


def test_paths_are_drivable_and_fastest(spark, town):
    edges, turns = town
    e = spark.createDataFrame(edges, "e int, u int, v int, w float")
    t = spark.createDataFrame(turns, "e int, f int")
    pairs = spark.createDataFrame([(a, b) for a in range(14) for b in range(14)], "source int, target int")
    at = {(u, v): (k, w) for k, u, v, w in edges}
    allowed = set(turns)
    for r in R.shortest_paths(pairs, e, t, 30.0).collect():
        best = search(edges, turns, r["source"], 30.0).get(r["target"])
        if r["nodes"] is None:
            assert best is None
            continue
        hops = [at[p] for p in zip(r["nodes"], r["nodes"][1:])]
        assert sum(w for _, w in hops) == best and r["nodes"][0] == r["source"] and r["nodes"][-1] == r["target"]
        assert all((a[0], b[0]) in allowed for a, b in zip(hops, hops[1:]))


@pytest.fixture(params=["one region", "split", "compacted"])
def cut(request, monkeypatch):
    """The same search with the graph and the sources cut in other ways."""
    from roundsman.operators import regions as G

    sizes = {
        "split": {"REGION_NODES": 5, "REGION_EDGES": 4}, "compacted": {"REGION_NODES": 3, "_COMPACT": 2, "SOURCES_PER_PART": 2, "_BLOCK": 2},
    }
    for name, value in sizes.get(request.param, {}).items():
        monkeypatch.setattr(G, name, value)
    return request.param


def ways(edges, turns, source, limit):
    """Times by edge and the lowest edge before each; first edges are not held to the limit."""
    best, follow, w = {}, {}, {e[0]: e[3] for e in edges}
    for a, b in turns:
        follow.setdefault(a, []).append(b)
    heap = [(e[3], e[0]) for e in edges if e[1] == source]
    heapq.heapify(heap)
    while heap:
        d, e = heapq.heappop(heap)
        if e in best:
            continue
        best[e] = d
        for f in follow.get(e, []):
            if d + w[f] <= limit:
                heapq.heappush(heap, (d + w[f], f))
    before = {}
    for a, b in sorted(turns, reverse=True):
        if a in best and b in best and best[a] + w[b] == best[b] and best[b] <= limit:
            before[b] = a
    return best, before


def test_regions_change_nothing(spark, town, cut):
    edges, turns = town
    e = spark.createDataFrame(edges, "e int, u int, v int, w float")
    t = spark.createDataFrame(turns, "e int, f int")
    rng = random.Random(2)
    pairs = [(a, b) for a in range(15) for b in range(15) if rng.random() < 0.3] + [(3, 99), (None, 2), (2, None), (99, 99)]
    found = R.shortest_paths(spark.createDataFrame(pairs, "source int, target int"), e, t, 18.0).collect()
    assert len(found) == len(pairs)
    by_id = {x[0]: x for x in edges}
    for r in found:
        if r.source == r.target:
            assert (r.nodes, r.seconds) == (([r.source], 0.0) if r.source is not None else (None, None))
            continue
        best, before = ways(edges, turns, r.source, 18.0)
        ends = [(d, x) for x, d in best.items() if by_id[x][2] == r.target]
        if not ends:
            assert r.nodes is None and r.seconds is None
            continue
        d, at = min(ends)
        way = [by_id[at][2]]
        while at in before:
            at = before[at]
            way.append(by_id[at][2])
        assert (r.nodes, r.seconds) == ([r.source, *way[::-1]], d)
    times = R.shortest_times(spark.createDataFrame([(i,) for i in (*range(14), None)], "source int"), e, t, 20.0).collect()
    assert {(r.source, r.node): r.seconds for r in times} == {
        (s, n): d for s in range(14) for n, d in search(edges, turns, s, 20.0).items()
    }


def test_ways_without_length(spark):
    """Edges of no length tie with the ones before them; the way back still ends."""
    edges = [(0, 0, 1, 2.0), (1, 1, 2, 0.0), (2, 2, 1, 0.0), (3, 2, 3, 1.0), (4, 1, 2, 0.0)]
    turns = [(a[0], b[0]) for a in edges for b in edges if a[2] == b[1]]
    got = R.shortest_paths(
        spark.createDataFrame([(0, 3), (0, 2), (0, 1), (3, 0)], "source long, target long"),
        spark.createDataFrame(edges, "e int, u int, v int, w float"), spark.createDataFrame(turns, "e int, f int"),
    ).collect()
    assert {r.target: (r.nodes, r.seconds) for r in got} == {3: ([0, 1, 2, 3], 3.0), 2: ([0, 1, 2], 2.0), 1: ([0, 1], 2.0), 0: (None, None)}


def test_a_source_stops_at_its_farthest_target(spark, monkeypatch):
    """A long road in many regions: rounds follow the target's distance, not the road's length."""
    from roundsman.operators import regions as G

    monkeypatch.setattr(G, "REGION_NODES", 10)
    n = 200
    edges = spark.createDataFrame([(i, i, i + 1, 1.0) for i in range(n)], "e int, u int, v int, w float")
    turns = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "e int, f int")
    near = spark.createDataFrame([(0, 5), (0, 25)], "source int, target int")
    search = G.Search(near.select("source"), edges, turns, 3600.0, targets=near)
    # three regions, and a last round that the bound leaves empty
    assert search.rounds == 4
    assert {(r.node, r.seconds) for r in search.arrivals().collect()} == {(5, 5.0), (25, 25.0)}
    # every round writes the rows of one region only
    assert search.state.count() == 3


def test_route_segments(spark, mini):
    nodes, edges, turns = mini
    tours = spark.createDataFrame(
        [("t", 48.68, 5.89, True, 48.68, 5.89)],
        "tour_id string, depot_lat double, depot_lon double, return_to_depot boolean, return_lat double, return_lon double",
    )
    stops = spark.createDataFrame(
        [("t", 1, "livre", 48.681, 5.89), ("t", 2, "a_livrer", 48.6805, 5.889), ("t", 5, "a_livrer", None, None)],
        "tour_id string, ordre long, statut string, lat double, lon double",
    )
    points = R.route_points(tours, stops)
    legs = {r["leg"]: (len(r["line"]), r["done"]) for r in R.route_segments(points, nodes, edges, turns).collect()}
    # there along three nodes, on along three nodes, and straight back from the dead end
    assert legs == {0: (3, True), 1: (3, False), 2: (2, False)}


def test_link_report(spark):
    nodes = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C"), ("d", "D")], "id string, label string")
    links = spark.createDataFrame(
        [("a", "b", "calls", "INFERRED"), ("c", "zz", "calls", None)], "source string, target string, relation string, confidence string"
    )
    got = {(r["node"], r["direction"], r["other"], r["inferred"]) for r in R.node_link_report(nodes, links).collect()}
    assert got == {("a", "out", "b", True), ("b", "in", "a", True), ("d", "isolated", None, False)}
    assert R.node_link_report(nodes, links).where(F.col("node") == "c").isEmpty()
