"""Searches in one task's map: nothing written per source, the same rows as by rounds."""

import pytest

from roundsman.operators import reach
from roundsman.operators import regions as G
from roundsman.operators import roads as R


@pytest.fixture(scope="module")
def grid(spark):
    """30 rows of 4 nodes, some turns closed; the last node has no place."""
    def at(r, c):
        return r * 4 + c

    steps = [(r, c, r + a, c + b) for r in range(30) for c in range(4) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))]
    edges = [
        (k, at(r, c), at(x, y), float(5 + (r * 31 + y * 17) % 9)) for k, (r, c, x, y) in enumerate(steps) if 0 <= x < 30 and 0 <= y < 4
    ]
    turns = [(a[0], b[0]) for a in edges for b in edges if a[2] == b[1] and b[2] != a[1] and (a[1] + b[2]) % 5]
    nodes = [(n, 48 + n // 4 / 100, 5 + n % 4 / 100) for n in range(119)]
    return (
        spark.createDataFrame(nodes, "node long, lat double, lon double"),
        spark.createDataFrame(edges, "e long, u long, v long, w float"), spark.createDataFrame(turns, "e long, f long"),
    )


def test_nothing_is_written_per_source(spark, grid, monkeypatch):
    """Every node as a source: rows of state follow the regions, not the sources."""
    written = []

    def watched(df, cut=G.cut_lineage):
        done = cut(df)
        if "d" in done.columns:
            written.append(done.where("d IS NOT NULL").count())
        return done

    monkeypatch.setattr(G, "cut_lineage", watched)
    monkeypatch.setattr(G, "REGION_NODES", 12)
    nodes, edges, turns = grid
    R.shortest_times(nodes.select(nodes.node.alias("source")), edges, turns, 40.0).count()
    assert 0 < sum(written) < 120


def rows(grid, spark, points):
    nodes, edges, turns = grid
    pairs = spark.createDataFrame([(a, b) for a in (0, 38, 81) for b in range(0, 120, 9)], "source long, target long")
    spots = spark.createDataFrame(points, "tour_id long, i long, node long")
    stops = spark.createDataFrame(
        [(t, p, 48 + r / 100, 5 + c / 100, True) for t in range(2) for p, (r, c) in enumerate([(t, 0), (t + 9, 3), (t + 2, 1), (29, 3)])],
        "tour_id long, pos long, lat double, lon double, done boolean",
    )
    return [
        sorted(map(tuple, df.collect()), key=repr) for df in (
            R.shortest_paths(pairs, edges, turns, 80.0), R.time_matrix(spots, edges, turns, 80.0),
            R.route_segments(stops, nodes, edges, turns, 80.0),
        )
    ]


def test_maps_and_rounds_agree(spark, grid, monkeypatch):
    """A group whose map is too large for a task is searched by rounds, with the same rows."""
    points = [(t, i, (t * 13 + i * 29) % 121) for t in range(2) for i in range(4)] + [(7, 0, None)]
    monkeypatch.setattr(G, "REGION_NODES", 40)
    by_map = rows(grid, spark, points)
    monkeypatch.setattr(reach, "MAP_EDGES", 300)
    assert rows(grid, spark, points) == by_map


def test_matrix_in_lists_holds_the_same_links(spark, grid, monkeypatch):
    """Lists cut short, sources asked for in several lots, nodes unknown or missing: the pairs of a plain join."""
    from roundsman.operators.ordering import link_rows

    _, edges, turns = grid
    points = [(t, i, (t * 13 + i * 29) % 121) for t in range(5) for i in range(4)] + [(7, 0, None), (7, 1, 3), (8, 0, 3), (8, 0, 40), (None, 0, 3)]
    spots = spark.createDataFrame(points, "tour_id long, i long, node long")
    monkeypatch.setattr(G, "REGION_NODES", 40)
    monkeypatch.setattr(R, "LIST", 3)
    monkeypatch.setattr(reach, "_ASKED", 4)
    found = R.shortest_times(spots.selectExpr("node AS source"), edges, turns, 80.0).collect()
    times = {(r["source"], r["node"]): r["seconds"] for r in found}
    wanted = sorted(
        (t, i, j, times.get((a, b), float("inf"))) for t, i, a in points for u, j, b in points if t == u and t is not None
    )
    lists = R.time_matrix(spots, edges, turns, 80.0, lists=True)
    assert max(len(r["j"]) for r in lists.collect()) == 3
    assert sorted(map(tuple, link_rows(lists).collect())) == wanted
    assert sorted(map(tuple, R.time_matrix(spots, edges, turns, 80.0).collect())) == wanted


def test_edges_pass_on_nearest_first(monkeypatch):
    """A long street with a slow way beside it: every edge passes on about once, not once per improvement."""
    import numpy as np

    n = 200
    here = G.Region.__new__(G.Region)
    here.e = np.arange(n)
    # from each edge to the next in 1 s, and to the one after that in 5 s: fewer turns, but slower
    turns = sorted([(k + 1, k, 1.0) for k in range(n - 1)] + [(k + 2, k, 5.0) for k in range(n - 2)])
    to, start, w = (np.array(c) for c in zip(*turns))
    here.turn_to, here.turn_from, here.turn_w = to, start, w
    passed = []
    least = G._least
    monkeypatch.setattr(G, "_least", lambda rows, starts: passed.append(len(rows)) or least(rows, starts))
    d = np.full((n, 1), np.inf)
    d[0] = 0.0
    here.relax(d, np.array([1000.0]), None)
    assert (d[:, 0] == np.arange(n)).all()
    assert sum(passed) < 4 * len(turns)


def test_nodes_out_of_the_map_do_not_prolong_a_search(spark, grid, monkeypatch):
    """A target no edge of the map leads to is out of reach: the source stops at its farthest other target."""
    _, edges, turns = grid
    ended = []

    class Watched(reach.Map):
        def search(self, seeds, targets, max_s):
            d = super().search(seeds, targets, max_s)
            ended.append((d < float("inf")).mean())
            return d

    monkeypatch.setattr(G, "REGION_NODES", 200)
    pairs = spark.createDataFrame([(0, 1), (0, 999)], "source long, target long")
    found = reach.Reach(pairs.select("source"), edges, turns, 3600.0, targets=pairs)
    rows = found.copies.unionByName(found.work, allowMissingColumns=True).sort("source").toArrow().to_batches()
    step = reach._times_step(3600.0)
    monkeypatch.setattr(reach, "Map", Watched)
    monkeypatch.setattr(G, "_BOUND_STEPS", 1)
    got = [b.to_pylist() for b in reach._mapped(step, 32, 1 << 20)(rows)]
    assert [r["node"] for rows in got for r in rows] == [1]
    assert ended[0] < 0.5
