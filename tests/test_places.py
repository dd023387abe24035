"""Matching and nearness against brute force in plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from roundsman.functions.text import normalize_city, normalize_street
from roundsman.operators import geocode as G
from roundsman.operators import spatial as P

ADDRESS = "id long, n string, rep string, r string, cp string, c string, lat double, lon double"


def addresses(spark, rows):
    df = spark.createDataFrame(rows, ADDRESS)
    return df.withColumn("rn", normalize_street(F.col("r"))).withColumn("cn", normalize_city(F.col("c")))


def test_same_street_in_four_towns(spark):
    towns = ["Aville-sous-Bois", "Saint-Orme", "Cormeville", "Dornecourt"]
    rows = [(i, "6", "", "Rue de l’Ecluse" if i == 3 else "Rue de l'Ecluse", "54470", c, 48.0, 6.0) for i, c in enumerate(towns)]
    q = spark.createDataFrame([(1, "Rue de l'Ecluse", "54470", "Aville-sous-Bois", "6")], "id int, rue string, cp string, ville string, numero string")
    found = G.match_addresses(q.withColumnRenamed("id", "qid"), addresses(spark, rows)).first()
    assert found["best"]["address"]["c"] == "Aville-sous-Bois"
    assert [round(x["score"], 6) for x in found["candidates"]] == [1.5, 1.15, 1.15, 0.958772]
    assert [x["address"]["id"] for x in found["candidates"]] == [0, 1, 2, 3]


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def sim(a, b):
    if not a or not b:
        return 0.0
    ga, gb = ({f"  {s} "[i : i + 3] for i in range(len(s) + 1)} for s in (a, b))
    return (1 - lev(a, b) / max(len(a), len(b))) * 0.5 + len(ga & gb) / len(ga | gb) * 0.5


def test_match_equals_brute_force_in_a_crowded_postcode(spark):
    rng = random.Random(5)
    words = ["rue", "place", "nord", "sud", "moulin", "eglise", "gare", "port"]
    rows = [
        (i, str(rng.randint(1, 4)), "", " ".join(rng.choices(words, k=rng.randint(1, 3))), rng.choice(["1", "1", "1", "2"]),
         rng.choice(["Aville", "Bville"]), 48.0, 6.0)
        for i in range(300)
    ]
    asked = [
        (k, " ".join(rng.choices(words + ["m0ulin", "eglse"], k=2)), rng.choice(["1", "2", "9"]), rng.choice(["AVILLE", "Bville", ""]),
         rng.choice(["1", "2", ""]))
        for k in range(80)
    ]
    q = spark.createDataFrame(asked, "qid int, rue string, cp string, ville string, numero string")
    got = {r["qid"]: [(round(x["score"], 9), x["address"]["id"]) for x in r["candidates"] or []]
           for r in G.match_addresses(q, addresses(spark, rows)).collect()}
    for k, rue, cp, ville, numero in asked:
        pool = [a for a in rows if a[4] == cp] or [a for a in rows if ville and a[5].lower() == ville.lower()]
        scored = [
            (sim(rue, a[3]) + (0.15 if numero and numero == a[1] else 0.0) + (0.35 if ville and a[5].lower() == ville.lower() else 0.0), a[0])
            for a in pool
        ]
        best = sorted(scored, key=lambda s: (-round(s[0], 12), s[1]))[:5]
        assert got[k] == [(round(s, 9), i) for s, i in best]


def test_search_needs_postcode_and_all_words(spark):
    rows = [(i, str(i), "", "Rue de l'Eglise" if i % 2 else "Rue du Port", "54470", "Toul", 48.0, 6.0) for i in range(1, 31)]
    q = spark.createDataFrame([(1, "eglise 54470 toul"), (2, "eglise"), (3, "1 54470"), (4, "54470")], "qid int, query string")
    got = {}
    for r in G.search_addresses(q, addresses(spark, rows)).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["id"])
    assert got == {1: [1, 3, 5, 7, 9, 11, 13, 15], 3: [1, 10, 11, 12, 13, 14, 15, 16], 4: [1, 2, 3, 4, 5, 6, 7, 8]}


def metres(lat1, lon1, lat2, lon2):
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(
        math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371000 * math.asin(math.sqrt(a))


def grid_nearest(lat, lon, nodes, cell=0.005, widest=80):
    cx, cy = math.floor(lon / cell), math.floor(lat / cell)
    rings = [(max(abs(cx - math.floor(o / cell)), abs(cy - math.floor(a / cell))), metres(lat, lon, a, o), n) for n, a, o in nodes]
    near = [r for r in rings if r[0] <= widest]
    if not near:
        return None
    first = min(r[0] for r in near)
    return min((d, n) for ring, d, n in near if ring <= first + 1)[1]


def test_nearest_node_follows_the_grid(spark):
    rng = random.Random(3)
    nodes = [(i, 48 + rng.random() * 0.06, 6 + rng.random() * 0.06) for i in range(60)] + [(60, 48.5, 6.3)]
    nodes = [(i, float(F32(a)), float(F32(o))) for i, a, o in nodes]
    points = [(i, 47.9 + rng.random() * 0.3, 5.9 + rng.random() * 0.3) for i in range(150)] + [(150, 40.0, 0.0), (151, 48.3, 6.2), (152, -0.001, -0.001)]
    got = P.nearest_node(
        spark.createDataFrame(points, "id int, lat double, lon double"), spark.createDataFrame(nodes, "node int, lat float, lon float")
    )
    assert {r["id"]: r["node"] for r in got.collect()} == {i: grid_nearest(a, o, nodes) for i, a, o in points}


def F32(x):
    import numpy as np

    return np.float32(x)


def test_snap_falls_back_to_node_zero(spark):
    nodes = spark.createDataFrame([(0, 48.0, 6.0), (7, 48.2, 6.0)], "node int, lat float, lon float")
    points = spark.createDataFrame([(1, 48.2001, 6.0), (2, 48.1, 6.0), (3, 0.0, 0.0), (4, None, None)], "id int, lat double, lon double")
    got = {r["id"]: (r["node"], r["unsnapped"]) for r in P.snap_points(points, nodes).collect()}
    assert got[1] == (7, False) and got[2][1] and got[3] == (0, True) and got[4] == (0, True)


def test_fixture_addresses_snap(spark, mini):
    spots = [("1", 48.6801, 5.8899), ("3", 48.6807, 5.8901), ("12", 48.6805, 5.8905), ("7B", 48.6805, 5.8894)]
    got = P.nearest_node(spark.createDataFrame(spots, "id string, lat double, lon double"), mini[0])
    assert {r["id"]: (r["node"], round(r["distance_m"], 3)) for r in got.collect()} == {
        "1": (0, 13.291), "3": (1, 23.419), "12": (3, 36.694), "7B": (4, 29.371),
    }


def test_favourites_within_radius_and_across_the_date_line(spark):
    rng = random.Random(8)
    favs, points = [], []
    for k, (lat, lon) in enumerate([(48.0, 6.0), (-33.0, 179.9999), (0.0, 0.0), (70.0, -180.0)]):
        for m in range(12):
            favs.append((f"{k}-{m:02}", "r", "v", lat + rng.uniform(-8e-4, 8e-4), lon + rng.uniform(-8e-4, 8e-4), "n"))
            points.append((len(points), lat + rng.uniform(-8e-4, 8e-4), lon + rng.uniform(-8e-4, 8e-4)))
    wrap = [(i, r, v, a, (o + 540) % 360 - 180, n) for i, r, v, a, o, n in favs]
    spots = [(i, a, (o + 540) % 360 - 180) for i, a, o in points]
    got = P.nearest_favourite(
        spark.createDataFrame(spots, "pid int, lat double, lon double"),
        spark.createDataFrame(wrap, "id string, rue string, ville string, lat double, lon double, note string"),
    )
    for r in got.collect():
        near = [(metres(r["lat"], r["lon"], f[3], f[4]), f[0]) for f in wrap]
        near = min([x for x in near if x[0] <= 60], default=None)
        assert (r["favori"]["id"] if r["favori"] else None) == (near[1] if near else None)
        if near:
            assert r["favori_m"] == pytest.approx(near[0], abs=1e-6)


def test_rows_without_a_key_pass_by_the_joins(spark):
    """Points without a position and queries without a postcode keep their rows, with no null-keyed outer join."""
    nodes = spark.createDataFrame([(0, 48.0, 6.0)], "node int, lat float, lon float")
    points = spark.createDataFrame([(1, 48.0, 6.0), (2, None, None), (2, None, None), (3, 48.0, None), (4, None, 6.0)], "id int, lat double, lon double")
    near = P.nearest_node(points, nodes)
    assert sorted((r["id"], r["node"]) for r in near.collect()) == [(1, 0), (2, None), (2, None), (3, None), (4, None)]
    favs = spark.createDataFrame([("f", "r", "v", 48.0, 6.0, "n")], "id string, rue string, ville string, lat double, lon double, note string")
    alike = P.nearest_favourite(points, favs)
    assert sorted((r["id"], r["favori"] is not None) for r in alike.collect()) == [(1, True), (2, False), (2, False), (3, False), (4, False)]
    for found in (near, alike):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        outer = plan[plan.index("Join LeftOuter") :]
        filters = outer[: outer.index("Aggregate")]
        assert "isnotnull(lat" in filters and "isnotnull(lon" in filters, plan

    rows = [(1, "6", "", "Rue du Puits", "54470", "Aville", 48.0, 6.0), (2, "6", "", "Rue du Puits", None, "Aville", 48.0, 6.0)]
    asked = [(1, "Rue du Puits", "54470", "Aville", "6"), (2, None, None, None, None), (3, None, None, None, None), (4, "Rue du Puits", None, "Aville", "6"), (5, "Rue du Puits", None, "Nowhere", "6")]
    q = spark.createDataFrame(asked, "qid int, rue string, cp string, ville string, numero string")
    pools = G.candidate_pool(G.prepare_queries(q), addresses(spark, rows))
    assert {r["qid"]: (r["pool"], r["pool_size"]) for r in pools.collect()} == {
        1: ("p:54470", 1), 2: (None, 0), 3: (None, 0), 4: ("c:aville", 2), 5: (None, 0),
    }
    best = {r["qid"]: r["best"] and r["best"]["address"]["id"] for r in G.match_addresses(q, addresses(spark, rows)).collect()}
    assert best == {1: 1, 2: None, 3: None, 4: 1, 5: None}


def test_cells_meet_only_the_rings_they_need(spark):
    """Rows joined per cell and reach, and the same targets as looking at all cells."""
    import random

    from roundsman.operators import spatial as P

    rng = random.Random(8)
    nodes = sorted({(rng.randrange(-6, 7), rng.randrange(-6, 7)) for _ in range(40)} | {(60, 60), (61, 59), (-90, 0)})
    cells = sorted({(rng.randrange(-95, 96), rng.randrange(-95, 96)) for _ in range(150)} | {(0, 0), (60, 61), (140, 140), (61, 140), (61, 139)})
    point_cells, node_cells = (spark.createDataFrame(x, "cx long, cy long") for x in (cells, nodes))
    got = {}
    for r in P.cell_targets(point_cells, node_cells).collect():
        got.setdefault((r.cx, r.cy), set()).add((r.tx, r.ty))
    for x, y in cells:
        rings = {n: max(abs(n[0] - x), abs(n[1] - y)) for n in nodes}
        first = min(r for r in rings.values())
        want = {n for n, r in rings.items() if r <= min(first + 1, P.MAX_RING)} if first <= P.MAX_RING else set()
        assert got.get((x, y), set()) == want
    renamed = node_cells.select(node_cells.cx.alias("tx"), node_cells.cy.alias("ty"))
    for reach in (1, 4, 16):
        met = P.met_cells(point_cells, renamed, reach).groupBy("cx", "cy").count().collect()
        assert all(r["count"] <= (2 * reach + 1) ** 2 for r in met)


def test_plans_carry_narrow_rows(spark):
    """Letter groups and favourite cells are listed without the records."""
    from roundsman.operators import spatial as P

    rows = spark.createDataFrame(
        [(1, "1", "", "Rue Haute", "rue haute", "10000", "Ville", "ville", 48.0, 5.0)],
        "id long, n string, rep string, r string, rn string, cp string, c string, cn string, lat double, lon double",
    )
    asked = spark.createDataFrame([(1, "haute 10000 ville")], "qid long, query string")

    def generated(df):
        text = df._jdf.queryExecution().optimizedPlan().toString()
        return [line for line in text.splitlines() if "Generate explode(" in line]

    found = G.search_addresses(asked, rows)
    assert [(r.rank, r.id) for r in found.collect()] == [(1, 1)]
    lists = generated(found)
    assert lists and all("lat" not in line and "rn#" not in line for line in lists)
    favourites = spark.createDataFrame([("F", "Rue", "1", "V", 48.0, 5.0, "n")], "id string, rue string, cp string, ville string, lat double, lon double, note string")
    near = P.nearest_favourite(rows.select("id", "lat", "lon"), favourites)
    assert near.collect()[0].favori.note == "n"
    assert all("note" not in line for line in generated(near))


def test_addresses_of_a_match_are_shuffled_in_short_lists(spark):
    """No row per address between the comparison and the lists, repeated ids count once, with their best score."""
    rows = [(i, str(i % 3), "", f"Rue {'Haute' if i % 2 else 'Basse'}", "1", "Aville", 48.0, 6.0) for i in range(30)]
    rows += [(1, "2", "", "Rue Haute", "1", "Aville", 48.0, 6.0), (None, "1", "", "Rue Haute", "1", "Aville", 48.0, 6.0)]
    q = spark.createDataFrame([(1, "Rue Haute", "1", "Aville", "1")], "qid int, rue string, cp string, ville string, numero string")
    found = G.match_addresses(q, addresses(spark, rows))
    assert [(round(x["score"], 6), x["address"]["id"]) for x in found.first()["candidates"]] == [
        (1.5, None), (1.5, 1), (1.5, 7), (1.5, 13), (1.5, 19),
    ]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "first(address" not in plan and "address.id AS _id" not in plan, plan


def test_points_meet_nodes_by_their_own_cell(spark):
    """Cells fetch their nodes first: a point is not joined once per target cell before it is shuffled."""
    nodes = spark.createDataFrame([(i, 48.0 + i % 5 * 0.004, 6.0 + i // 5 * 0.004) for i in range(25)], "node int, lat float, lon float")
    points = spark.createDataFrame([(1, 48.0, 6.0), (2, 48.0081, 6.0079), (2, 48.0081, 6.0079), (3, 49.0, 6.0)], "id int, lat double, lon double")
    near = P.nearest_node(points, nodes)
    assert sorted((r.id, -1 if r.node is None else r.node) for r in near.collect()) == [(1, 0), (2, 12), (2, 12), (3, -1)]
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert "cx#" in joins[0] and "tx#" in joins[1], plan
