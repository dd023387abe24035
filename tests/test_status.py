"""Tour state against an event-by-event replay; numbering helpers against windows."""

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from roundsman.operators import ranges, status, tours

START = dt.datetime(2024, 1, 1)


def test_numbering_equals_a_plain_window(spark):
    rng = random.Random(1)
    data = [(rng.choice("aaab"), n) for n in rng.sample(range(5000), 800)]
    df = spark.createDataFrame(data, "k string, o long").withColumn("x", F.col("o") % 7)
    numbered = ranges.number_rows(df, ["k"], ranges.block_of(F.col("o"), 100), ["o"], "n")
    summed = ranges.running_sums(numbered, ["k"], ranges.block_of(F.col("o"), 100), ["o"], {"s": F.col("x")})
    both = ranges.previous_value(summed, ["k"], ranges.block_of(F.col("o"), 100), ["o"], "x", "p")
    w = Window.partitionBy("k").orderBy("o")
    wrong = both.withColumn("n2", F.row_number().over(w)).withColumn(
        "s2", F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("p2", F.lag("x").over(w)).where("n <> n2 OR s <> s2 OR NOT (p <=> p2)")
    assert both.count() == 800 and wrong.isEmpty()


def replay(events):
    stops, parcels, closed = {}, {}, set()
    for seq, ts, kind, tour, ordre, colis, why in sorted(events, key=lambda e: (e[1], e[0])):
        if kind == "archive":
            closed.add(tour)
            continue
        parcels[colis] = {"failed": "echec", "report": "pret"}.get(kind, "livre")
        s = stops.setdefault((tour, ordre), [None, None, None, None])
        if kind == "delivered" or (kind == "direct" and tour not in closed and s[0] != "livre"):
            s[0], s[1] = "livre", ts
        elif kind == "failed":
            s[0], s[2], s[3] = "echec", ts, why
    return parcels, {k: tuple(v) for k, v in stops.items() if v[0]}, closed


def test_fold_equals_replay(spark):
    rng = random.Random(2)
    events = []
    for k in range(600):
        t, o = rng.randrange(12), rng.randrange(1, 4)
        kind = rng.choices(["delivered", "failed", "direct", "report", "archive"], [3, 3, 4, 2, 0.4])[0]
        events.append((k, START + dt.timedelta(hours=rng.randrange(800)), kind, t, o, f"{t}-{o}", f"m{k}"))
    df = spark.createDataFrame(events, "seq long, ts timestamp_ntz, kind string, tour_id int, ordre int, colis_id string, raison string")
    parcels, stops, tour_states = status.fold_events(df)
    want_parcels, want_stops, closed = replay(events)
    assert {r["colis_id"]: r["statut"] for r in parcels.collect()} == want_parcels
    got = {(r["tour_id"], r["ordre"]): (r["statut"], r["delivered_at"], r["failed_at"], r["raison_echec"]) for r in stops.collect()}
    assert got == want_stops
    assert {r["tour_id"] for r in tour_states.collect() if r["statut"] == "archivee"} == closed


STOPS = "tour_id int, ordre int, colis_id string, statut string, delivered_at timestamp_ntz, failed_at timestamp_ntz, leg_s double"


def test_etas_follow_the_last_treated_stop(spark):
    trips = spark.createDataFrame([(1, START, True, 1000.0), (2, START, True, 10.0)], "tour_id int, date_creation timestamp_ntz, return_to_depot boolean, total_s double")
    at = START + dt.timedelta(hours=1)
    stops = spark.createDataFrame(
        [(1, 1, "a", "livre", at, None, 100.0), (1, 2, "b", "livre", None, None, 50.0), (1, 3, "c", "a_livrer", None, None, 60.0),
         (1, 4, "d", "a_livrer", None, None, None), (2, 1, "e", "a_livrer", None, None, 30.0)],
        STOPS,
    )
    got = {r["colis_id"]: (r["eta"] - START).total_seconds() for r in status.etas(trips, stops, 180.0).collect()}
    assert got == {"b": 3650.0, "c": 3600.0 + 50 + 180 + 60, "d": 3600.0 + 50 + 180 + 60 + 180, "e": 30.0}
    depot = {r["tour_id"]: (r["depot_eta"] - START).total_seconds() for r in status.depot_etas(trips, stops, 180.0).collect()}
    assert depot == {1: 3600 + 110 + 3 * 180 + (1000 - 210), 2: 30 + 180}


def test_moves(spark):
    stops = spark.createDataFrame([(1, 2, "a"), (1, 5, "b"), (1, 9, "c"), (2, 1, "d")], "tour_id int, ordre int, colis_id string")
    for ordre, direction, expected in ((5, 1, {"a": 2, "b": 9, "c": 5}), (2, -1, {"a": 2, "b": 5, "c": 9}), (5, -1, {"a": 5, "b": 2, "c": 9}),
                                       (4, 1, {"a": 2, "b": 5, "c": 9})):
        moves = spark.createDataFrame([(1, ordre, direction)], "tour_id int, ordre int, direction int")
        got = {r["colis_id"]: r["ordre"] for r in tours.move_stops(stops, moves).collect()}
        assert got == {**expected, "d": 1}


def test_insertion(spark):
    stops = spark.createDataFrame(
        [(1, 1, "a", "livre", True), (1, 4, "b", "a_livrer", True), (1, 5, "x", "a_livrer", False), (1, 8, "c", "a_livrer", True), (2, 1, "z", "a_livrer", True)],
        "tour_id int, ordre int, colis_id string, statut string, located boolean",
    )
    for gap, expected in ((0, {"a": 1, "n": 2, "b": 3, "c": 4, "x": 5}), (1, {"a": 1, "b": 2, "n": 3, "c": 4, "x": 5}), (9, {"a": 1, "b": 2, "c": 3, "n": 4, "x": 5})):
        gaps = spark.createDataFrame([(1, gap, "n")], "tour_id int, gap int, colis_id string")
        got = {r["colis_id"]: r["ordre"] for r in tours.apply_insertion(stops, gaps).collect()}
        assert got == {**expected, "z": 1}


def test_cheapest_gap_skips_undefined_detours(spark):
    inf = float("inf")
    route = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (1, 2, 2), (2, 0, 0)], "tour_id int, k int, i int")
    new = spark.createDataFrame([(1, 9), (2, 9)], "tour_id int, i int")
    matrix = spark.createDataFrame(
        [(1, 0, 9, inf), (1, 9, 1, 1.0), (1, 0, 1, inf), (1, 1, 9, 5.0), (1, 9, 2, 5.0), (1, 1, 2, 4.0)],
        "tour_id int, i int, j int, seconds double",
    )
    got = {r["tour_id"]: (r["gap"], r["extra_s"]) for r in tours.cheapest_gap(route, new, matrix).collect()}
    assert got == {1: (1, 6.0), 2: (0, None)}
