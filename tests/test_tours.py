from roundsman.operators import ordering, tours

STOPS = "tour_id long, colis_id string, ordre long, statut string, located boolean"


def test_insertion_reads_its_stops_once(spark):
    rows = [
        (1, "a", 1, "livre", True), (1, "b", 2, "a_livrer", True), (1, "lost", 3, "a_livrer", False),
        (1, "c", 4, "a_livrer", True), (2, "d", 1, "a_livrer", True), (None, "e", 1, "a_livrer", True),
        (3, "f", 1, None, True),
    ]
    seen = spark.sparkContext.accumulator(0)

    def pass_on(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    stops = spark.createDataFrame(rows, STOPS).mapInArrow(pass_on, STOPS)
    gaps = spark.createDataFrame([(1, 1, "new"), (3, 9, "last"), (4, 2, "only")], "tour_id long, gap long, colis_id string")
    got = {(r.tour_id, r.colis_id): (r.ordre, r.statut, r.unplaced) for r in tours.apply_insertion(stops, gaps).collect()}
    assert got == {
        (1, "a"): (1, "livre", False), (1, "b"): (2, "a_livrer", False), (1, "new"): (3, "a_livrer", False),
        (1, "c"): (4, "a_livrer", False), (1, "lost"): (5, "a_livrer", True), (2, "d"): (1, "a_livrer", False),
        (None, "e"): (1, "a_livrer", False), (3, "f"): (1, None, False), (3, "last"): (2, "a_livrer", False),
        (4, "only"): (1, "a_livrer", False),
    }
    assert seen.value == len(rows)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_legs_do_not_sort_the_matrix(spark):
    orders = spark.createDataFrame([(1, 0, 2), (1, 1, 1), (2, 0, 1)], "tour_id long, pos long, i long")
    matrix = spark.createDataFrame([(1, 0, 2, 5.0), (1, 2, 1, 7.0), (1, 1, 2, 9.0)], "tour_id long, i long, j long, seconds double")
    found = ordering.legs(orders, matrix)
    assert sorted(found.collect()) == [(1, 0, 2, 5.0), (1, 1, 1, 7.0), (2, 0, 1, float("inf"))]
    assert "ShuffledHashJoin [tour_id" in _plan(found)


def test_taken_parcels_need_no_table_of_all_ids(spark):
    parcels = spark.createDataFrame([("a", "pret"), ("a", "livre"), ("b", "pret"), (None, "pret")], "id string, statut string")
    stops = spark.createDataFrame([("a",), ("a",), (None,), ("z",)], "colis_id string")
    found = tours.start_parcels(parcels, stops)
    assert sorted(found.collect(), key=str) == sorted(
        [("a", "en_tournee"), ("a", "en_tournee"), ("b", "pret"), (None, "pret")], key=str
    )
    assert "Aggregate" not in _plan(found)


def test_plans_keep_what_they_read_again(spark, monkeypatch):
    """Tours computed and a parcel inserted: the matrix travels in lists, and what is read again lies in files."""
    from pyspark.sql.types import ArrayType

    from roundsman.operators import journeys as J

    nodes = spark.createDataFrame([(i, 48.0 + i * 0.004, 5.0) for i in range(6)], "node long, lat float, lon float")
    links = [(u, v) for u in range(6) for v in (u - 1, u + 1) if 0 <= v < 6]
    edges = [(k, u, v, 10.0) for k, (u, v) in enumerate(links)]
    turns = [(a[0], b[0]) for a in edges for b in edges if a[2] == b[1] and b[2] != a[1]]
    edges, turns = spark.createDataFrame(edges, "e long, u long, v long, w float"), spark.createDataFrame(turns, "e long, f long")
    places = [("a", 1, 48.008, 5.0, "pret"), ("b", 1, 48.004, 5.0, "pret"), ("c", 1, 48.016, 5.0, "en_tournee"), ("d", 1, 48.0, 5.0, "livre")]
    parcels = spark.createDataFrame([(*p, False) for p in places], "id string, tour_id long, lat double, lon double, statut string, avant12h boolean")
    tours = spark.createDataFrame([(1, 48.0, 5.0, True, 48.0, 5.0)], "tour_id long, start_lat double, start_lon double, return_to_depot boolean, depot_lat double, depot_lon double")
    kept, solved = [], []
    stored, optimize, gap = J.stored, J.optimize, J.cheapest_gap
    monkeypatch.setattr(J, "stored", lambda df: kept.append(df.columns) or stored(df))
    monkeypatch.setattr(J, "optimize", lambda p, m, *a: solved.append(m) or optimize(p, m, *a))
    monkeypatch.setattr(J, "cheapest_gap", lambda r, n, m: solved.append(m) or gap(r, n, m))
    made, stops, _ = J.compute_tours(tours, parcels, nodes, edges, turns, 0.0)
    assert [tuple(r) for r in stops.select("colis_id", "ordre", "leg_s").sort("ordre").collect()] == [("b", 1, 10.0), ("a", 2, 10.0), ("c", 3, 20.0)]
    assert [r.total_s for r in made.collect()] == [80.0]
    running = tours.selectExpr("*", "depot_lat AS return_lat", "depot_lon AS return_lon")
    new = spark.createDataFrame([(1, "n", 48.012, 5.0)], "tour_id long, colis_id string, lat double, lon double")
    inserted, gaps = J.insert_parcels(new, running, stops, parcels, nodes, edges, turns)
    assert [(r.gap, r.extra_s) for r in gaps.collect()] == [(2, 0.0)]
    assert [r.colis_id for r in inserted.sort("ordre").collect()] == ["b", "a", "n", "c"]
    assert all(isinstance(m.schema["j"].dataType, ArrayType) for m in solved) and len(solved) == 2
    # points before they are snapped, in both plans
    assert sum("node" not in c and "lat" in c and ("i" in c or "k" in c) for c in kept) == 2
