"""Whole plans: tours from parcels to numbered stops, and late parcels into running tours, on road times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundsman.operators.ordering import optimize
from roundsman.operators.ranges import block_of, number_rows
from roundsman.operators.roads import MAX_SECONDS, time_matrix
from roundsman.operators.spatial import snap_points
from roundsman.operators.status import pending
from roundsman.operators.tours import apply_insertion, build_tours, cheapest_gap, reference_point, tour_points
from roundsman.session import cut_lineage, stored


def compute_tours(
    tours: DataFrame, parcels: DataFrame, nodes: DataFrame, edges: DataFrame, turns: DataFrame, penalty_s: float,
    max_s: float = MAX_SECONDS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tours, stops, points) of all tours: eligible parcels snapped to the roads, timed, ordered and numbered.

    ``tours`` and ``parcels`` are as for ``tour_points``. ``points`` carry ``unsnapped`` where a
    point is far from every road; it is driven from the nearest node all the same, as is a
    point without coordinates from node 0.
    """
    # kept before they are snapped: that reads them several times, and they take the parcels to be numbered
    points = stored(snap_points(stored(tour_points(tours, parcels)), nodes))
    matrix = stored(time_matrix(points.select("tour_id", "i", "node"), edges, turns, max_s, lists=True))
    order = cut_lineage(optimize(points.select("tour_id", "i", "avant12h", "fixed_end"), matrix, penalty_s))
    made, stops = build_tours(order, matrix, points)
    return made, stops, points


def insert_parcels(
    new: DataFrame, tours: DataFrame, stops: DataFrame, parcels: DataFrame, nodes: DataFrame, edges: DataFrame, turns: DataFrame,
    max_s: float = MAX_SECONDS,
) -> tuple[DataFrame, DataFrame]:
    """(stops, gaps) after putting ``new(tour_id, colis_id, lat, lon)``, one per tour, where it costs least time.

    A tour goes on from its reference point over the pending stops with coordinates to the
    return depot, if it has one; ``gaps(tour_id, gap, extra_s, colis_id)`` tells the detour.
    Stops of other tours stay as they are, see ``apply_insertion``.
    """
    place = parcels.select(F.col("id").alias("colis_id"), "lat", "lon")
    placed = stops.join(place, "colis_id", "left").withColumn("located", F.col("lat").isNotNull() & F.col("lon").isNotNull())
    placed = stored(placed)
    running = tours.join(new.select("tour_id"), "tour_id", "left_semi")
    ahead = placed.join(new.select("tour_id"), "tour_id", "left_semi").where(pending() & F.col("located"))
    open_stops = number_rows(ahead, ["tour_id"], block_of(F.col("ordre")), ["ordre"], "k").select(
        "tour_id", F.col("k").cast("bigint").alias("k"), "lat", "lon"
    )
    size = open_stops.groupBy("tour_id").agg(F.max("k").alias("n"))
    start = reference_point(running, placed, parcels).select("tour_id", F.lit(0).cast("bigint").alias("k"), "lat", "lon")
    after = F.coalesce("n", F.lit(0)).cast("bigint")
    back = running.where(F.col("return_to_depot")).join(size, "tour_id", "left").select(
        "tour_id", (after + 1).alias("k"), F.col("return_lat").alias("lat"), F.col("return_lon").alias("lon")
    )
    route = start.unionByName(open_stops).unionByName(back)
    # the new parcel's number lies behind all others, with or without a return depot
    fresh = new.join(size, "tour_id", "left").select("tour_id", (after + 2).alias("k"), "lat", "lon")
    # kept before they are snapped: that reads them several times, and the gaps are made from them as well
    way = stored(route.withColumn("new", F.lit(False)).unionByName(fresh.withColumn("new", F.lit(True))))
    points = stored(snap_points(way.select("tour_id", F.col("k").alias("i"), "lat", "lon"), nodes).select("tour_id", "i", "node"))
    matrix = time_matrix(points, edges, turns, max_s, lists=True)
    route, fresh = way.where("NOT new"), way.where("new")
    gaps = cheapest_gap(route.select("tour_id", "k", F.col("k").alias("i")), fresh.select("tour_id", F.col("k").alias("i")), matrix)
    gaps = cut_lineage(gaps.join(new.select("tour_id", "colis_id"), "tour_id"))
    inserted = apply_insertion(placed.drop("lat", "lon"), gaps.select("tour_id", "gap", "colis_id"), kept=True)
    return inserted, gaps
