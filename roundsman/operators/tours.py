"""Building tours, inserting late parcels at the smallest detour, and manual moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roundsman.operators.ordering import INF, legs, link_seconds
from roundsman.operators.ranges import block_of, number_rows
from roundsman.operators.status import pending, treated
from roundsman.session import cut_lineage, stored


def eligible(parcels: DataFrame) -> DataFrame:
    """Parcels a new tour takes in: ready ones first, then those already on a tour."""
    return parcels.where(F.col("statut").isin("pret", "en_tournee")).withColumn(
        "rank", F.when(F.col("statut") == "pret", F.lit(0)).otherwise(F.lit(1))
    )


def tour_points(tours: DataFrame, parcels: DataFrame) -> DataFrame:
    """(tour_id, i, colis_id, lat, lon, kind, avant12h, fixed_end): start, eligible parcels, return depot.

    ``tours(tour_id, start_lat, start_lon, return_to_depot, depot_lat, depot_lon)``;
    ``parcels`` carries the tour it is meant for in ``tour_id``.
    """
    taken = eligible(parcels).select("tour_id", "id", "lat", "lon", "avant12h", "rank")
    taken = stored(taken.join(tours.select("tour_id"), "tour_id", "left_semi"))  # read three times below
    block = F.concat(F.col("rank").cast("string"), F.lit("|"), F.substring("id", 1, 6))
    numbered = number_rows(taken, ["tour_id"], block, ["rank", "id"], "i")
    no = F.lit(False)
    starts = tours.select(
        "tour_id", F.lit(0).cast("bigint").alias("i"), F.lit(None).cast("string").alias("colis_id"),
        F.col("start_lat").alias("lat"), F.col("start_lon").alias("lon"), F.lit("start").alias("kind"),
        no.alias("avant12h"), no.alias("fixed_end"),
    )
    middle = numbered.select(
        "tour_id", F.col("i").cast("bigint").alias("i"), F.col("id").alias("colis_id"), "lat", "lon",
        F.lit("parcel").alias("kind"), F.coalesce("avant12h", no).alias("avant12h"), no.alias("fixed_end"),
    )
    sizes = taken.groupBy("tour_id").agg(F.count("*").alias("n"))
    ends = tours.where(F.col("return_to_depot")).join(sizes, "tour_id", "left").select(
        "tour_id", (F.coalesce("n", F.lit(0)) + 1).alias("i"), F.lit(None).cast("string").alias("colis_id"),
        F.col("depot_lat").alias("lat"), F.col("depot_lon").alias("lon"), F.lit("return").alias("kind"),
        no.alias("avant12h"), F.lit(True).alias("fixed_end"),
    )
    return starts.unionByName(middle).unionByName(ends)


def build_tours(orders: DataFrame, matrix: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tours, stops) of an order: stop times of their own, a total that includes the way back."""
    timed = legs(orders.select("tour_id", "pos", "i"), matrix).join(
        points.select("tour_id", "i", "colis_id", "fixed_end"), ["tour_id", "i"]
    )
    tours = timed.groupBy("tour_id").agg(
        F.sum("seconds").alias("total_s"),
        F.count_if(~F.col("fixed_end")).alias("stops"),
        F.bool_or("fixed_end").alias("return_to_depot"),
    ).withColumn("statut", F.lit("en_cours"))
    stops = timed.where(~F.col("fixed_end")).select(
        "tour_id", "colis_id", (F.col("pos") + 1).alias("ordre"), F.lit("a_livrer").alias("statut"),
        F.lit(None).cast("timestamp_ntz").alias("delivered_at"), F.col("seconds").alias("leg_s"),
    )
    return tours, stops


def start_parcels(parcels: DataFrame, stops: DataFrame) -> DataFrame:
    """Parcels with the status ``en_tournee`` set on those a tour has taken."""
    # a rank instead of a distinct: its sort serves the join as well, and no hash table of all ids stands beside it
    first = F.row_number().over(Window.partitionBy("id").orderBy("id"))
    taken = stops.select(F.col("colis_id").alias("id")).withColumn("_n", first).where("_n = 1").select("id", F.lit(True).alias("_taken"))
    status = F.when(F.col("_taken"), F.lit("en_tournee")).otherwise(F.col("statut"))
    return parcels.join(taken, "id", "left").withColumn("statut", status).drop("_taken").select(*parcels.columns)


def reference_point(tours: DataFrame, stops: DataFrame, parcels: DataFrame) -> DataFrame:
    """(tour_id, lat, lon): where the driver is, the last treated stop, else the depot."""
    last = stops.where(treated()).groupBy("tour_id").agg(F.max_by("colis_id", "ordre").alias("colis_id"))
    place = parcels.select(F.col("id").alias("colis_id"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    known = last.join(place, "colis_id", "left").select("tour_id", "_lat", "_lon")
    there = F.col("_lat").isNotNull()
    return tours.join(known, "tour_id", "left").select(
        "tour_id",
        F.when(there, F.col("_lat")).otherwise(F.col("depot_lat")).alias("lat"),
        F.when(there, F.col("_lon")).otherwise(F.col("depot_lon")).alias("lon"),
    )


def cheapest_gap(route: DataFrame, new: DataFrame, matrix: DataFrame) -> DataFrame:
    """(tour_id, gap, extra_s): the gap of ``route(tour_id, k, i)`` where the new point costs least.

    ``new(tour_id, i)``. Gaps lie between consecutive way points k and k+1; the first
    smallest detour wins. Without a gap, or without a usable detour, the new stop goes
    first (gap 0, no cost).
    """
    ahead = route.select("tour_id", (F.col("k") - 1).alias("k"), F.col("i").alias("b"))
    fresh = new.select("tour_id", F.col("i").alias("x"))
    gaps = route.withColumnRenamed("i", "a").join(ahead, ["tour_id", "k"]).join(fresh, "tour_id")
    links = gaps.select(
        "tour_id", "k",
        F.explode(F.array(
            F.struct(F.col("a").alias("i"), F.col("x").alias("j"), F.lit("in").alias("part")),
            F.struct(F.col("x").alias("i"), F.col("b").alias("j"), F.lit("out").alias("part")),
            F.struct(F.col("a").alias("i"), F.col("b").alias("j"), F.lit("direct").alias("part")),
        )).alias("l"),
    ).select("tour_id", "k", "l.*")

    def part(name: str) -> Column:
        return F.max(F.when(F.col("part") == name, F.col("s")))

    timed = link_seconds(links, matrix).withColumn("s", F.coalesce("seconds", F.lit(INF)))
    priced = timed.groupBy("tour_id", "k").agg((part("in") + part("out") - part("direct")).alias("extra"))
    usable = ~F.isnan("extra") & (F.col("extra") < INF)
    best = priced.where(usable).groupBy("tour_id").agg(F.min(F.struct("extra", "k")).alias("g"))
    return fresh.select("tour_id").join(best, "tour_id", "left").select(
        "tour_id", F.coalesce("g.k", F.lit(0)).cast("bigint").alias("gap"), F.col("g.extra").alias("extra_s")
    )


def apply_insertion(stops: DataFrame, gaps: DataFrame, kept: bool = False) -> DataFrame:
    """Stops after putting one new parcel (tour_id, gap, colis_id) into each named tour.

    Treated stops keep their place. Pending ones follow the highest of them, numbered
    without holes, the new stop behind ``gap`` of them. A pending stop without
    coordinates cannot be placed; it stays on the tour, last, with ``unplaced`` set. ``stops`` that are
    ``kept`` in files already are not written again.
    """
    if not kept:
        stops = cut_lineage(stops)  # read three times below
    base = stops.groupBy("tour_id").agg(
        F.coalesce(F.max(F.when(treated(), F.col("ordre"))), F.lit(0)).alias("_base"),
        F.count_if(pending() & F.col("located")).alias("_open"),
    )
    # a gap behind the last open stop means the end
    gaps = cut_lineage(gaps.join(base, "tour_id", "left").select(
        "tour_id", F.least("gap", F.coalesce("_open", F.lit(0))).alias("gap"), "colis_id", "_base", "_open"
    ))
    wish = gaps.select("tour_id", F.col("gap").alias("_gap"), "_base", "_open", F.lit(True).alias("_hit"))
    joined = stops.join(wish, "tour_id", "left")
    kept = joined.where(F.col("_hit").isNull() | treated()).withColumn("unplaced", F.lit(False))
    rest = joined.where(F.col("_hit") & pending()).withColumn("_lost", (~F.col("located")).cast("int"))
    ranked = number_rows(rest, ["tour_id", "_lost"], block_of(F.col("ordre")), ["ordre"], "_k")
    placed = F.col("_base") + F.col("_k") + F.when(F.col("_k") > F.col("_gap"), F.lit(1)).otherwise(F.lit(0))
    lost = F.col("_base") + F.col("_open") + 1 + F.col("_k")
    moved = ranked.withColumn("ordre", F.when(F.col("located"), placed).otherwise(lost)).withColumn("unplaced", ~F.col("located"))
    made = gaps.select(
        "tour_id", "colis_id", (F.coalesce("_base", F.lit(0)) + F.col("gap") + 1).alias("ordre"),
        F.lit("a_livrer").alias("statut"), F.lit(True).alias("located"), F.lit(False).alias("unplaced"),
    )
    columns = [*stops.columns, "unplaced"]
    rows = kept.select(*columns).unionByName(moved.select(*columns))
    return rows.unionByName(made, allowMissingColumns=True)


def move_stops(stops: DataFrame, moves: DataFrame) -> DataFrame:
    """Swap places with the neighbour: ``moves(tour_id, ordre, direction)``, -1 up, +1 down, one per tour.

    A move from either end, or of a stop that does not exist, changes nothing.
    """
    wish = moves.select("tour_id", F.col("ordre").alias("_at"), "direction")
    joined = stops.join(wish, "tour_id", "left")
    near = joined.groupBy("tour_id").agg(
        F.bool_or(F.col("ordre") == F.col("_at")).alias("_exists"),
        F.min(F.when((F.col("direction") == 1) & (F.col("ordre") > F.col("_at")), F.col("ordre"))).alias("_down"),
        F.max(F.when((F.col("direction") == -1) & (F.col("ordre") < F.col("_at")), F.col("ordre"))).alias("_up"),
    )
    other = F.when(F.col("_exists"), F.coalesce("_down", "_up"))
    swapped = (
        F.when(other.isNull(), F.col("ordre"))
        .when(F.col("ordre") == F.col("_at"), other)
        .when(F.col("ordre") == other, F.col("_at"))
        .otherwise(F.col("ordre"))
    )
    return joined.join(near, "tour_id", "left").select(
        *[swapped.alias("ordre") if c == "ordre" else F.col(c) for c in stops.columns]
    )


def insert_or_defer(new: DataFrame, tours: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(insert now, leave for the next computation): a ready, geocoded parcel whose tour is running is inserted."""
    running = tours.where(F.col("statut") == "en_cours").select("tour_id").distinct().withColumn("_on", F.lit(True))
    judged = new.join(running, "tour_id", "left").withColumn(
        "_now",
        F.coalesce(F.col("_on") & (F.col("statut") == "pret") & (F.col("geocode_status") == "ok"), F.lit(False)),
    )
    return judged.where("_now").select(*new.columns), judged.where(~F.col("_now")).select(*new.columns)


def parcels_from_favourites(favourites: DataFrame, now: Column, new_id: Column | None = None) -> DataFrame:
    """Ready parcels addressed to saved favourites."""
    return favourites.select(
        (F.uuid() if new_id is None else new_id).alias("id"),
        F.coalesce(F.when(F.col("rue") != "", F.col("rue")), F.lit("Favori")).alias("nom"),
        F.struct("rue", "cp", "ville").alias("adresse_raw"),
        F.struct(F.lit("ok").alias("status"), "lat", "lon").alias("geocode"),
        F.lit("pret").alias("statut"),
        now.alias("date_scan"),
        F.lit("").alias("tel"),
        F.lit(1).alias("quantite"),
        F.lit(False).alias("avant12h"),
        F.col("id").alias("source_favori_id"),
    )


def message_options(parcels: DataFrame, templates: Column) -> DataFrame:
    """Every message template filled for every parcel with a phone number: (id, index, label, body, href).

    ``templates`` is an array of struct(label, body), the handful of texts a driver keeps.
    """
    from roundsman.functions.links import sms_url
    from roundsman.functions.text import render_template, text_or_empty

    rows = parcels.where(text_or_empty(F.col("tel")) != "").select(
        "id", "tel", "nom", "adresse", "minutes", F.posexplode(templates).alias("index", "t")
    ).withColumn("body", render_template(F.col("t.body"), F.col("nom"), F.col("minutes"), F.col("adresse")))
    return rows.select(
        "id", F.col("index").cast("bigint").alias("index"), F.col("t.label").alias("label"), "body",
        sms_url(F.col("tel"), F.col("body")).alias("href"),
    )
