"""State of tours, stops and parcels: event fold, arrival times, progress, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roundsman.functions.geo import js_round
from roundsman.functions.text import matches_text
from roundsman.operators.ranges import block_of, previous_value, running_sums

INF = float("inf")

# Colours of the map by parcel status and by driven leg.
STATUS_COLOURS = {"livre": "#22c55e", "echec": "#dc2626", "a_verifier": "#94a3b8"}
OPEN_COLOUR = "#3b82f6"


def treated(status: str = "statut") -> Column:
    return F.coalesce(F.col(status).isin("livre", "echec"), F.lit(False))


def pending(status: str = "statut") -> Column:
    return ~treated(status)


def fold_events(events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Latest (parcels, stops, tours) from ``events(seq, ts, kind, tour_id, ordre, colis_id, raison)``.

    Kinds: ``delivered`` and ``failed`` (a stop), ``direct`` (a parcel delivered outside
    its tour screen), ``report`` (a failed parcel goes back to ready), ``archive`` (a
    tour). A direct delivery also sets the stop, if its tour is still active and the
    stop is not delivered already; a stop may so carry both times.
    """
    order = F.struct("ts", "seq")
    closed = events.where(F.col("kind") == "archive").groupBy("tour_id").agg(F.min(order).alias("_closed"))
    tours = events.where(F.col("tour_id").isNotNull()).groupBy("tour_id").agg(
        F.when(F.bool_or(F.col("kind") == "archive"), F.lit("archivee")).otherwise(F.lit("en_cours")).alias("statut")
    )

    parcel_status = (
        F.when(F.col("kind") == "failed", F.lit("echec"))
        .when(F.col("kind") == "report", F.lit("pret"))
        .otherwise(F.lit("livre"))
    )
    parcels = (
        events.where(F.col("kind") != "archive").where(F.col("colis_id").isNotNull())
        .groupBy("colis_id")
        .agg(F.max_by(parcel_status, order).alias("statut"))
    )

    touching = (
        events.where(F.col("kind").isin("delivered", "failed", "direct") & F.col("ordre").isNotNull())
        .join(closed, "tour_id", "left")
        .where((F.col("kind") != "direct") | F.col("_closed").isNull() | (order < F.col("_closed")))
        .drop("_closed")
    )
    day = F.datediff(F.col("ts"), F.lit("1970-01-01"))
    chained = previous_value(touching, ["tour_id", "ordre"], day, ["ts", "seq"], "kind", "_prev")
    # after a delivery, by whichever way, a further direct delivery changes nothing
    effective = (F.col("kind") != "direct") | F.col("_prev").isNull() | (F.col("_prev") == "failed")
    is_failed = F.col("kind") == "failed"
    stops = (
        chained.where(effective)
        .groupBy("tour_id", "ordre")
        .agg(
            F.max_by(F.when(is_failed, F.lit("echec")).otherwise(F.lit("livre")), order).alias("statut"),
            F.max(F.when(~is_failed, F.col("ts"))).alias("delivered_at"),
            F.max(F.when(is_failed, F.col("ts"))).alias("failed_at"),
            F.max_by("raison", F.when(is_failed, order)).alias("raison_echec"),
        )
    )
    return parcels, stops, tours


def daily_stats(tours: DataFrame, stops: DataFrame) -> DataFrame:
    """One row per UTC day: delivered, failed, estimated seconds, tours computed."""
    done = stops.select(
        F.explode(F.array(
            F.struct(F.to_date("delivered_at").alias("day"), (F.col("statut") == "livre").alias("hit"), F.lit("l").alias("k")),
            F.struct(F.to_date("failed_at").alias("day"), (F.col("statut") == "echec").alias("hit"), F.lit("e").alias("k")),
        )).alias("x")
    ).where(F.col("x.hit") & F.col("x.day").isNotNull())
    by_event = done.groupBy(F.col("x.day").alias("day")).agg(
        F.count_if(F.col("x.k") == "l").alias("livres"), F.count_if(F.col("x.k") == "e").alias("echecs")
    )
    by_tour = tours.where(F.col("date_creation").isNotNull()).groupBy(F.to_date("date_creation").alias("day")).agg(
        F.sum(F.coalesce("total_s", F.lit(0.0))).alias("duree_s"), F.count("*").alias("tours")
    )
    zero = {"livres": 0, "echecs": 0, "duree_s": 0.0, "tours": 0}
    return by_event.join(by_tour, "day", "full_outer").fillna(zero).select("day", "livres", "echecs", "duree_s", "tours")


def _anchors(tours: DataFrame, stops: DataFrame) -> DataFrame:
    """(tour_id, anchor_ordre, anchor): last treated stop with a time, else the tour's start."""
    when = F.coalesce("delivered_at", "failed_at")
    last = stops.where(treated() & when.isNotNull()).groupBy("tour_id").agg(
        F.max(F.struct("ordre", when.alias("t"))).alias("a")
    )
    return tours.join(last, "tour_id", "left").select(
        "tour_id", F.col("a.ordre").alias("anchor_ordre"), F.coalesce("a.t", "date_creation").alias("anchor")
    )


def _after(start: Column, seconds: Column) -> Column:
    """Time shifted by seconds, cut to whole milliseconds; null when not finite."""
    finite = F.when(F.abs(seconds) < INF, seconds)
    return F.timestamp_add("MILLISECOND", F.floor(finite * 1000).cast("bigint"), start)


def _ahead(tours: DataFrame, stops: DataFrame) -> DataFrame:
    anchors = _anchors(tours, stops)
    joined = stops.join(anchors, "tour_id")
    return joined.where(F.col("anchor_ordre").isNull() | (F.col("ordre") > F.col("anchor_ordre")))


def etas(tours: DataFrame, stops: DataFrame, dwell_s: float) -> DataFrame:
    """Stops behind the anchor with ``eta``: travel so far plus a stay at every earlier one."""
    summed = running_sums(
        _ahead(tours, stops), ["tour_id"], block_of(F.col("ordre")), ["ordre"],
        {"_drive": F.coalesce("leg_s", F.lit(0.0)), "_nth": F.lit(1).cast("bigint")},
    )
    seconds = F.col("_drive") + (F.col("_nth") - 1) * F.lit(float(dwell_s))
    return summed.select(*stops.columns, _after(F.col("anchor"), seconds).alias("eta"))


def depot_etas(tours: DataFrame, stops: DataFrame, dwell_s: float) -> DataFrame:
    """(tour_id, depot_eta) of tours that return: the drive back is the part of the tour's
    total that its legs do not account for."""
    leg = F.coalesce("leg_s", F.lit(0.0))
    behind = F.col("anchor_ordre").isNull() | (F.col("ordre") > F.col("anchor_ordre"))
    sums = stops.join(_anchors(tours, stops).drop("anchor"), "tour_id").groupBy("tour_id").agg(
        F.sum(leg).alias("all_legs"),
        F.sum(F.when(behind, leg).otherwise(F.lit(0.0))).alias("ahead_legs"),
        F.count_if(behind).alias("ahead_n"),
    )
    back = F.greatest(F.lit(0.0), F.coalesce("total_s", F.lit(0.0)) - F.coalesce("all_legs", F.lit(0.0)))
    seconds = F.coalesce("ahead_legs", F.lit(0.0)) + F.coalesce("ahead_n", F.lit(0)) * F.lit(float(dwell_s)) + back
    return (
        tours.where(F.col("return_to_depot"))
        .join(_anchors(tours, stops), "tour_id")
        .join(sums, "tour_id", "left")
        .select("tour_id", _after(F.col("anchor"), seconds).alias("depot_eta"))
    )


def preparation_summary(parcels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Parcel count by quantity, parcels to check and failed ones, of what is not delivered."""
    failed = F.coalesce(F.col("statut") == "echec", F.lit(False))
    prepared = ~failed & F.coalesce(F.col("statut") != "livre", F.lit(True))
    quantity = F.coalesce(F.nullif("quantite", F.lit(0)), F.lit(1))
    return parcels.groupBy(*(by or [])).agg(
        F.sum(F.when(prepared, quantity).otherwise(F.lit(0))).alias("total_qty"),
        F.count_if(prepared & (F.col("statut") == "a_verifier")).alias("to_check"),
        F.count_if(failed).alias("failed"),
    )


def failed_parcels(parcels: DataFrame) -> DataFrame:
    return parcels.where(F.col("statut") == "echec")


def progress(stops: DataFrame) -> DataFrame:
    """Per tour: delivered, failed, total and the share treated in whole percent."""
    counts = stops.groupBy("tour_id").agg(
        F.count_if(F.col("statut") == "livre").alias("delivered"),
        F.count_if(F.col("statut") == "echec").alias("failed"),
        F.count("*").alias("total"),
    )
    share = js_round((F.col("delivered") + F.col("failed")) / F.col("total") * 100)
    return counts.withColumn("percent", share.cast("bigint"))


def current_stop(stops: DataFrame, parcels: DataFrame) -> DataFrame:
    """Per tour the first pending stop whose parcel exists; null when all are treated."""
    open_stops = stops.where(pending()).join(parcels.select(F.col("id").alias("colis_id")), "colis_id", "left_semi")
    first = open_stops.groupBy("tour_id").agg(F.min(F.struct("ordre", "colis_id")).alias("s"))
    return stops.select("tour_id").distinct().join(first, "tour_id", "left").select(
        "tour_id", F.col("s.ordre").alias("ordre"), F.col("s.colis_id").alias("colis_id"),
        F.col("s").isNull().alias("all_treated"),
    )


def movable(stops: DataFrame) -> DataFrame:
    """Whether each stop may move up or down among the pending ones."""
    span = stops.where(pending()).groupBy("tour_id").agg(F.min("ordre").alias("_lo"), F.max("ordre").alias("_hi"))
    return stops.join(span, "tour_id", "left").select(
        *stops.columns,
        F.coalesce(pending() & (F.col("ordre") > F.col("_lo")), F.lit(False)).alias("can_move_up"),
        F.coalesce(pending() & (F.col("ordre") < F.col("_hi")), F.lit(False)).alias("can_move_down"),
    )


def stops_with_parcels(stops: DataFrame, parcels: DataFrame, how: str = "left") -> DataFrame:
    """Stops with their parcel's fields; ``left`` keeps stops whose parcel is gone, ``inner`` drops them."""
    side = parcels.select(
        F.col("id").alias("colis_id"), F.lit(True).alias("_found"),
        *[F.col(c).alias(f"colis_{c}") for c in parcels.columns if c != "id"],
    )
    joined = stops.join(side, "colis_id", how)
    return joined.withColumn("orphan", F.col("_found").isNull()).drop("_found")


def filter_stops(joined: DataFrame, needle: Column) -> DataFrame:
    """Stops whose parcel matches the text; stops without parcel always stay."""
    raw = F.col("colis_adresse_raw")
    hit = matches_text(needle, F.col("colis_nom"), raw["rue"], raw["cp"], raw["ville"])
    return joined.where(F.col("orphan") | hit)


def extent(*points: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Bounding box over any number of point tables, overall or per key."""
    keys = by or []
    boxes = None
    for df in points:
        located = df.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(*keys, "lat", "lon")
        boxes = located if boxes is None else boxes.unionByName(located)
    return boxes.groupBy(*keys).agg(
        F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"), F.min("lon").alias("min_lon"),
        F.max("lon").alias("max_lon"), F.count("*").alias("n"),
    )


def map_features(stops: DataFrame, parcels: DataFrame) -> DataFrame:
    """Located parcels with stop order, colour by status and whether the stop is treated."""
    colour = F.lit(OPEN_COLOUR)
    for status, code in STATUS_COLOURS.items():
        colour = F.when(F.col("p.statut") == status, F.lit(code)).otherwise(colour)
    placed = parcels.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return placed.alias("p").join(stops.alias("s"), F.col("p.id") == F.col("s.colis_id"), "left").select(
        F.col("s.tour_id").alias("tour_id"), F.col("s.ordre").alias("ordre"), F.col("p.id").alias("colis_id"),
        F.col("p.statut").alias("statut"), "p.lat", "p.lon", colour.alias("colour"),
        F.coalesce(F.col("s.statut").isin("livre", "echec"), F.lit(False)).alias("done"),
    )
