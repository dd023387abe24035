"""Nearest road node on a grid, snapping, and favourites near a point."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roundsman.functions.geo import haversine_m
from roundsman.functions.text import none_if_empty, text_or_empty
from roundsman.operators.tables import favourite_order, join_known
from roundsman.session import cut_lineage

# Grid step in degrees, widest ring, snapping and favourite distances in metres.
CELL_DEG = 0.005
MAX_RING = 80
SNAP_LIMIT_M = 2000.0
FAVOURITE_RADIUS_M = 60.0


def _cell(col: Column, step: float) -> Column:
    return F.floor(col / step).cast("bigint")


def _ring(dx: Column, dy: Column) -> Column:
    return F.greatest(F.abs(dx), F.abs(dy))


def _offsets(reach: int) -> Column:
    return F.sequence(F.lit(-reach).cast("bigint"), F.lit(reach).cast("bigint"))


def met_cells(point_cells: DataFrame, node_cells: DataFrame, reach: int) -> DataFrame:
    """(cx, cy, tx, ty, ring): occupied node cells (tx, ty) up to ``reach`` rings around each point cell.

    Both sides meet in squares as wide as the reach, of which a cell looks at nine.
    """
    wide = max(reach, 1)

    def square(col: Column) -> Column:
        return F.floor(col / wide).cast("bigint")

    def span(col: Column) -> Column:
        return F.explode(F.sequence(square(col - reach), square(col + reach)))

    around = point_cells.select("cx", "cy", span(F.col("cx")).alias("gx")).select("*", span(F.col("cy")).alias("gy"))
    placed = node_cells.select("tx", "ty", square(F.col("tx")).alias("gx"), square(F.col("ty")).alias("gy"))
    ring = _ring(F.col("tx") - F.col("cx"), F.col("ty") - F.col("cy"))
    return around.join(placed, ["gx", "gy"]).withColumn("ring", ring).where(F.col("ring") <= reach).drop("gx", "gy")


def cell_targets(point_cells: DataFrame, node_cells: DataFrame, max_ring: int = MAX_RING) -> DataFrame:
    """For each point cell, the occupied node cells of its first non-empty ring and the next one.

    Works on distinct cells, not on points or nodes. The reach doubles from one ring to
    ``max_ring``; a cell is settled once its first ring lies inside the reach by one, so that
    the next ring has been seen too, and only cells still open go on. A cell thus meets no
    more than about four times the cells of the rings it needs.
    """
    nodes = cut_lineage(node_cells.select(F.col("cx").alias("tx"), F.col("cy").alias("ty")))
    open_cells = cut_lineage(point_cells.select("cx", "cy"))
    found = []
    reach = min(1, max_ring)
    while True:
        met = met_cells(open_cells, nodes, reach)
        first = met.groupBy("cx", "cy").agg(F.min("ring").alias("first"))
        settled = first if reach >= max_ring else first.where(F.col("first") < reach)
        level = cut_lineage(
            met.join(settled, ["cx", "cy"]).where(F.col("ring") <= F.col("first") + 1).select("cx", "cy", "tx", "ty")
        )
        found.append(level)
        if reach >= max_ring:
            break
        open_cells = cut_lineage(open_cells.join(level.select("cx", "cy").distinct(), ["cx", "cy"], "left_anti"))
        if open_cells.isEmpty():
            break
        reach = min(2 * reach, max_ring)
    every = found[0]
    for level in found[1:]:
        every = every.unionByName(level)
    return every


def nearest_node(
    points: DataFrame, nodes: DataFrame, cell: float = CELL_DEG, max_ring: int = MAX_RING
) -> DataFrame:
    """Adds ``node`` and ``distance_m``: the closest node of the first non-empty ring of
    grid cells and of the ring after it; null when no ring up to ``max_ring`` has one.

    This is the grid's own notion of nearest, which can differ from the true nearest
    node. Equal distances go to the lowest node id. Points are compared once per
    distinct position.
    """
    spots = points.select("lat", "lon").where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).distinct()
    placed = spots.withColumn("cx", _cell(F.col("lon"), cell)).withColumn("cy", _cell(F.col("lat"), cell))
    grid = nodes.select(
        "node",
        F.col("lat").cast("double").alias("nlat"),
        F.col("lon").cast("double").alias("nlon"),
    )
    grid = grid.withColumn("tx", _cell(F.col("nlon"), cell)).withColumn("ty", _cell(F.col("nlat"), cell))
    targets = cell_targets(
        placed.select("cx", "cy").distinct(),
        grid.select(F.col("tx").alias("cx"), F.col("ty").alias("cy")).distinct(),
        max_ring,
    )
    distance = haversine_m(F.col("lat"), F.col("lon"), F.col("nlat"), F.col("nlon"))
    # cells fetch their nodes first, so a point travels to its cell once, not once per target cell
    offered = targets.join(grid, ["tx", "ty"]).select("cx", "cy", "node", "nlat", "nlon")
    # grouped by cell as well, so that offers are compared where points and nodes have met
    best = (
        placed.join(offered, ["cx", "cy"])
        .groupBy("cx", "cy", "lat", "lon")
        .agg(F.min(F.struct(distance.alias("d"), F.col("node").alias("node"))).alias("hit"))
        .drop("cx", "cy")
    )
    return join_known(points, best, ["lat", "lon"]).select(
        *points.columns, F.col("hit.node").alias("node"), F.col("hit.d").alias("distance_m")
    )


def snap_points(points: DataFrame, nodes: DataFrame, max_m: float = SNAP_LIMIT_M) -> DataFrame:
    """Nearest node with a warning flag; a point without any node falls back to node 0."""
    found = nearest_node(points, nodes)
    lost = F.col("node").isNull() | (F.col("distance_m") > max_m)
    return found.withColumn("unsnapped", lost).withColumn("node", F.coalesce("node", F.lit(0)))


def _bands(radius_m: float) -> tuple[float, Column]:
    """Latitude step covering ``radius_m`` with a margin, as degrees."""
    step = radius_m / 111_000 * 1.1
    return step, F.floor(F.col("lat") / step).cast("bigint")


def _columns_in_band(band: Column, step: float) -> Column:
    """Number of longitude cells in a latitude band so that each is at least ``step`` wide on the ground."""
    top = F.greatest(F.abs(band * step), F.abs((band + 1) * step))
    shrink = F.cos(F.radians(F.least(top, F.lit(90.0))))
    return F.greatest(F.lit(1.0), F.floor(shrink * (360 / step))).cast("bigint")


def _column_of(lon: Column, count: Column) -> Column:
    return F.pmod(F.floor((lon + 180) / 360 * count).cast("bigint"), count)


def nearest_favourite(points: DataFrame, favourites: DataFrame, radius_m: float = FAVOURITE_RADIUS_M) -> DataFrame:
    """Adds ``favori`` (the whole record) and ``favori_m``: the closest favourite within
    ``radius_m``, inclusive; ties go to the first of the favourites list.

    Favourites are entered in the nine cells around them; longitude cells follow the
    latitude band and wrap at the date line, so no pair within the radius is missed. Only
    ids and coordinates go into the cells; records are fetched for the closest ones.
    """
    step, band = _bands(radius_m)
    lists = favourites.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    around = (
        lists.select("id", "lat", "lon", F.explode(F.transform(_offsets(1), lambda o: band + o)).alias("band"))
        .withColumn("_count", _columns_in_band(F.col("band"), step))
        .select(
            "id",
            F.col("lat").alias("flat"),
            F.col("lon").alias("flon"),
            "band",
            F.explode(
                F.array_distinct(
                    F.transform(
                        _offsets(1), lambda o: F.pmod(_column_of(F.col("lon"), F.col("_count")) + o, F.col("_count"))
                    )
                )
            ).alias("col"),
        )
    )
    spots = points.select("lat", "lon").where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).distinct()
    placed = spots.withColumn("band", band).withColumn("col", _column_of(F.col("lon"), _columns_in_band(band, step)))
    distance = haversine_m(F.col("lat"), F.col("lon"), F.col("flat"), F.col("flon"))
    near = placed.join(around, ["band", "col"]).select("lat", "lon", "id", distance.alias("d")).where(F.col("d") <= radius_m)
    least = near.groupBy("lat", "lon").agg(F.min("d").alias("d"))
    # favourites as close as the closest: one, but for ties, which go by the order of the list
    closest = near.join(least, ["lat", "lon", "d"]).withColumnRenamed("id", "_id")
    records = lists.select(
        F.col("id").alias("_fid"), F.struct(*favourites.columns).alias("favori"),
        *[key.alias(f"_k{i}") for i, key in enumerate(favourite_order())],
    )
    best = closest.join(records, F.col("_id").eqNullSafe(F.col("_fid"))).groupBy("lat", "lon").agg(
        F.min_by(F.struct("favori", "d"), F.struct("d", "_k0", "_k1", "favori.id")).alias("hit")
    )
    return join_known(points, best, ["lat", "lon"]).select(
        *points.columns, F.col("hit.favori").alias("favori"), F.col("hit.d").alias("favori_m")
    )


def favourite_alerts(parcels: DataFrame, favourites: DataFrame) -> DataFrame:
    """Parcels whose nearest favourite carries a note."""
    hit = nearest_favourite(parcels, favourites)
    return hit.where(none_if_empty(F.col("favori.note")).isNotNull())


def upsert_note(notes: DataFrame, favourites: DataFrame, new_id: Column | None = None) -> DataFrame:
    """Favourites after a batch of notes (seq, lat, lon, rue, cp, ville, note).

    A note near a favourite replaces that favourite's note, the last one winning; any
    other non-blank note founds a favourite. Notes of one batch do not see each other.
    """
    hit = nearest_favourite(notes, favourites)
    known = F.col("favori").isNotNull()
    last = hit.where(known).groupBy(F.col("favori.id").alias("id")).agg(F.max_by("note", "seq").alias("_note"), F.lit(True).alias("_set"))
    kept = favourites.join(last, "id", "left").select(
        *[
            F.when(F.col("_set"), F.col("_note")).otherwise(F.col("note")).alias("note") if c == "note" else F.col(c)
            for c in favourites.columns
        ]
    )
    blank = F.trim(text_or_empty(F.col("note"))) == ""
    made = hit.where(~known & ~blank).select(
        (F.uuid() if new_id is None else new_id).alias("id"),
        *[text_or_empty(F.col(c)).alias(c) for c in ("rue", "cp", "ville")],
        "lat",
        "lon",
        "note",
    )
    return kept.unionByName(made, allowMissingColumns=True)
