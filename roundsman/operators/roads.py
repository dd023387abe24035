"""Travel times and paths on a road graph with turn restrictions.

The state of a search is a directed edge: ``edges(e, u, v, w)`` are road pieces and
``turns(e, f)`` lists which edge may follow which. Neighbouring sources are searched in one task,
see ``roundsman.operators.reach``; where what they reach is too much for a task, all sources advance
together in the rounds of ``roundsman.operators.regions``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from roundsman.operators.ordering import link_rows
from roundsman.operators.reach import Reach
from roundsman.operators.regions import Search
from roundsman.session import cut_lineage, prepare, stored

# Fixed value: longest travel time looked for, in seconds.
MAX_SECONDS = 3600.0

#: Points of a tour that one row of a matrix in lists holds at most.
LIST = 256


def shortest_times(
    sources: DataFrame, edges: DataFrame, turns: DataFrame, max_s: float = MAX_SECONDS, targets: DataFrame | None = None
) -> DataFrame:
    """(source, node, seconds) for every node reached within ``max_s``; the source itself
    is at 0. A pair without a row is unreachable.

    With ``targets(source, target)`` only those pairs come back, and a source is searched no
    farther than its farthest target. Null sources have no row.
    """
    prepare(edges.sparkSession)
    kind = sources.schema["source"].dataType
    far = None if targets is None else targets.where("source <> target")
    reach = Reach(sources, edges, turns, max_s, targets=far)
    arrived = reach.times()
    if reach.wide is not None:
        more = reach.wide.select("source")
        own = None if targets is None else _unlisted(reach.wide)
        arrived = arrived.unionByName(Search(more, edges, turns, max_s, targets=own).arrivals().select(*arrived.columns))
    arrived = arrived.select(
        F.col("source").cast(kind).alias("source"), F.col("node").cast(kind).alias("node"), "seconds"
    )
    own = sources.where("source IS NOT NULL") if targets is None else targets.where("source = target")
    own = own.select("source").distinct().select("source", F.col("source").alias("node"), F.lit(0.0).alias("seconds"))
    return arrived.where(F.col("source") != F.col("node")).unionByName(own)


def time_matrix(
    points: DataFrame, edges: DataFrame, turns: DataFrame, max_s: float = MAX_SECONDS, lists: bool = False
) -> DataFrame:
    """(tour_id, i, j, seconds) over the points (tour_id, i, node) of every tour.

    The result is each tour's full matrix, the input every ordering step needs;
    unreachable pairs hold infinity. Searches run once per distinct node of the
    whole fleet, however many tours stop there, and look only for the nodes that share a
    tour with it. With ``lists`` a row holds points ``j`` of its tour, all or ``LIST`` of them, and the ``seconds`` to them.
    """
    prepare(edges.sparkSession)
    spots = points.where("tour_id IS NOT NULL").select("tour_id", "i", F.col("node").cast("long").alias("source"))
    whole = spots.groupBy("tour_id").agg(F.collect_list(F.struct(F.col("i").alias("j"), F.col("source").alias("b"))).alias("p"))
    whole = stored(whole)  # read for the searches and for the matrix
    some = F.explode(F.transform(F.sequence(F.lit(1), F.size("p"), F.lit(LIST)), lambda start: F.slice("p", start, LIST)))
    asked = whole.select("tour_id", "p", some.alias("q")).select("tour_id", "q", F.explode("p").alias("x")).select(
        "tour_id", F.col("x.j").alias("i"), F.col("x.b").alias("source"), F.col("q.j").alias("j"), F.col("q.b").alias("b")
    )
    reach = Reach(spots, edges, turns, max_s, targets=asked.select("source", F.array_distinct("b").alias("targets")))
    found = reach.matrix(spots, asked)
    nowhere = asked.where("source IS NULL").select("tour_id", "i", "j", F.array_repeat(F.lit(float("inf")), F.size("j")).alias("seconds"))
    found = found.unionByName(nowhere)
    if reach.wide is not None:
        found = found.unionByName(_wide_rows(asked, reach, edges, turns, max_s))
    else:
        prepare(edges.sparkSession, flat_rows=True)  # lists are short, so rows bound a batch well enough
    return found if lists else link_rows(found)


def _wide_rows(asked: DataFrame, reach: Reach, edges: DataFrame, turns: DataFrame, max_s: float) -> DataFrame:
    """Matrix rows of points whose node belongs to a group that goes by rounds."""
    search = Search(reach.wide.select("source"), edges, turns, max_s, targets=_unlisted(reach.wide))
    times = search.arrivals().select("source", F.col("node").alias("b"), F.col("seconds").alias("s"))
    asked = asked.where("source IS NOT NULL").withColumn("home", reach.home).join(reach.wide_homes, "home", "left_semi")
    pairs = asked.select("tour_id", "i", "source", F.explode(F.arrays_zip("j", "b")).alias("x")).select("tour_id", "i", "source", "x.j", "x.b")
    seconds = F.when(F.col("source") == F.col("b"), F.lit(0.0)).otherwise(F.coalesce("s", F.lit(float("inf"))))
    # merged, not broadcast: what the searches bring is far larger than the rows they start from
    timed = pairs.join(times.hint("merge"), ["source", "b"], "left").select("tour_id", "i", F.struct("j", seconds.alias("seconds")).alias("x"))
    return timed.groupBy("tour_id", "i").agg(F.collect_list("x").alias("x")).select("tour_id", "i", "x.j", "x.seconds")


def _unlisted(wide: DataFrame) -> DataFrame:
    return wide.select("source", F.explode("targets").alias("target"))


def _ways(
    pairs: DataFrame, edges: DataFrame, turns: DataFrame, max_s: float, places: DataFrame | None = None
) -> DataFrame:
    """(source, target, seconds, nodes, lat, lon): the ways to all reached targets but the sources themselves, see ``Reach.ways``."""
    prepare(edges.sparkSession)
    wanted = pairs.select("source", "target").where("source <> target")
    reach = Reach(wanted.select("source"), edges, turns, max_s, cap_seeds=False, targets=wanted, places=places)
    found = reach.ways()
    if reach.wide is None:
        return found
    wide = cut_lineage(_unlisted(reach.wide))
    search = Search(wide.select("source"), edges, turns, max_s, cap_seeds=False, targets=wide)
    ends = cut_lineage(search.arrivals().withColumnRenamed("node", "target"))
    # node lists of the regions driven through, in driving order and without the source
    pieces = search.walks(ends).groupBy("source", "target").agg(
        F.reverse(F.transform(F.array_sort(F.collect_list(F.struct("piece", "nodes"))), lambda x: x["nodes"])).alias("pieces")
    )
    more = ends.select("source", "target", "seconds").join(pieces, ["source", "target"]).select(
        "source", "target", "seconds", F.concat(F.array("source"), F.flatten("pieces")).alias("nodes")
    )
    if places is None:
        return found.unionByName(more, allowMissingColumns=True)
    lines = (
        more.select("source", "target", "seconds", F.posexplode("nodes").alias("p", "node"))
        .join(places, "node")
        .groupBy("source", "target", "seconds")
        .agg(F.array_sort(F.collect_list(F.struct("p", "lat", "lon"))).alias("l"))
        .select("source", "target", "seconds", F.col("l.lat").alias("lat"), F.col("l.lon").alias("lon"))
    )
    return found.unionByName(lines, allowMissingColumns=True)


def shortest_paths(
    pairs: DataFrame, edges: DataFrame, turns: DataFrame, max_s: float = MAX_SECONDS
) -> DataFrame:
    """Pairs (source, target) with ``nodes``, the node sequence of a fastest path, and its ``seconds``.

    ``nodes`` is the single node for a pair of equal ends and null without a path, as
    ``seconds`` is. Among equally fast paths the one through the lowest edge ids wins, looked
    at from the target back to the source.
    """
    kind = pairs.schema["source"].dataType
    found = _ways(pairs, edges, turns, max_s).select(
        F.col("source").cast(kind).alias("source"), F.col("target").cast(kind).alias("target"), F.col("seconds").alias("way_s"),
        F.col("nodes").cast(ArrayType(kind)).alias("way"),
    )
    same = F.col("source") == F.col("target")
    return pairs.join(found.hint("merge"), ["source", "target"], "left").select(
        *pairs.columns, F.coalesce("way", F.when(same, F.array("source"))).alias("nodes"),
        F.coalesce("way_s", F.when(same, F.lit(0.0))).alias("seconds"),
    )


def route_points(tours: DataFrame, stops: DataFrame) -> DataFrame:
    """Way points of every tour in order: depot, stops with coordinates, return point if any.

    ``done`` tells whether the leg that ends there has been driven; the return leg has
    once every stop is treated.
    """
    from roundsman.operators.ranges import block_of, number_rows
    from roundsman.operators.status import treated

    located = stops.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    placed = number_rows(located, ["tour_id"], block_of(F.col("ordre")), ["ordre"], "pos").select(
        "tour_id", F.col("pos").cast("bigint").alias("pos"), "lat", "lon", treated().alias("done")
    )
    depot = tours.select(
        "tour_id", F.lit(0).cast("bigint").alias("pos"), F.col("depot_lat").alias("lat"), F.col("depot_lon").alias("lon"),
        F.lit(None).cast("boolean").alias("done"),
    )
    tally = placed.groupBy("tour_id").agg(F.max("pos").alias("n"), F.bool_and("done").alias("all_done"))
    back = (
        tours.where(F.col("return_to_depot") & F.col("return_lat").isNotNull())
        .join(tally, "tour_id", "left")
        .select(
            "tour_id", (F.coalesce("n", F.lit(0)) + 1).alias("pos"), F.col("return_lat").alias("lat"),
            F.col("return_lon").alias("lon"), F.coalesce("all_done", F.lit(False)).alias("done"),
        )
    )
    return depot.unionByName(placed).unionByName(back)


def route_segments(
    points: DataFrame, nodes: DataFrame, edges: DataFrame, turns: DataFrame, max_s: float = MAX_SECONDS
) -> DataFrame:
    """(tour_id, leg, line, done): coordinates along the roads between consecutive way
    points, a straight line where the roads do not connect them."""
    from roundsman.operators.spatial import nearest_node

    snapped = cut_lineage(nearest_node(points, nodes).select("tour_id", "pos", "lat", "lon", "done", "node"))
    ahead = snapped.select(
        "tour_id", (F.col("pos") - 1).alias("pos"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"),
        F.col("node").alias("target"), F.col("done").alias("leg_done"),
    )
    legs = snapped.drop("done").withColumnRenamed("node", "source").join(ahead, ["tour_id", "pos"])
    linked = legs.where(F.col("source").isNotNull() & F.col("target").isNotNull()).select("source", "target").distinct()
    place = nodes.select("node", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    lines = _ways(linked, edges, turns, max_s, place).select("source", "target", F.col("lat").alias("lats"), F.col("lon").alias("lons"))
    straight = F.array(
        F.struct(F.col("lat"), F.col("lon")), F.struct(F.col("lat2").alias("lat"), F.col("lon2").alias("lon"))
    )
    # coordinates travel as two plain lists, half the size of a list of pairs
    road = F.zip_with("lats", "lons", lambda lat, lon: F.struct(lat.alias("lat"), lon.alias("lon")))
    road = F.when(F.size("lats") > 0, road)
    return legs.join(lines.hint("merge"), ["source", "target"], "left").select(
        "tour_id", F.col("pos").alias("leg"), F.coalesce(road, straight).alias("line"),
        F.coalesce("leg_done", F.lit(False)).alias("done"),
    )


def graph_stats(nodes: DataFrame, edges: DataFrame, turns: DataFrame) -> DataFrame:
    """One row: sizes, largest degrees, nodes without a way out or in."""
    out = edges.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("out_n"))
    into = edges.groupBy(F.col("v").alias("node")).agg(F.count("*").alias("in_n"))
    per_node = nodes.select("node").join(out, "node", "left").join(into, "node", "left")
    by_node = per_node.agg(
        F.count("*").alias("nodes"),
        F.coalesce(F.max("out_n"), F.lit(0)).alias("max_out"),
        F.coalesce(F.max("in_n"), F.lit(0)).alias("max_in"),
        F.count_if(F.col("out_n").isNull()).alias("no_way_out"),
        F.count_if(F.col("in_n").isNull()).alias("no_way_in"),
    )
    parts = (by_node, edges.agg(F.count("*").alias("edges")), turns.agg(F.count("*").alias("turns")))
    rows = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def community_rollup(nodes: DataFrame) -> DataFrame:
    """Members per community, biggest first; unnamed ones go by their number."""
    named = F.coalesce(
        F.when(F.col("community_name") != "", F.col("community_name")),
        F.concat(F.lit("Communauté "), F.col("community").cast("string")),
    )
    return nodes.groupBy(named.alias("community")).agg(F.count("*").alias("members")).orderBy(F.desc("members"), "community")


def node_link_report(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """One row per link end and one per isolated node: (node, direction, relation, other, inferred).

    Links to unknown nodes are skipped, yet they count as a connection, so their known
    end is not isolated. Rows stay apart instead of being collected per node.
    """
    names = nodes.select(F.col("id").alias("other"), F.col("label").alias("other_label"))

    def side(own: str, far: str, direction: str) -> DataFrame:
        known = nodes.select(F.col("id").alias("node"))
        return (
            links.select(
                F.col(own).alias("node"), F.col(far).alias("other"), "relation",
                (F.coalesce(F.col("confidence"), F.lit("")) == "INFERRED").alias("inferred"),
            )
            .join(known, "node")
            .join(names, "other")
            .select("node", F.lit(direction).alias("direction"), "relation", "other", "other_label", "inferred")
        )

    touched = links.select(F.col("source").alias("id")).union(links.select(F.col("target").alias("id")))
    alone = nodes.join(touched, "id", "left_anti").select(
        F.col("id").alias("node"), F.lit("isolated").alias("direction"), F.lit(None).cast("string").alias("relation"),
        F.lit(None).cast(nodes.schema["id"].dataType).alias("other"), F.lit(None).cast("string").alias("other_label"),
        F.lit(False).alias("inferred"),
    )
    return side("source", "target", "out").unionByName(side("target", "source", "in")).unionByName(alone)
