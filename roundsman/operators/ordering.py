"""Visiting order of all tours at once: cost, nearest neighbour, 2-opt.

Points of a tour are numbered; 0 is the start. ``matrix(tour_id, i, j, seconds)`` is
asymmetric and may hold infinity; it may also come in lists, a row then holds the seconds from ``i`` to
many or all points ``j`` of the tour. An order lists (tour_id, pos, i), ``pos`` from 0,
without the start.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roundsman.operators import batch_order
from roundsman.operators.ranges import block_of, number_rows, running_sums
from roundsman.session import cut_lineage, round_settings

INF = float("inf")

# the code travels with the task, so executors need not have this package installed
cloudpickle.register_pickle_by_value(batch_order)

# Smallest gain that counts, and fewest movable stops worth improving.
MIN_GAIN = 1e-9
MIN_MOVABLE = 4

#: Tours up to this many points are ordered inside a task (a matrix of 8 megabytes, from about
#: 50 megabytes of rows); bigger ones go through one DataFrame round per step, by the same rule.
SMALL_TOUR = 1024


def _finite(seconds: Column) -> Column:
    return F.coalesce(seconds < INF, F.lit(False))


def _in_lists(matrix: DataFrame) -> bool:
    return isinstance(matrix.schema["j"].dataType, T.ArrayType)


def link_rows(matrix: DataFrame) -> DataFrame:
    """A matrix with a row per link."""
    if not _in_lists(matrix):
        return matrix
    return matrix.select("tour_id", "i", F.explode(F.arrays_zip("j", "seconds")).alias("_x")).select("tour_id", "i", "_x.j", "_x.seconds")


def link_seconds(rows: DataFrame, matrix: DataFrame) -> DataFrame:
    """``rows(tour_id, i, j)`` with the ``seconds`` of their link, null for one the matrix does not list."""
    if not _in_lists(matrix):
        return rows.join(matrix.select("tour_id", "i", "j", "seconds"), ["tour_id", "i", "j"], "left")
    # the lists of a point hold all points of the tour, so a row that has met them finds its link in one
    lists = matrix.select("tour_id", "i", F.arrays_zip("j", "seconds").alias("_x"))
    met = rows.join(lists, ["tour_id", "i"], "left").select(*rows.columns, F.explode_outer("_x").alias("_x"))
    return met.where(F.col("_x").isNull() | (F.col("_x.j") == F.col("j"))).select(*rows.columns, F.col("_x.seconds").alias("seconds"))


def legs(orders: DataFrame, matrix: DataFrame) -> DataFrame:
    """Orders with ``seconds``, the travel time from the place before.

    The orders are hashed and the matrix, of many more rows, streams past them unsorted.
    """
    before = orders.select("tour_id", (F.col("pos") + 1).alias("pos"), F.col("i").alias("prev"))
    chained = orders.join(before, ["tour_id", "pos"], "left").withColumn("prev", F.coalesce("prev", F.lit(0)))
    hops = chained.withColumnsRenamed({"i": "j"}).withColumnsRenamed({"prev": "i"}).hint("shuffle_hash")
    return link_seconds(hops, matrix).select(
        *[F.col("j" if c == "i" else c).alias(c) for c in orders.columns], F.coalesce("seconds", F.lit(INF)).alias("seconds")
    )


def tour_cost(orders: DataFrame, matrix: DataFrame, penalty_s: float) -> DataFrame:
    """(tour_id, cost): driving time plus position times ``penalty_s`` for each stop due
    before noon (``avant12h``)."""
    late = F.when(F.col("avant12h"), F.col("pos") * F.lit(float(penalty_s))).otherwise(F.lit(0.0))
    return legs(orders, matrix).groupBy("tour_id").agg(F.sum(F.col("seconds") + late).alias("cost"))


def _small_tours(
    points: DataFrame, matrix: DataFrame, walk: bool, improve: bool, penalty_s: float = 0.0, max_rounds: int | None = None
) -> DataFrame:
    """(tour_id, pos, i, avant12h, locked, seconds) of tours that fit a task.

    One shuffle by tour brings the point rows (marked i = -1, point in j) and the matrix
    rows together, sorted by tour alone (one long key, where three would be compared row by
    row); a partition streams through in Arrow batches.
    """
    none = F.lit(None)
    at, nil, j, seconds = F.col("i").cast("bigint"), F.lit(0.0), F.col("j").cast("bigint"), F.col("seconds").cast("double")
    if _in_lists(matrix):
        at, nil, j, seconds = F.array("i").cast(matrix.schema["j"].dataType), F.array(nil), F.col("j"), F.col("seconds")
    rows = points.select(
        "tour_id", F.lit(-1).cast("bigint").alias("i"), at.alias("j"), nil.alias("seconds"),
        F.col("pos").cast("bigint").alias("pos"), F.coalesce("avant12h", F.lit(False)).alias("avant12h"),
        F.coalesce("locked", F.lit(False)).alias("locked"),
    )
    links = matrix.select(
        "tour_id", F.col("i").cast("bigint").alias("i"), j.alias("j"), seconds.alias("seconds"),
        none.cast("bigint").alias("pos"), none.cast("boolean").alias("avant12h"), none.cast("boolean").alias("locked"),
    )
    kind = points.schema["tour_id"].dataType
    schema = T.StructType([T.StructField("tour_id", kind)] + [
        T.StructField(n, t) for n, t in (
            ("pos", T.LongType()), ("i", T.LongType()), ("avant12h", T.BooleanType()), ("locked", T.BooleanType()),
            ("seconds", T.DoubleType()),
        )
    ])
    # Hashing a hash of the tour: repartition("tour_id") would be dropped as redundant when
    # both sides come from joins on the tour, although AQE may still regroup those sides.
    together = rows.unionByName(links).repartition(F.xxhash64("tour_id")).sortWithinPartitions("tour_id")
    return together.mapInArrow(batch_order.solve_partition(walk, improve, penalty_s, MIN_GAIN, MIN_MOVABLE, max_rounds), schema)


def _by_size(points: DataFrame, matrix: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, bool]:
    """(small points, small matrix, big points, big matrix, any big): split by the checked tour size."""
    sizes = points.groupBy("tour_id").agg(F.count("*").alias("_n"))
    big = sizes.where(F.col("_n") > SMALL_TOUR).select("tour_id")
    if big.isEmpty():
        return points, matrix, points, matrix, False
    big = cut_lineage(big)

    def only(df: DataFrame, how: str) -> DataFrame:
        return df.join(big, "tour_id", how)

    far = link_rows(only(matrix, "left_semi"))
    return only(points, "left_anti"), only(matrix, "left_anti"), only(points, "left_semi"), far, True


def _as_points(orders: DataFrame) -> DataFrame:
    """Order rows plus the start of every tour."""
    start = orders.select("tour_id").distinct().select(
        "tour_id", F.lit(0).cast("bigint").alias("i"), F.lit(-1).cast("bigint").alias("pos"),
        F.lit(False).alias("avant12h"), F.lit(False).alias("locked"),
    )
    return orders.select("tour_id", "i", "pos", "avant12h", "locked").unionByName(start)


def _walk_points(points: DataFrame) -> DataFrame:
    noon = F.col("avant12h") if "avant12h" in points.columns else F.lit(False)
    return points.select(
        "tour_id", "i", F.lit(-1).cast("bigint").alias("pos"), noon.alias("avant12h"), F.col("fixed_end").alias("locked")
    )


def nearest_neighbor(points: DataFrame, matrix: DataFrame) -> DataFrame:
    """(tour_id, pos, i): always on to the closest open point, lowest number on a tie.

    ``points(tour_id, i, fixed_end)`` includes the start. Points that cannot be reached
    from where the walk stops follow in number order; a fixed end comes last.
    """
    small, small_m, big, big_m, any_big = _by_size(points, matrix)
    near = _small_tours(_walk_points(small), small_m, True, False).select("tour_id", "pos", "i")
    return near.unionByName(walk_by_rounds(big, big_m)) if any_big else near


def walk_by_rounds(points: DataFrame, matrix: DataFrame) -> DataFrame:
    """``nearest_neighbor`` for tours of any size: one round places one stop in every tour.

    The matrix stays partitioned by (tour_id, i); a round moves one matrix row per open
    point.
    """
    spark = matrix.sparkSession
    movable = points.where((F.col("i") != 0) & ~F.col("fixed_end")).select("tour_id", "i")
    with round_settings(spark, matrix.count()) as parts:
        open_legs = (
            matrix.where((F.col("i") != F.col("j")) & _finite(F.col("seconds")))
            .join(movable.withColumnRenamed("i", "j"), ["tour_id", "j"], "left_semi")
            .select("tour_id", "i", "j", "seconds")
        )
        open_legs = cut_lineage(open_legs.repartition(parts, "tour_id", "i"))
        placed = cut_lineage(
            movable.select("tour_id").distinct().select(
                "tour_id", F.lit(-1).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("i")
            )
        )
        at = -1
        while not placed.where(F.col("pos") == at).isEmpty():
            here = placed.where(F.col("pos") == at).select("tour_id", "i")
            at += 1
            choice = (
                here.join(open_legs, ["tour_id", "i"])
                .select("tour_id", "j", "seconds")
                .join(placed.select("tour_id", F.col("i").alias("j")), ["tour_id", "j"], "left_anti")
                .groupBy("tour_id")
                .agg(F.min(F.struct("seconds", "j")).alias("s"))
                .select("tour_id", F.lit(at).cast("bigint").alias("pos"), F.col("s.j").cast("bigint").alias("i"))
            )
            placed = cut_lineage(placed.unionByName(choice))
    walked = placed.where(F.col("pos") >= 0)
    rest = movable.join(walked.select("tour_id", "i"), ["tour_id", "i"], "left_anti")
    sizes = walked.groupBy("tour_id").agg(F.count("*").alias("n"))
    appended = (
        number_rows(rest, ["tour_id"], block_of(F.col("i")), ["i"], "k")
        .join(sizes, "tour_id", "left")
        .select("tour_id", (F.coalesce("n", F.lit(0)) + F.col("k") - 1).alias("pos"), "i")
    )
    count = movable.groupBy("tour_id").agg(F.count("*").alias("n"))
    ends = points.where(F.col("fixed_end")).join(count, "tour_id", "left").select(
        "tour_id", F.coalesce("n", F.lit(0)).alias("pos"), "i"
    )
    return walked.unionByName(appended).unionByName(ends)


def _with_prefixes(order: DataFrame, by_pair: DataFrame, penalty_s: float) -> DataFrame:
    """Adds what is needed to price a reversal from its two ends in constant time.

    ``f*`` run along the order, ``r*`` against it, ``q`` adds the noon penalties and
    ``c`` counts noon stops; infinite legs are counted apart (``*_inf``) because
    infinity cannot be subtracted again. One row per tour at position -1 stands for
    the start.
    """
    before = order.select("tour_id", (F.col("pos") + 1).alias("pos"), F.col("i").alias("prev"))
    linked = order.join(before, ["tour_id", "pos"], "left").withColumn("prev", F.coalesce("prev", F.lit(0)))
    links = linked.select(
        "tour_id", "pos",
        F.explode(F.array(
            F.struct(F.col("prev").alias("i"), F.col("i").alias("j"), F.lit(True).alias("ahead")),
            F.struct(F.col("i").alias("i"), F.col("prev").alias("j"), F.lit(False).alias("ahead")),
        )).alias("h"),
    ).select("tour_id", "pos", "h.*")
    timed = links.join(by_pair, ["tour_id", "i", "j"], "left").groupBy("tour_id", "pos").agg(
        F.coalesce(F.max(F.when(F.col("ahead"), F.col("seconds"))), F.lit(INF)).alias("fs"),
        F.coalesce(F.max(F.when(~F.col("ahead"), F.col("seconds"))), F.lit(INF)).alias("rs"),
    )

    def finite(col: str) -> Column:
        return F.when(_finite(F.col(col)), F.col(col)).otherwise(F.lit(0.0))

    def infinite(col: str) -> Column:
        return F.when(_finite(F.col(col)), F.lit(0)).otherwise(F.lit(1)).cast("bigint")

    inner = F.col("pos") > 0  # the link between start and first stop is never driven backwards
    noon = F.col("avant12h").cast("bigint")
    summed = cut_lineage(running_sums(
        order.join(timed, ["tour_id", "pos"]), ["tour_id"], block_of(F.col("pos")), ["pos"],
        {
            "f": finite("fs"), "f_inf": infinite("fs"),
            "r": F.when(inner, finite("rs")).otherwise(F.lit(0.0)),
            "r_inf": F.when(inner, infinite("rs")).otherwise(F.lit(0).cast("bigint")),
            "q": noon * F.col("pos") * F.lit(float(penalty_s)), "c": noon,
        },
    ).drop("fs", "rs"))
    start = summed.select("tour_id", "active", "ca", "cb").distinct().select(
        "tour_id", F.lit(-1).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("i"), F.lit(False).alias("avant12h"),
        F.lit(False).alias("locked"), "active", "ca", "cb",
        F.lit(0.0).alias("f"), F.lit(0).cast("bigint").alias("f_inf"), F.lit(0.0).alias("r"),
        F.lit(0).cast("bigint").alias("r_inf"), F.lit(0.0).alias("q"), F.lit(0).cast("bigint").alias("c"),
    )
    rows = summed.select(*start.columns).unionByName(start)
    nxt = summed.select(
        "tour_id", (F.col("pos") - 1).alias("pos"), F.col("f").alias("nf"), F.col("f_inf").alias("nf_inf"),
        F.col("r").alias("nr"), F.col("r_inf").alias("nr_inf"), F.lit(True).alias("has_next"),
    )
    total = summed.groupBy("tour_id").agg(F.max("f_inf").alias("total_inf"))
    return rows.join(nxt, ["tour_id", "pos"], "left").join(total, "tour_id")


def _best_moves(rows: DataFrame, by_from: DataFrame, penalty_s: float) -> DataFrame:
    """(tour_id, a, b): the next improving reversal of each tour in scan order.

    Reversing positions a..b adds the links (a-1 → b) and (a → b+1). Every matrix row
    is one of these links for exactly one reversal each way round, so moves come out of
    the matrix by two look-ups and a group-by, never by pairing stops.
    """
    a_side = rows.select(
        "tour_id", "i", F.col("pos").alias("pi"), "ca", "cb", "total_inf",
        F.col("f").alias("f0"), F.col("f_inf").alias("f0_inf"), F.col("q").alias("q0"), F.col("c").alias("c0"),
        F.col("nr").alias("ra"), F.col("nr_inf").alias("ra_inf"),
    )
    b_side = rows.where(F.col("pos") >= 0).select(
        "tour_id", F.col("i").alias("j"), F.col("pos").alias("pj"), F.col("locked").alias("j_locked"),
        F.coalesce("nf", "f").alias("f1"), F.coalesce("nf_inf", "f_inf").alias("f1_inf"),
        F.col("q").alias("q1"), F.col("c").alias("c1"), F.col("r").alias("rb"), F.col("r_inf").alias("rb_inf"),
        F.coalesce("has_next", F.lit(False)).cast("bigint").alias("nexts"),
    )
    pairs = (
        by_from.join(a_side, ["tour_id", "i"])
        .join(b_side, ["tour_id", "j"])
        .where(F.col("pj") >= F.col("pi") + 2)
    )
    ok = _finite(F.col("seconds"))
    secs, inf = F.when(ok, F.col("seconds")).otherwise(F.lit(0.0)), F.when(ok, F.lit(0)).otherwise(F.lit(1)).cast("bigint")
    w = float(penalty_s)
    a, b = F.col("pi") + 1, F.col("pj")
    noon = (a + b) * (F.col("c1") - F.col("c0")) * w - 2 * (F.col("q1") - F.col("q0"))
    opening = F.struct(
        a.alias("a"), b.alias("b"), (~F.col("j_locked")).alias("movable"), F.lit(1).alias("opens"), F.col("nexts").alias("closes"),
        (secs + (F.col("rb") - F.col("ra")) - (F.col("f1") - F.col("f0")) + noon).alias("gain"),
        (inf + (F.col("rb_inf") - F.col("ra_inf")) - (F.col("f1_inf") - F.col("f0_inf"))).alias("gain_inf"),
    )
    closing = F.struct(
        F.col("pi").alias("a"), (F.col("pj") - 1).alias("b"), F.lit(True).alias("movable"), F.lit(0).alias("opens"), F.lit(-1).cast("bigint").alias("closes"),
        secs.alias("gain"), inf.alias("gain_inf"),
    )
    moves = (
        pairs.select("tour_id", "ca", "cb", "total_inf", F.explode(F.array(opening, closing)).alias("m"))
        .select("tour_id", "ca", "cb", "total_inf", "m.*")
        .where((F.col("a") >= 0) & (F.col("b") > F.col("a")))
        .groupBy("tour_id", "a", "b")
        .agg(
            F.min("ca").alias("ca"), F.min("cb").alias("cb"), F.min("total_inf").alias("total_inf"),
            F.min("movable").alias("movable"), F.sum("opens").alias("opens"), F.sum("closes").alias("closes"),
            F.sum("gain").alias("gain"), F.sum("gain_inf").alias("gain_inf"),
        )
        # a link the matrix does not list is infinite
        .where((F.col("opens") == 1) & F.col("movable") & (F.col("closes") == 0))
    )
    becomes_finite = F.col("total_inf") + F.col("gain_inf") == 0
    better = becomes_finite & ((F.col("total_inf") > 0) | (F.col("gain") < -MIN_GAIN))
    behind = ~((F.col("a") > F.col("ca")) | ((F.col("a") == F.col("ca")) & (F.col("b") > F.col("cb"))))
    return (
        moves.where(better)
        .groupBy("tour_id")
        .agg(F.min(F.struct(behind.alias("behind"), "a", "b")).alias("s"))
        .select("tour_id", F.col("s.a").alias("a"), F.col("s.b").alias("b"))
    )


def two_opt(
    orders: DataFrame, matrix: DataFrame, penalty_s: float, max_rounds: int | None = None
) -> DataFrame:
    """Improve orders (tour_id, pos, i, avant12h, locked) by reversing slices.

    Reversals are scanned by (first, last position); an improving one is taken at once
    and the scan goes on behind it, starting over as long as a pass improved anything.
    Locked stops (the tail) never move, and tours with fewer than four movable stops
    stay as they are. A limit on reversals per tour replaces a wall-clock budget, so
    results are repeatable.
    """
    small, small_m, big, big_m, any_big = _by_size(orders, matrix)
    columns = ["tour_id", "pos", "i", "avant12h", "locked"]
    near = _small_tours(_as_points(small), small_m, False, True, penalty_s, max_rounds).select(*columns)
    return near.unionByName(two_opt_by_rounds(big, big_m, penalty_s, max_rounds)) if any_big else near


def two_opt_by_rounds(
    orders: DataFrame, matrix: DataFrame, penalty_s: float, max_rounds: int | None = None
) -> DataFrame:
    """``two_opt`` for tours of any size: each round applies every tour's next improving reversal."""
    spark = matrix.sparkSession
    movable = orders.where(~F.col("locked")).groupBy("tour_id").agg((F.count("*") >= MIN_MOVABLE).alias("active"))
    with round_settings(spark, matrix.count()) as parts:
        legs_only = matrix.where(F.col("i") != F.col("j")).select("tour_id", "i", "j", "seconds")
        state = cut_lineage(
            orders.select("tour_id", "pos", "i", "avant12h", "locked")
            .join(movable, "tour_id", "left")
            .select(
                "tour_id", F.col("pos").cast("bigint").alias("pos"), F.col("i").cast("bigint").alias("i"),
                F.coalesce("avant12h", F.lit(False)).alias("avant12h"), "locked",
                F.coalesce("active", F.lit(False)).alias("active"),
                F.lit(-1).cast("bigint").alias("ca"), F.lit(-1).cast("bigint").alias("cb"),
            )
        )
        by_from = cut_lineage(legs_only.repartition(parts, "tour_id", "i"))
        by_pair = cut_lineage(legs_only.repartition(parts, "tour_id", "i", "j"))
        rounds = 0
        while (max_rounds is None or rounds < max_rounds) and not state.where(F.col("active")).isEmpty():
            rounds += 1
            rows = cut_lineage(_with_prefixes(state.where(F.col("active")), by_pair, penalty_s))
            moves = _best_moves(rows, by_from, penalty_s)
            hit = (F.col("a").isNotNull()) & F.col("pos").between(F.col("a"), F.col("b"))
            state = cut_lineage(
                state.join(moves, "tour_id", "left").select(
                    "tour_id",
                    F.when(hit, F.col("a") + F.col("b") - F.col("pos")).otherwise(F.col("pos")).alias("pos"),
                    "i", "avant12h", "locked",
                    (F.col("active") & F.col("a").isNotNull()).alias("active"),
                    F.coalesce("a", "ca").alias("ca"), F.coalesce("b", "cb").alias("cb"),
                )
            )
    return state.select("tour_id", "pos", "i", "avant12h", "locked")


def optimize(
    points: DataFrame, matrix: DataFrame, penalty_s: float, max_rounds: int | None = None
) -> DataFrame:
    """Nearest neighbour, then 2-opt with the fixed end locked, with the leg times.

    ``points(tour_id, i, avant12h, fixed_end)`` gives (tour_id, pos, i, seconds).
    """
    small, small_m, big, big_m, any_big = _by_size(points, matrix)
    columns = ["tour_id", "pos", "i", "seconds"]
    near = _small_tours(_walk_points(small), small_m, True, True, penalty_s, max_rounds).select(*columns)
    if not any_big:
        return near
    marked = walk_by_rounds(big, big_m).join(
        big.select("tour_id", "i", "avant12h", F.col("fixed_end").alias("locked")), ["tour_id", "i"]
    )
    better = two_opt_by_rounds(marked, big_m, penalty_s, max_rounds)
    return near.unionByName(legs(better.select("tour_id", "pos", "i"), big_m).select(*columns))
