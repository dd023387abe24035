"""Views over rows with missing and repeated keys, and what the ordering queries ask of the session."""

import datetime

import pytest

from roundsman.operators import ordering, ranges
from roundsman.plans import catalog
from roundsman.plans.derive import PORTABLE, Views
from roundsman.session import FLAT_ROWS, SETTINGS

LINES = "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_extendedprice double, l_quantity double, " \
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"


def _views(spark, lines):
    day = datetime.datetime(1995, 1, 1)
    views = Views(spark, "/nowhere")
    views._made["lineitem"] = spark.createDataFrame([(o, n, p, 1, 1.0, 1.0, "N", "O", day) for o, n, p in lines], LINES)
    return views


ODD = [(1, 1, 5), (1, 2, 6), (1, 2, 6), (1, None, 7), (2, 1, 5), (3, None, 5), (None, 1, 5), (3004, 1, 5), (3005, 3, 5), (3071, 9000, 1), (3072, 1, 1)]


@pytest.mark.parametrize("name", ["matrix", "long_matrix"])
def test_matrix_is_spelled_out_from_counts(spark, name):
    views = _views(spark, ODD)
    made = getattr(views, name)
    rows = sorted(map(tuple, made.collect()))
    assert rows == sorted(map(tuple, views.sql(PORTABLE[name]).collect())) and len(rows) > 20
    assert made.schema == views.sql(PORTABLE[name]).schema
    # no points are joined with each other, and the tasks that spell out pairs are not put together
    plan = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "Join" not in plan and plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan


def test_numbers_over_several_blocks_and_without_one(spark):
    rows = [("a", k, k % 3) for k in range(250)] + [("b", 7, 0), ("b", 7, 1), ("c", None, 0), (None, 3, 0), ("d", 900, 2)]
    df = spark.createDataFrame(rows, "k string, o bigint, x bigint")
    numbered = ranges.number_rows(df, ["k"], ranges.block_of(df.o, 100), ["o", "x"], "n")
    found = sorted((r.k, r.o, r.x, r.n) for r in numbered.collect())
    assert found == sorted([("a", k, k % 3, k + 1) for k in range(250)] + [("b", 7, 0, 1), ("b", 7, 1, 2), ("d", 900, 2, 1)])
    # rows without a block come first and leave their numbers out
    gap = spark.createDataFrame([("a", None), ("a", 5), ("a", 105)], "k string, o bigint")
    assert sorted(map(tuple, ranges.number_rows(gap, ["k"], ranges.block_of(gap.o, 100), ["o"], "n").collect())) == [("a", 5, 2), ("a", 105, 3)]
    # keys with one block only bring no row to the join
    assert "isnotnull(_before" in numbered._jdf.queryExecution().executedPlan().toString()


def test_given_positions_may_leave_some_out(spark):
    orders = spark.createDataFrame([(1, 2, 3, False, False), (1, 3, 4, False, False)], "tour_id bigint, pos bigint, i bigint, avant12h boolean, locked boolean")
    matrix = spark.createDataFrame([(1, i, j, 1.0) for i in (0, 3, 4) for j in (0, 3, 4)], "tour_id bigint, i bigint, j bigint, seconds double")
    assert ordering.two_opt(orders, matrix, 1.0).count() == 2


def test_orders_do_not_depend_on_the_order_of_rows_inside_a_tour(spark):
    n = 9
    points = [(t, i, i % 4 == 1, i == n and t % 2 == 0) for t in range(40) for i in range(n + 1)]
    links = [(t, i, j, float(30 + (i * 37 + j * 91 + t * 13) % 600)) for t in range(40) for i in range(n + 1) for j in range(n + 1)]

    def ordered(step):
        p = spark.createDataFrame(points[::step], "tour_id bigint, i bigint, avant12h boolean, fixed_end boolean").coalesce(1)
        m = spark.createDataFrame(links[::step], "tour_id bigint, i bigint, j bigint, seconds double").coalesce(1)
        return sorted(map(tuple, ordering.optimize(p, m, 60.0).collect()))

    assert ordered(1) == ordered(-1) and len(ordered(1)) == 40 * n


@pytest.mark.parametrize("name", ["tr04_nearest_neighbor", "tr04_nearest_neighbor_long", "tr05_two_opt", "tr06_optimize", "tr06_optimize_long"])
def test_flat_rows_are_not_sized_one_by_one(spark, name):
    key, = FLAT_ROWS
    try:
        with pytest.raises(Exception):
            catalog.QUERIES[name](spark, "/nowhere")
        assert spark.conf.get(key) == FLAT_ROWS[key]
        with pytest.raises(Exception):
            catalog.QUERIES["gr03_shortest_paths"](spark, "/nowhere")
        assert spark.conf.get(key) == SETTINGS[key]
    finally:
        spark.conf.set(key, SETTINGS[key])
