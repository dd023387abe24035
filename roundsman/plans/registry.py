"""Registered queries: a Spark callable per name and, where SQL can say it, a check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from roundsman.plans.derive import Views
from roundsman.plans.oracle import statement
from roundsman.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None, flat_rows: bool = False):
    """Register ``build(views) -> DataFrame`` under a name; ``sql`` refers to views as ``{view}``.

    ``flat_rows``: no row that goes to a Python task holds an array, see ``session.FLAT_ROWS``.
    """

    def register(build: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            prepare(spark, flat_rows)
            return build(Views(spark, folder))

        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = statement(sql)
        return build

    return register
