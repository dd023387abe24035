import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from roundsman.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def mini(spark):
    """Five nodes, six edges: 0-1-2 both ways, 3 to 1 to 4 one way, from 3 only on to 4."""
    nodes = spark.createDataFrame(
        [(0, 48.68, 5.89), (1, 48.6805, 5.89), (2, 48.681, 5.89), (3, 48.6805, 5.891), (4, 48.6805, 5.889)],
        "node int, lat float, lon float",
    )
    long, short = 6.671695598705381, 3.775744987061045
    edges = spark.createDataFrame(
        [(0, 0, 1, long), (1, 1, 0, long), (2, 1, 2, long), (3, 2, 1, long), (4, 3, 1, short), (5, 1, 4, short)],
        "e int, u int, v int, w float",
    )
    turns = spark.createDataFrame(
        [(0, 1), (0, 2), (0, 5), (1, 0), (2, 3), (3, 1), (3, 2), (3, 5), (4, 5)], "e int, f int"
    )
    return nodes, edges, turns
