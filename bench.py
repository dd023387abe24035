"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores, BENCH_ONLY an optional
comma-separated list of query names. Every query runs to the end into a null sink, once,
after a small warm-up query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from roundsman.plans.catalog import QUERIES  # noqa: E402
from roundsman.session import build_session  # noqa: E402

HEADLINE = [
    "sc07_street_similarity", "ex06_extract_labels", "ex09_correction_log", "ex11_otsu_threshold", "tb01_upsert",
    "tb05_flag_duplicates", "jn03_match_addresses", "jn04_geocode_parcels", "jn05_search_addresses", "jn06_nearest_node",
    "jn07_snap_points", "jn08_nearest_favourite", "jn11_stops_with_parcels", "jn13_node_link_report", "gr01_shortest_times",
    "gr02_time_matrix", "gr03_shortest_paths", "gr04_route_segments", "pl01_compute_tours", "tr03_tour_cost", "tr04_nearest_neighbor", "tr06_optimize",
    "tr08_cheapest_gap", "tr09_apply_insertion", "ag01_stop_states", "ag02_daily_stats", "ag03_etas", "ag10_extent",
    "io07_stop_features",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    only = [q for q in os.environ.get("BENCH_ONLY", "").split(",") if q]
    QUERIES["ag06_progress"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in only or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 2)
        print(name, times[name], file=sys.stderr, flush=True)
    total = round(sum(times.values()), 2)
    print(json.dumps({
        "metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
