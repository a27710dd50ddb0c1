"""Seconds per query: one warm-up, then the median of the runs; one JSON line on stdout.

Environment: BENCH_SF_DIR, BENCH_CPUS, BENCH_RUNS, BENCH_QUERIES (comma-separated names).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import tempfile
import time

from flightops.plans.queries import QUERIES
from flightops.session import build_session

HEADLINE = (
    "flight_details",
    "parse_flight_events",
    "events_to_signals",
    "accepted_signals",
    "transitions_with_context",
    "flight_outcome",
    "state_changes",
    "transition_order_violations",
    "journey_execution",
    "journey_transitions",
    "connection_slack",
    "active_flights",
    "audit_trail",
    "build_audit_trail",
    "history_counts",
    "export_history",
    "avg_delay_by_route",
    "phase_bottlenecks",
    "ops_kpis",
    "delay_windows",
    "transitions_near_events",
    "event_patterns",
    "station_load",
    "history_enriched_events",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    conf = {
        "spark.master": f"local[{cpus}]",
        "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="bench-"),
    }
    spark = build_session("flightops-bench", **conf)
    spark.sparkContext.setLogLevel("ERROR")

    seconds = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            begin = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - begin)
        seconds[name] = round(statistics.median(taken[1:]), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total of median query times",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else sf_dir,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
