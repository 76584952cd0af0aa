"""Time the headline queries: one warm-up run, then the median of the timed runs.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all),
BENCH_RUNS (default 3). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = [
    "detect_log_type",
    "parse_syslog",
    "parse_nginx_access",
    "parse_windows_event",
    "explode_message_fields",
    "shannon_entropy",
    "run_rules",
    "build_alerts",
    "dedupe_alerts",
    "threshold_rule",
    "brute_force_sliding",
    "inter_arrival_delta",
    "search_logs",
    "log_detail",
    "server_stats",
    "dashboard_overview",
    "top_threats",
    "alert_timeline",
    "server_timeline",
    "server_recent_activity",
    "merge_templates",
    "host_anomaly_score",
    "export_ocsf",
]


def main() -> None:
    from vigilog.plans import QUERIES
    from vigilog.session import get_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    spark = get_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(cores),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(key: str) -> float:
        start = time.perf_counter()
        QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for key in sys.argv[1:] or HEADLINES:
        run(key)
        times[key] = round(statistics.median(run(key) for _ in range(runs)), 3)
        print(f"{key}: {times[key]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
