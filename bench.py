"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (default 1; the median of the runs is reported), BENCH_HEAVY=1 adds the
queries that fit models or run whole ingests.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from loginlens.plans.catalog import QUERIES  # noqa: E402
from loginlens.session import build_session  # noqa: E402

HEADLINE = (
    "impossible_travel", "replay_scores", "user_profile", "user_locations", "login_gaps", "latest_events",
    "clean_logins", "score_device", "score_time", "score_velocity", "mahalanobis_score", "isolation_forest_score",
    "dbscan", "analyze_logins_native", "merge_profiles", "heatmap_grid", "geojson_points", "trajectory_segments",
)
HEAVY = ("kmeans_fallback", "identify_patterns", "analyze_logins", "process_logins", "score_logins", "stream_scores",
         "stream_ingest")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE + (HEAVY if os.environ.get("BENCH_HEAVY") else ())
    spark = build_session("bench", master=f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": str(max(int(cpus), 1)), "spark.ui.enabled": "false",
        "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    # Untimed: start the executor threads and compile the common code paths.
    QUERIES[names[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()

    seconds = {}
    for name in names:
        times = []
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
    scale = re.search(r"sf([0-9.]+)/?$", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": float(scale.group(1)) if scale else None}))
    spark.stop()


if __name__ == "__main__":
    main()
