"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the local threads.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cohortpref.plans.catalog import QUERIES  # noqa: E402
from cohortpref.session import build_session  # noqa: E402

HEADLINE = (
    "accuracy_by_choice", "position_stats", "cmc_curve", "choice_frequency", "choice_ranking", "choice_top_n",
    "ranking_totals", "cluster_size_distribution", "choice_accuracy_wide", "accuracy_overall", "value_domain",
    "string_index", "apply_string_index", "validate_requests_rejected", "one_hot_long", "nearest_center", "wssse",
    "fixed_projection", "score_normalized", "quantize_days", "hour_band",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="8g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    QUERIES[names[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the JVM's engine
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    match = re.search(r"sf([0-9.]+)$", sf_dir)
    print(json.dumps({
        "metric": "total time of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(match.group(1)) if match else sf_dir,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
