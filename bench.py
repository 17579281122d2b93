"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time
from statistics import median

HEADLINE = (
    "q1", "q3", "q5", "q6", "q10", "q12", "scan_star", "filter_range", "nested_two_levels", "global_aggregates", "group_three", "group_order_alias",
    "sort_large", "top_k", "join_hash", "join_merge", "join_two_keys", "join_many_to_many", "join_six_cyclic", "join_group_order_limit", "text_table_disk",
)
REPEATS = 3


def main() -> None:
    from millrace.queries import QUERIES
    from millrace.session import session

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", "bench", **{"spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        took = []
        for _ in range(REPEATS + 1):  # the first warms up
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        times[name] = round(median(took[1:]), 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total seconds of headline queries, each a median of 3", "value": total, "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
