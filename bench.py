"""Headline queries at one scale; prints one JSON line. Each is warmed up once, then the median of three runs counts."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HEADLINES = (
    "crawl_all",
    "same_host_links",
    "snapshot_fetch",
    "crawl_single",
    "page_meta",
    "url_resolve",
    "attempt_fold",
    "latest_outcome",
    "log_rollup",
    "log_scan_jsonl",
    "log_batch_upload",
    "progress_throttle",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINES
    from sitegraph.plans.queries import QUERIES
    from sitegraph.session import local_session

    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench", partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("OFF")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in names:
        run(name)
        seconds[name] = round(statistics.median(run(name) for _ in range(runs)), 3)
    spark.stop()
    result = {
        "metric": "headline queries, sum of medians",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
