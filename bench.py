"""Benchmark the headline queries; prints one JSON line.

Environment: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS``
(default: all cores), ``BENCH_MEM`` (driver memory, default 4g),
``BENCH_ALL=1`` to time every registered query instead of the headline set.
selected query once at the target scale (JIT, generated code, file metadata
and OS cache; ``BENCH_WARM=0`` skips it), then a second pass times each query
(median of ``BENCH_REPEAT`` runs, default 1) with the ``noop`` sink, which
forces every row without collecting anything.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lotwise.plans.registry import queries  # noqa: E402
from lotwise.session import build_session  # noqa: E402

HEADLINE = (
    "dealer_segmentation", "attention_inbox", "dealer_activity", "recent_views",
    "recent_filters", "live_inventory", "purchase_history", "requests_latest",
    "listing_match", "price_stats", "dealer_profile", "recommend_cars",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS") or os.cpu_count() or 4)
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    spark = build_session(
        f"local[{cpus}]", app_name="lotwise-bench",
        shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE") or cpus),
        extra={"spark.driver.memory": os.environ.get("BENCH_MEM", "4g")})
    registry = queries()
    names = list(registry) if os.environ.get("BENCH_ALL") == "1" else list(HEADLINE)

    warm = os.environ.get("BENCH_WARM", "1") != "0"

    def run(name: str, folder: str) -> float:
        start = time.perf_counter()
        registry[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    if warm:
        for name in names:
            run(name, sf_dir)
    timings = {}
    for name in names:
        timings[name] = round(statistics.median(run(name, sf_dir) for _ in range(repeat)), 3)
    sf = os.path.basename(sf_dir).removeprefix("sf")
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(timings.values()), 3),
                      "unit": "sec", "queries": timings, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
