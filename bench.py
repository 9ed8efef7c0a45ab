"""Benchmark the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query runs once to warm up (JIT, Python workers, file listing), then
``BENCH_REPEATS`` (3) timed runs each plan and execute the whole query into
Spark's ``noop`` sink (no collection to the driver); the median is reported.
The derived procurement tables are prepared first and timed apart (``prep_views_sec``); without that set-up every query
plans them from the given tables.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tenderlake.plans.registry import HEADLINE, QUERIES, load_all  # noqa: E402
from tenderlake.session import get_session  # noqa: E402


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:]
    load_all()
    names = names or list(HEADLINE) + ["filter_conjunction", "competitors", "cpv_rollup", "knn_topk_blocked"]
    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=max(8, cpus),
                        app_name="tenderlake-bench")
    # Set-up: the derived procurement tables are written into a fresh folder, timed apart from the queries.
    from tenderlake.session import checkpoint_dir
    from tenderlake.sources.stored import prepare, use_prepared
    folder = f"{checkpoint_dir(spark).rstrip('/')}/bench-views-{time.time_ns()}"
    t0 = time.perf_counter()
    prepare(spark, sf_dir, folder)
    use_prepared(sf_dir, folder)
    prep = round(time.perf_counter() - t0, 3)
    times: dict[str, float] = {}
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    for n in names:
        run(QUERIES[n](spark, sf_dir))                      # warm-up
        samples = []
        for _ in range(repeats):
            t0 = time.perf_counter()
            run(QUERIES[n](spark, sf_dir))                  # plan + execute, as a caller would
            samples.append(time.perf_counter() - t0)
        times[n] = round(statistics.median(samples), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_wall", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus, "prep_views_sec": prep,
                      "total_with_prep_sec": round(sum(times.values()) + prep, 3)}))


if __name__ == "__main__":
    main()
