"""Headline queries timed at one scale; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from nightledger.catalog.all import QUERIES
from nightledger.session import build_session

HEADLINES = (
    "x12_feature_matrix",
    "p14_reprice_grid",
    "m2_nested_horizons",
    "m5_series_report",
    "a4_trading_kpis",
    "a22_nightly_facts",
    "d11_population_stability",
    "k12_redacted_documents",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(cores, int(cores))
    # One untimed pass over the smallest tables: the JVM compiles, the timings are warm.
    small = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    if os.path.isdir(small):
        for name in HEADLINES:
            QUERIES[name](spark, small).write.format("noop").mode("overwrite").save()
    timings = {}
    for name in HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
        print(name, timings[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
