"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is collected twice; the faster run is reported (the first run
also pays for Python/JVM warm-up of that plan shape).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "findings_lineitem",
    "v_unique_composite",
    "profile_full",
    "profile_top_values",
    "findings_by_slice",
    "v_pattern",
    "v_unique_column",
    "profile_observed_type",
    "recommendations",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from tablepact.catalog.queries import QUERIES
    from tablepact.session import local_session

    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) * 2)
    times: dict[str, float] = {}
    rows: dict[str, int] = {}
    for name in HEADLINE:
        best = None
        for _ in range(2):
            t0 = time.perf_counter()
            n = len(QUERIES[name](spark, sf_dir).collect())
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
        rows[name] = n
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "rows": rows, "sf": sf, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
