"""Headline-query benchmark.

Runs the headline queries at $BENCH_SF_DIR (default /root/testdata/sf0.1) on
local[$BENCH_CPUS] and prints ONE JSON line:
{"metric": "total_headline_seconds", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Each query is executed end to end with the ``noop`` sink (full computation,
nothing collected to the driver).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "t8_series_features_by_user",   # T8: calendar + lags + rolling, halo buckets
    "t7_global_series_halo",        # T7: one global series without a single-task window
    "t4_lags_by_supplier",          # T4-T6 on lineitem
    "a5_column_roles",              # A-profile: one-pass column stats + roles
    "a3_distinct_counts",
    "x2_random_split",              # X2 exact md5-order split (global index)
    "e6_roc_auc_exact",             # E6 exact AUC by range-partitioned prefix sums
    "e8_e10_regression_metrics",
    "f5_tfidf_vocabulary",          # F5 vocabulary + idf
    "j1_full_run_metrics",          # J1 full run on lineitem regression
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    from tabsmith.session import local_session
    from tabsmith.registry import QUERIES

    spark = local_session(cpus)
    times: dict[str, float] = {}
    for name in (only or HEADLINE):
        t0 = time.perf_counter()
        df = QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"[bench] {name}: {times[name]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else sf_dir
    print(json.dumps({"metric": "total_headline_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
