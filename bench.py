"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR  folder of the test tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_RUNS    timed runs per query after one warm-up (default 3, the median counts)
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

from tallyworks.catalog import registered
from tallyworks.session import local_session, stored_tables

HEADLINE = (
    "R4_order_fact", "R6_customer_orders", "R7_first_orders", "R8_kpis", "R10_cohort", "R12_late_by_state",
    "R14_repeat_by_first", "R17_rfm_customers", "Z2_significance", "D_register", "D10_dev_kpis", "D13_closeout_trend",
    "D15_repeat_pairs", "L7_result_fact", "L20_cleaning_log", "L23_dictionary_encode", "L25_column_profile",
    "P2_control_limits", "P9_rule_subset", "P13_signal_log", "E2_em_classify", "Q3_repeat_excursions", "W4_global_ntile",
    "S9_compact_export", "W5_percent_rank", "L21_quality_summary", "L22_data_dictionary_all", "R15_repeat_by_category",
)


def run(build, spark, folder: str) -> float:
    with stored_tables(spark):
        began = time.perf_counter()
        build(spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cores)
    queries, _ = registered()
    wanted = sys.argv[1:] or HEADLINE
    times = {}
    for name in wanted:
        run(queries[name], spark, folder)
        times[name] = round(statistics.median(run(queries[name], spark, folder) for _ in range(runs)), 3)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": float(scale.group(1)) if scale else folder,
    }))


if __name__ == "__main__":
    main()
