"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR  folder of the Parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_QUERIES comma-separated names, or "all" (default: the headline queries)
BENCH_REPEAT  timed runs per query, the best counts (default 3)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plumbline import registry  # noqa: E402
from plumbline.session import build_session  # noqa: E402

HEADLINE = (
    "missing_counts", "exact_duplicates", "repeated_texts", "near_duplicate_groups", "near_duplicate_groups_two_changes",
    "unparseable_numbers", "date_format_violations", "column_summary", "mean_shift", "novel_reference_share",
    "distribution_shift", "orphan_count", "orphan_rows", "temporal_violation_count", "aggregate_mismatch_count",
    "duplicates_dropped", "conditional_update", "distinct_queries", "top_runs", "graded_relational",
    "audit_nulls_duplicates", "audit_conformance", "audit_drift", "audit_relational", "full_audit",
)


def run(query, spark, sf_dir: str) -> float:
    started = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    registry.load_all()
    names = list(registry.QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or list(HEADLINE)
    spark = build_session(
        "plumbline-bench", f"local[{cpus}]", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions=cpus, spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {name: round(min(run(registry.QUERIES[name], spark, sf_dir) for _ in range(repeat)), 4) for name in names}
    print(json.dumps({
        "metric": "headline queries, total seconds", "value": round(sum(times.values()), 4), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
        "repeat": repeat,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
