"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs once unmeasured (class loading, code generation, page cache) and then
$BENCH_RUNS times; the median counts. All rows are produced (`noop` sink), none collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from cfgveil.plans.queries import QUERIES
from cfgveil.session import build_session

HEADLINE = [
    "sanitize_builtin", "sanitize_text_only", "sanitize_accounts", "sanitize_by_vendor", "sanitize_strict", "sanitize_documents",
    "apply_library", "apply_library_documents", "detect_secrets", "detect_secrets_documents", "pattern_stats_documents", "pack_coverage",
    "secrets_by_type", "security_report", "report_json", "results_json", "account_occurrences", "rename_customers", "server_block_keys",
    "roundtrip_zip", "sanitize_archives", "latest_backup", "restore_directory", "redact_logs",
]


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session(
        "cfgveil-bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        run(spark, name, sf_dir)
        seconds[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(runs)), 3)
    total = round(sum(seconds.values()), 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
