"""Benchmark: run the headline queries on the driver's tables and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is run to completion with the ``noop`` sink (the whole plan executes, nothing
is collected to the driver). Queries that write files (snapshot, export, stream, stored totals and openings) are
timed separately under ``io`` and are not part of the headline value.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

WRITERS = {"snapshot_roundtrip", "export_csv_roundtrip", "import_csv_roundtrip", "stream_import", "totals_by_deltas", "reports_from_totals",
           "party_statement_forward", "account_statement_forward", "changes_by_bucket", "transactions_page_direct", "search_indexed", "cash_month_after_counts"}


def main() -> int:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = set(sys.argv[1:])
    from tallyframe.plans.catalog import registry
    from tallyframe.session import local_session

    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app_name="tallyframe-bench")
    queries = registry()
    # Warm the JVM (class loading, codegen caches) on one small query first.
    queries["pnl"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    io_times: dict[str, float] = {}
    for name, fn in queries.items():
        if only and name not in only:
            continue
        t0 = time.perf_counter()
        df = fn(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        dt = round(time.perf_counter() - t0, 3)
        (io_times if name in WRITERS else times)[name] = dt
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "io": io_times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
    }
    print(json.dumps(out))
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
