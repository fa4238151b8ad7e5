"""Summarize the physical plan of every query: scans (with read columns), exchanges, and
whether whole-stage codegen covers the operators. Writes markdown to stdout.

Usage: python tools/plan_summary.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

WRITERS = {"snapshot_roundtrip", "export_csv_roundtrip", "import_csv_roundtrip", "stream_import"}


def summarize(plan: str) -> dict:
    scans, exchanges, broadcasts = [], [], 0
    current_table = None
    for line in plan.splitlines():
        m = re.match(r"Location: InMemoryFileIndex(?:\(\d+ paths\))? ?\[file:[^,\]]*/([\w=-]+?)(\.parquet|-[0-9a-f]{12}|)[,\]]", line)
        if m:  # a table of the data set, or one that the query has written
            current_table = m.group(1) if m.group(2) == ".parquet" else f"written:{m.group(1)}"
        if line.startswith("ReadSchema:") and current_table:
            cols = re.findall(r"(\w+):", line[len("ReadSchema: struct<"):])
            scans.append(f"{current_table}({len(cols)} cols)")
            current_table = None
        if line.startswith("Arguments: ") and "ENSURE_REQUIREMENTS" in line:
            if "SinglePartition" in line:
                exchanges.append("single")
            elif "hashpartitioning" in line:
                keys = re.findall(r"hashpartitioning\((.*?), \d+\)", line)
                k = re.sub(r"#\d+L?", "", keys[0]) if keys else "?"
                exchanges.append(f"hash[{k}]")
            elif "rangepartitioning" in line:
                exchanges.append("range")
        if line.startswith("Arguments: HashedRelationBroadcastMode"):
            broadcasts += 1
    return {"scans": scans, "exchanges": exchanges, "broadcasts": broadcasts,
            "python_udf": any(n in plan for n in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF"))}


def main(argv) -> int:
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    from tallyframe.plans.catalog import registry
    from tallyframe.session import local_session

    spark = local_session(8)
    print("# Physical plans\n")
    print(f"Generated by `tools/plan_summary.py` from `explain(\"formatted\")` on `{sf_dir}` (local[8], AQE on;")
    print("the initial plan, before AQE replaces joins with broadcasts at runtime). `single` marks an")
    print("exchange into one partition; every one here carries one row per day, block or aggregate,")
    print("never one row per transaction. `written:` marks tables that the query itself wrote before (numbered rows, day totals, batches);")
    print("queries whose jobs run when they are built show their last plan.\n")
    print("| Query | Scans (columns read) | Exchanges | Broadcasts | Python UDF |")
    print("| --- | --- | --- | --- | --- |")
    for name, fn in registry().items():
        if name in WRITERS:
            print(f"| `{name}` | writes files; see README | | | no |")
            continue
        df = fn(spark, sf_dir)
        plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        s = summarize(plan)
        print(f"| `{name}` | {', '.join(s['scans'])} | {', '.join(s['exchanges']) or '-'} | {s['broadcasts']} | "
              f"{'YES' if s['python_udf'] else 'no'} |")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
