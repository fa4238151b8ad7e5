"""Plan checks: no Python UDFs, one scan of the fact table for single-pass reports,
filters and column pruning reaching the parquet scan."""

import os
import re
import tempfile

import pytest

from tallyframe.operators import lists as R
from tallyframe.plans.catalog import registry
from conftest import SF_SMALL

NO_PLAN = {"snapshot_roundtrip", "export_csv_roundtrip", "import_csv_roundtrip", "stream_import"}


def _plan(df):
    jvm = df.sparkSession._jvm
    return jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.mark.parametrize("name", ["pnl", "trial_balance", "dashboard", "daily_cash_summary", "outstanding"])
def test_single_scan_of_transactions(spark, name):
    plan = _plan(registry()[name](spark, SF_SMALL))
    scans = [line for line in plan.splitlines() if line.startswith("Location:") and "orders.parquet" in line]
    assert len(scans) == 1, plan


def test_day_book_filter_reaches_scan(spark, books):
    d = tempfile.mkdtemp(prefix="tf-plan-")
    path = os.path.join(d, "transactions")
    books.transactions.write.parquet(path)
    tx = spark.read.parquet(path)
    df = R.day_book(tx, books.parties, "1998-06-15")
    plan = _plan(df)
    assert "PushedFilters: [IsNotNull(txn_date), EqualTo(txn_date,1998-06-15)" in plan
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string>" in plan


def test_pnl_reads_two_columns(spark, books):
    d = tempfile.mkdtemp(prefix="tf-plan-")
    path = os.path.join(d, "transactions")
    books.transactions.write.parquet(path)
    from tallyframe.operators.aggregates import pnl

    plan = _plan(pnl(spark.read.parquet(path)))
    assert "ReadSchema: struct<txn_type:string,amount:decimal(18,2)>" in plan


def test_ledger_shuffles_rows_once(spark):
    """No party of the fixture is hot, so the ledger is one read and one window per party, without blocks."""
    plan = _plan(registry()["party_ledger"](spark, SF_SMALL))
    reads = [line for line in plan.splitlines() if line.startswith("ReadSchema:") and "o_orderkey" in line]
    assert len(reads) == 1
    assert "windowspecdefinition(party_id" in plan and "__blk" not in plan


def test_date_partitioned_layout_prunes_days(spark, books):
    from tallyframe.sources import io

    d = tempfile.mkdtemp(prefix="tf-layout-")
    path = os.path.join(d, "transactions")
    io.write_transactions_layout(books.transactions, path)
    tx = spark.read.parquet(path)
    df = R.day_book(tx, books.parties, "1998-06-15")
    plan = _plan(df)
    assert "PartitionFilters: [isnotnull(txn_date" in plan and "(txn_date" in plan and "= 1998-06-15)" in plan
    direct = R.day_book(books.transactions, books.parties, "1998-06-15")
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, direct.collect()))


def _unpartitioned_windows_are_over_aggregates(plan: str) -> list[str]:
    """Node ids of windows with an empty partition spec whose input has no aggregate."""
    _, _, details = plan.partition("\n\n")
    tree = plan.splitlines()  # subqueries have trees of their own further down
    bad = []
    for block in details.split("\n\n"):
        lines = block.strip().splitlines()
        if not lines or not re.match(r"\(\d+\) Window", lines[0]):
            continue
        node = re.match(r"\((\d+)\)", lines[0]).group(1)
        args = next((x for x in lines if x.startswith("Arguments:")), "")
        specs = re.findall(r"windowspecdefinition\(([^,]*)", args)
        # the first item of a window spec is a partition expression unless there is none
        if not any(re.search(r" (ASC|DESC) NULLS|specifiedwindowframe", x) for x in specs):
            continue
        idx = next(i for i, t in enumerate(tree) if re.search(rf"Window \({node}\)$", t))
        indent = len(tree[idx]) - len(tree[idx].lstrip(" :+-"))
        sub = []
        for t in tree[idx + 1:]:
            if len(t) - len(t.lstrip(" :+-")) <= indent:
                break
            sub.append(t)
        # Day totals are an aggregate that was written: one row a day.
        scans = re.findall(r"Scan parquet\s+\((\d+)\)", "\n".join(sub))
        places = [re.search(rf"\n\({k}\) Scan parquet[^\n]*\n(?:.*\n)*?Location: (.*)", details) for k in scans]
        totals = bool(scans) and all(p and "/day-totals-" in p.group(1) for p in places)
        if not any("HashAggregate" in t for t in sub) and not totals:
            bad.append(node)
    return bad


@pytest.mark.parametrize("name", sorted(set(registry()) - NO_PLAN))
def test_plan_has_no_udf_and_no_row_level_global_window(spark, name):
    plan = _plan(registry()[name](spark, SF_SMALL))
    for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF"):
        assert node not in plan, name
    assert _unpartitioned_windows_are_over_aggregates(plan) == [], name


def test_window_check_flags_a_naive_plan(spark, books):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    naive = books.transactions.withColumn(
        "bal", F.sum("amount").over(Window.orderBy("txn_date", "txn_id").rowsBetween(Window.unboundedPreceding, 0)))
    assert _unpartitioned_windows_are_over_aggregates(_plan(naive)) != []
    good = _plan(registry()["account_bank"](spark, SF_SMALL))
    assert "windowspecdefinition(__dated" in good and _unpartitioned_windows_are_over_aggregates(good) == []
