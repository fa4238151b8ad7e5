"""Month openings: against a running sum over all rows after random batches; what a repair writes and a statement reads."""

import datetime as dt
import os
import random
import re
import tempfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import carries as Y
from tallyframe.operators.totals import signed
from tallyframe.sources import io
from tallyframe.sources.schemas import TRANSACTIONS


def _row(k, rng, lo=0, hi=300):
    day = None if rng.random() < 0.05 else dt.date(2025, 11, 1) + dt.timedelta(days=rng.randint(lo, hi))
    return (k, day, None, rng.choice([1, 2, 3]), rng.choice(["Sale", "Receipt", "Expense"]), rng.choice(["Cash", "UPI", "GPay", "Credit"]),
            None if rng.random() < 0.1 else Decimal(rng.randint(1, 50)))


def _brute(rows, start, end):
    start, end = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
    value = lambda r: (r[6] or 0) if r[4] == "Sale" else -(r[6] or 0)
    out = []
    for p in {r[3] for r in rows}:
        mine = sorted((r for r in rows if r[3] == p), key=lambda r: (r[1] or dt.date.min, r[0]))
        balance = sum(value(r) for r in mine if r[1] is None or r[1] < start)
        inside = [r for r in mine if r[1] is not None and start <= r[1] <= end]
        if balance or inside:
            out.append((p, None, str(start), "Opening", None, float(balance)))
        for r in inside:
            balance += value(r)
            out.append((p, r[0], str(r[1]), r[4], None if r[6] is None else float(r[6]), float(balance)))
    return sorted(out, key=str)


def _got(openings, rows, start, end):
    return sorted(map(tuple, Y.statement_contract(openings.statement(rows, start, end), "party_id").collect()), key=str)


RANGES = [("2025-10-01", "2025-12-31"), ("2026-01-15", "2026-02-03"), ("2026-03-01", "2026-03-31"), ("2026-08-10", "2027-01-01"), ("2028-01-01", "2028-02-01")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_statements_after_batches_equal_running_sums(spark, seed):
    rng = random.Random(seed)
    rows = [_row(k, rng, 40, 200) for k in range(50)]
    frame = lambda rs: spark.createDataFrame(rs, TRANSACTIONS)
    openings = Y.MonthOpenings(spark, tempfile.mkdtemp(prefix="tf open ") + "/o", ["party_id"], Y.party_value)
    openings.create(frame(rows))
    for batch in range(3):
        gone = rng.sample(rows, 8)
        new = [_row(100 * (batch + 1) + k, rng, *rng.choice([(0, 300), (150, 420), (60, 90)])) for k in range(8)]
        openings.apply(signed(frame(gone), -1).unionByName(signed(frame(new), 1)))
        rows = [r for r in rows if r not in gone] + new
        for start, end in rng.sample(RANGES, 2):
            assert _got(openings, frame(rows), start, end) == _brute(rows, start, end), (batch, start)
    for start, end in RANGES:
        assert _got(openings, frame(rows), start, end) == _brute(rows, start, end), start


def test_repair_writes_from_the_first_changed_month(spark):
    rng = random.Random(9)
    rows = [r for r in (_row(k, rng, 0, 300) for k in range(200)) if r[1]]
    frame = spark.createDataFrame(rows, TRANSACTIONS)
    openings = Y.MonthOpenings(spark, tempfile.mkdtemp(prefix="tf-open-") + "/o", ["party_id"], Y.party_value)
    openings.create(frame)
    before = openings.months()
    openings.apply(signed(frame.where("txn_date BETWEEN '2026-06-10' AND '2026-06-20'"), -1))
    after = openings.months()
    june = 2026 * 12 + 5
    assert all(after[m] == before[m] for m in before if m <= june) and all(after[m] != before[m] for m in before if m > june)
    written = os.listdir(f"{openings.root}/version=1/openings")
    assert sorted(n for n in written if n.startswith("month=")) == [f"month={m}" for m in sorted(before) if m > june]
    openings.apply(signed(frame.limit(0), 1))
    assert openings.months() == after


def test_statement_reads_its_range_only(spark, books):
    work = tempfile.mkdtemp(prefix="tf-open-")
    tx = books.transactions.where("party_id IS NOT NULL")
    io.write_transactions_layout(tx, f"{work}/tx")
    openings = Y.MonthOpenings(spark, f"{work}/o", ["party_id"], Y.party_value)
    openings.create(tx)
    rows = spark.read.parquet(f"{work}/tx")
    lines = openings.statement(rows, "1997-02-10", "1997-02-20")
    plan = spark._jvm.PythonSQLUtils.explainString(lines._jdf.queryExecution(), "formatted")
    scans = [b for b in plan.split("\n\n") if re.match(r"\s*\(\d+\) Scan parquet", b)]
    of_rows = [b for b in scans if "/tx]" in b]
    assert of_rows and all("PartitionFilters: [" in b and "txn_date" in b.split("PartitionFilters: [")[1].split("]")[0] for b in of_rows)
    stored = [b for b in scans if "/openings/" in b]
    assert stored and all("month=23965" in b for b in stored)  # February 1997 alone
    days = {r for b in of_rows for r in re.findall(r"txn_date#\d+ [<>]=? (\d{4}-\d\d-\d\d)", b)}
    assert min(days) == "1997-02-01" and max(days) <= "1997-02-20"
    want = _brute([tuple(r) for r in tx.select(*[f.name for f in TRANSACTIONS.fields]).collect()], "1997-02-10", "1997-02-20")
    assert _got(openings, rows, "1997-02-10", "1997-02-20") == want


def test_accounts_and_failed_repairs(spark, monkeypatch):
    rng = random.Random(4)
    rows = spark.createDataFrame([_row(k, rng) for k in range(60)], TRANSACTIONS)
    own = Y.accounts_of(rows)
    assert {(r.payment_mode, r.account) for r in own.collect()} == {("Cash", "Cash"), ("UPI", "Bank"), ("UPI", "UPI"), ("GPay", "Bank")}
    openings = Y.MonthOpenings(spark, tempfile.mkdtemp(prefix="tf-open-") + "/o", ["account"], Y.account_value)
    with pytest.raises(FileNotFoundError):
        openings.apply(signed(rows, 1).withColumn("account", F.lit("Cash")))
    openings.create(own)
    months = openings.months()
    os.makedirs(f"{openings.root}/version=1/openings")  # a repair that did not end
    assert openings.months() == months
    empty = Y.MonthOpenings(spark, tempfile.mkdtemp(prefix="tf-open-") + "/o", ["account"], Y.account_value)
    empty.create(own.limit(0))
    assert empty.statement(own.limit(0), "2026-01-01", "2026-02-01").collect() == []
    empty.apply(signed(own.where("txn_date >= '2026-01-01'"), 1).join(own.limit(0).select("account"), F.lit(True), "left").withColumn("account", F.lit("Cash")))
    assert max(empty.months()) > 2026 * 12
