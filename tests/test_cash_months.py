"""The carry-forward by months against the whole one after random changes; what an update keeps."""

import datetime as dt
import random
import tempfile
from decimal import Decimal

import pytest

from tallyframe.operators import cash as C
from tallyframe.operators.cash_months import CashMonths, _of_months
from tallyframe.sources.schemas import PARTIES, TRANSACTIONS

COUNTS = "cash_date date, cash_in_hand decimal(18,2)"


def _row(k, rng):
    day = dt.date(2025, 11, 1) + dt.timedelta(days=rng.randint(0, 220))
    return (k, None if rng.random() < 0.05 else day, None, 1, rng.choice(["Sale", "Receipt", "Expense"]), rng.choice(["Cash", "UPI", "Credit"]), Decimal(rng.randint(1, 90)))


@pytest.mark.parametrize("seed", [1, 2])
def test_months_after_changes_equal_the_whole(spark, seed):
    rng = random.Random(seed)
    rows = [_row(k, rng) for k in range(120)]
    counts = {dt.date(2025, 11, 1) + dt.timedelta(days=rng.randint(0, 250)): Decimal(rng.randint(0, 500)) for _ in range(6)}
    parties = spark.createDataFrame([(1, "A", "a", "Customer", True)], PARTIES)
    frames = lambda: (spark.createDataFrame(rows, TRANSACTIONS), parties, spark.createDataFrame(list(counts.items()), COUNTS))
    months = CashMonths(spark, tempfile.mkdtemp(prefix="tf cash ") + "/m")
    with pytest.raises(FileNotFoundError):
        months.pairs()
    months.create(*frames())
    number = lambda d: d.year * 12 + d.month - 1
    for _ in range(2):
        new, gone, day = _row(1000 + rng.randint(0, 9**6), rng), rng.choice(rows), dt.date(2026, rng.randint(1, 8), rng.randint(1, 28))
        rows.append(new)
        rows.remove(gone)
        counts[day] = Decimal(rng.randint(0, 500))
        before = {r.month: (r.reset, r.amount) for r in months.pairs().collect()}
        changed = {number(d) for d in (new[1], gone[1], day) if d}
        months.update(*frames(), sorted(changed))
        after = {r.month: (r.reset, r.amount) for r in months.pairs().collect()}
        assert {m for m in set(before) | set(after) if before.get(m) != after.get(m)} <= changed
        whole = C.daily_cash_summary(*frames(), 1000).collect()
        for m in {number(dt.date(2025, 10, 1)), *rng.sample(sorted(after), 3), max(after), max(after) + 1}:
            name = f"{m // 12:04d}-{m % 12 + 1:02d}"
            assert months.summary(*frames(), m, 1000).collect() == [r for r in whole if r.date.startswith(name)], name


def test_months_are_ranges_of_days(spark, books):
    from tallyframe.sources import io

    path = tempfile.mkdtemp(prefix="tf-cash-") + "/tx"
    io.write_transactions_layout(books.transactions.where("txn_date IS NOT NULL"), path)
    plan = spark._jvm.PythonSQLUtils.explainString(_of_months(spark.read.parquet(path), "txn_date", [1997 * 12 + 2])._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [" in plan and "1997-03-01" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert _of_months(books.transactions, "txn_date", []).count() == 0
