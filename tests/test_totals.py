"""Totals kept by signed deltas: random batches against a recomputation, what a batch reads, runs again and compaction."""

import os
import random
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import aggregates as A
from tallyframe.operators import changes as CH
from tallyframe.operators.totals import KEYS, StoredTotals, signed, summed
from tallyframe.sources.schemas import PARTIES, TRANSACTIONS

ADDS = "seq long, date string, bill_no string, party string, txn_type string, mode string, amount string"


def _tx(spark, n, rng):
    import datetime as dt
    from decimal import Decimal

    rows = [(k, dt.date(2026, 1, rng.randint(1, 4)) if rng.random() < 0.9 else None, None, rng.choice([1, 2, 3, None]),
             rng.choice(["Sale", "sale", "Receipt", "Expense", None]), rng.choice(["Cash", "UPI", None]),
             Decimal(rng.randint(-500, 500)) if rng.random() < 0.85 else None) for k in range(1, n + 1)]
    return spark.createDataFrame(rows, TRANSACTIONS)


def _all(df):
    return sorted(map(str, df.select(*KEYS, "n", "known", "amount").collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_totals_after_batches_equal_a_recomputation(spark, seed):
    rng = random.Random(seed)
    parties = spark.createDataFrame([(k, f"P{k}", f"p{k}", "Customer", True) for k in (1, 2, 3)], PARTIES)
    tx = _tx(spark, 60, rng)
    kept = StoredTotals(spark, tempfile.mkdtemp(prefix="tf tot ") + "/t")
    kept.create(tx)
    for number in range(1, 7):
        kind = rng.choice(["add", "edit", "delete"])
        if kind == "add":
            batch = [(k, rng.choice(["2026-01-02", "2026-02-01", "x"]), "b", rng.choice(["P1", "P2", "Nobody"]), "Sale", "Cash", rng.choice(["5", "7.5", "x"])) for k in range(9)]
            res = CH.add_transactions(tx, parties, spark.createDataFrame(batch, ADDS))
        elif kind == "edit":
            batch = [(k, rng.randint(1, 70), "u", rng.choice(["amount", "txn_date", "txn_type", "bill_no", "payment_mode", "party"]),
                      rng.choice(["5", "2026-01-01", "Sale", ""])) for k in range(25)]
            res = CH.edit_transactions(tx, spark.createDataFrame(batch, "seq long, txn_id long, admin_user string, field string, new_value string"))
        else:
            res = CH.delete_transactions(tx, spark.createDataFrame([(k, rng.randint(1, 70), "u") for k in range(12)], "seq long, txn_id long, admin_user string"))
        kept.apply(number, res.delta)
        kept.apply(number, res.delta)  # a batch that is run again counts once
        tx = spark.createDataFrame(res.table.select(*[f.name for f in TRANSACTIONS.fields]).collect(), TRANSACTIONS)
        if number == 3:
            kept.compact()
            assert [os.path.basename(f) for f in kept.folders()] == ["base=3"]
        assert _all(kept.totals()) == _all(summed(signed(tx, 1)))
    assert A.pnl(kept.rows()).collect() == A.pnl(tx).collect()
    assert A.trial_balance(kept.rows(), parties).collect() == A.trial_balance(tx, parties).collect()
    assert A.dashboard(kept.rows(), parties, "2026-01-02").collect() == A.dashboard(tx, parties, "2026-01-02").collect()
    assert A.outstanding(kept.rows(), parties).collect() == A.outstanding(tx, parties).collect()
    with pytest.raises(ValueError):
        kept.apply(3, res.delta)


def test_a_batch_reads_its_changes_only(spark):
    root = tempfile.mkdtemp(prefix="tf-tot-")
    tx = _tx(spark, 50, random.Random(0))
    kept = StoredTotals(spark, f"{root}/totals")
    kept.create(tx)
    tx.where("txn_id < 4").write.parquet(f"{root}/changes")
    changes = spark.read.parquet(f"{root}/changes")
    plan = spark._jvm.PythonSQLUtils.explainString(summed(signed(changes, -1))._jdf.queryExecution(), "formatted")
    places = re.findall(r"Location: .*", plan)
    assert len(places) == 1 and "/changes" in places[0]
    before = {f: os.stat(os.path.join(root, "totals", "base=0", f)).st_atime_ns for f in os.listdir(f"{root}/totals/base=0") if f.endswith(".parquet")}
    kept.apply(1, signed(changes, -1))
    assert before == {f: os.stat(os.path.join(root, "totals", "base=0", f)).st_atime_ns for f in before}
    assert kept.totals().agg(F.sum("n")).first()[0] == 47


def test_missing_totals_and_failed_writes(spark):
    kept = StoredTotals(spark, tempfile.mkdtemp(prefix="tf-tot-") + "/none")
    tx = _tx(spark, 5, random.Random(0))
    with pytest.raises(FileNotFoundError):
        kept.totals()
    with pytest.raises(ValueError):
        kept.apply(1, signed(tx, 1))
    kept.create(tx.limit(0))
    assert kept.totals().collect() == [] and A.pnl(kept.rows()).first().sales == 0.0
    os.makedirs(f"{kept.root}/gen=1")  # a write that did not end
    assert [os.path.basename(f) for f in kept.folders()] == ["base=0"]
