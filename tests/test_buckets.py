"""Transactions in buckets of ids: random batches against the plain operators, bytes written, and batches that fail."""

import datetime as dt
import os
import random
import tempfile
from decimal import Decimal

import pytest

from tallyframe.operators import changes as CH
from tallyframe.sources import buckets as B
from tallyframe.sources.schemas import PARTIES, TRANSACTIONS

EDITS = "seq long, txn_id long, admin_user string, field string, new_value string"
ADDS = "seq long, date string, bill_no string, party string, txn_type string, mode string, amount string"


def _rows(df):
    return sorted(map(str, df.select(*B.COLUMNS).collect()))


def _tx(spark, n):
    return spark.createDataFrame([(k, dt.date(2026, 1, 1), f"B{k}", 1, "Sale", "Cash", Decimal(k)) for k in range(1, n + 1)], TRANSACTIONS)


def _bytes(table, version):
    top = f"{table.root}/version={version}/rows"
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(top) for f in fs if f.endswith(".parquet"))


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_equal_the_plain_operators(spark, seed):
    rng = random.Random(seed)
    parties = spark.createDataFrame([(1, "P1", "p1", "Customer", True)], PARTIES)
    tx = _tx(spark, 95)
    table = B.BucketedTransactions(spark, tempfile.mkdtemp(prefix="tf buck ") + "/t", bucket_ids=10)
    table.create(tx)
    for turn in range(4):
        kind = ["edit", "delete", "add", "edit"][turn] if seed == 1 else rng.choice(["edit", "delete", "add"])
        if kind == "edit":
            batch = spark.createDataFrame([(k, rng.choice([rng.randint(1, 130), 7, None]), "u", rng.choice(["amount", "bill_no", "party"]), rng.choice(["5", ""])) for k in range(15)], EDITS)
            want, got = CH.edit_transactions(tx, batch), table.edit(batch)
        elif kind == "delete":
            batch = spark.createDataFrame([(k, rng.randint(80, 130), "u") for k in range(25)], "seq long, txn_id long, admin_user string")
            want, got = CH.delete_transactions(tx, batch), table.delete(batch)
        else:
            batch = spark.createDataFrame([(k, "2026-02-01", "n", rng.choice(["P1", "Nobody"]), "Sale", "Cash", "3") for k in range(27)], ADDS)
            want, got = CH.add_transactions(tx, parties, batch), table.add(parties, batch)
        assert _rows(got.table) == _rows(want.table)
        assert sorted(map(str, got.outcome.collect())) == sorted(map(str, want.outcome.select(*got.outcome.columns).collect()))
        if want.audit is not None:
            assert sorted(map(str, got.audit.collect())) == sorted(map(str, want.audit.collect()))
        tx = spark.createDataFrame(want.table.select(*B.COLUMNS).collect(), TRANSACTIONS)
    assert {b for b in table.buckets()} == {r.txn_id // 10 for r in tx.collect()}


def test_bytes_written_follow_what_is_touched(spark):
    table = B.BucketedTransactions(spark, tempfile.mkdtemp(prefix="tf-buck-") + "/t", bucket_ids=100)
    table.create(_tx(spark, 3000))
    before = table.buckets()
    assert len(before) == 31
    table.edit(spark.createDataFrame([(1, 1234, "u", "amount", "9"), (2, 1250, "u", "bill_no", "x"), (3, 99999, "u", "amount", "1")], EDITS))
    after = table.buckets()
    assert {b for b in after if after[b] != before[b]} == {12}
    assert _bytes(table, 1) < _bytes(table, 0) / 15
    parties = spark.createDataFrame([(1, "P1", "p1", "Customer", True)], PARTIES)
    table.add(parties, spark.createDataFrame([(k, "2026-02-01", "n", "P1", "Sale", "Cash", "3") for k in range(150)], ADDS))
    last = table.buckets()
    assert {b for b in last if last[b] != after.get(b)} == {30, 31} and sum(n for _, n in last.values()) == 3150


def test_a_failed_batch_leaves_the_version_before(spark, monkeypatch):
    table = B.BucketedTransactions(spark, tempfile.mkdtemp(prefix="tf-buck-") + "/t", bucket_ids=10)
    with pytest.raises(FileNotFoundError):
        table.read()
    table.create(_tx(spark, 50))
    rows, deletes = _rows(table.read()), spark.createDataFrame([(1, 15, "u")], "seq long, txn_id long, admin_user string")
    real = spark.createDataFrame

    def broken(data, schema=None, *a, **k):
        if schema == "bucket long, folder string, n long":
            raise RuntimeError("lost")
        return real(data, schema, *a, **k)

    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, *a, **k: broken(*a, **k))
    with pytest.raises(RuntimeError):
        table.delete(deletes)
    monkeypatch.undo()
    assert table.version() == 0 and _rows(table.read()) == rows
    table.delete(deletes)
    assert len(_rows(table.read())) == 49
    table.delete(spark.createDataFrame([(k, k, "u") for k in range(60)], "seq long, txn_id long, admin_user string"))
    assert table.buckets() == {} and table.read().collect() == []
    empty = B.BucketedTransactions(spark, tempfile.mkdtemp(prefix="tf-buck-") + "/t")
    empty.create(_tx(spark, 0))
    parties = spark.createDataFrame([(1, "P1", "p1", "Customer", True)], PARTIES)
    assert [r.txn_id for r in empty.add(parties, spark.createDataFrame([(1, "2026-02-01", "n", "P1", "Sale", "Cash", "3")], ADDS)).table.collect()] == [1]
