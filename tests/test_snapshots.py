"""Snapshots: what a second one writes, what a restore verifies, and failures on the way."""

import datetime as dt
import glob
import os
import shutil
import tempfile

import pytest
from pyspark.sql import functions as F

from tallyframe.sources import snapshots as S
from tallyframe.sources.schemas import empty_table

DAY = [dt.datetime(2026, 1, d) for d in range(1, 9)]


def _files(folder, table):
    return sorted(glob.glob(f"{folder}/{table}/bucket=*/*.parquet"))


def _rows(df, like):
    return sorted(map(str, df.select(*like.columns).collect()))


def test_second_snapshot_writes_what_changed(spark, books):
    root = tempfile.mkdtemp(prefix="tf snap ")
    tx, parties = books.transactions, books.parties
    first = S.snapshot({"transactions": tx, "parties": parties}, root, "books", when=DAY[0], bucket_rows=100)
    n = len({os.path.dirname(f) for f in _files(first, "transactions")})
    assert n >= 10 and _files(first, "parties")
    edited = tx.withColumn("amount", F.when(F.col("txn_id") == 7, F.lit(1).cast("decimal(18,2)")).otherwise(F.col("amount")))
    second = S.snapshot({"transactions": edited, "parties": parties}, root, "books", when=DAY[1], bucket_rows=5)
    changed = {os.path.dirname(f) for f in _files(second, "transactions")}
    assert 1 <= len(changed) <= 2 and _files(second, "parties") == []  # the bucket the row left, and the one it went to
    size = lambda d: sum(os.path.getsize(f) for f in _files(d, "transactions"))
    assert size(second) < size(first) / 4
    third = S.snapshot({"transactions": edited, "parties": parties}, root, "books", when=DAY[2])
    assert _files(third, "transactions") == [] and _files(third, "parties") == []
    for folder, want in ((first, tx), (second, edited), (third, edited)):
        out = S.restore(spark, folder, ["transactions", "parties"], f"{root}/current-{os.path.basename(folder)}")
        assert _rows(out["transactions"], want) == _rows(want, want) and _rows(out["parties"], parties) == _rows(parties, parties)


def test_damage_is_found_before_anything_is_written(spark, books):
    root = tempfile.mkdtemp(prefix="tf-snap-")
    parties = books.parties
    folder = S.snapshot({"parties": parties, "daily_cash": books.daily_cash}, root, "books", when=DAY[0], bucket_rows=20)
    target = f"{root}/current"

    def damaged(change, match="damaged"):
        shutil.copytree(folder, f"{folder}-kept")
        change(_files(folder, "parties")[0])
        with pytest.raises(ValueError, match=match):
            S.restore(spark, folder, ["daily_cash", "parties"], target)
        assert not os.path.exists(target)
        shutil.rmtree(folder)
        os.rename(f"{folder}-kept", folder)

    def other_rows(path):  # readable, but not what was taken
        rows = spark.read.parquet(path).withColumn("name", F.lit("x")).toPandas()
        rows.to_parquet(path)
        crc = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc")
        if os.path.exists(crc):
            os.remove(crc)

    damaged(lambda p: os.truncate(p, os.path.getsize(p) // 2))
    damaged(lambda p: shutil.rmtree(os.path.dirname(p)), "missing")
    damaged(other_rows, "not what was taken")
    assert S.restore(spark, folder, ["parties"], target)["parties"].count() == parties.count()


def test_missing_failed_and_empty_snapshots(spark, books):
    root = tempfile.mkdtemp(prefix="tf-snap-")
    with pytest.raises(FileNotFoundError):
        S.restore(spark, f"{root}/books_20260101_000000", ["parties"], f"{root}/current")
    folder = S.snapshot({"parties": books.parties, "audit_logs": empty_table(spark, "audit_logs")}, root, "books", when=DAY[0])
    with pytest.raises(FileNotFoundError):
        S.restore(spark, folder, ["transactions"], f"{root}/current")
    out = S.restore(spark, folder, ["audit_logs"], f"{root}/current")["audit_logs"]
    assert out.collect() == [] and "username" in out.columns
    os.makedirs(f"{root}/books_20260102_000000/parties")  # one that failed before its manifest
    assert S.last_snapshot(spark, root, "books") == folder and S.last_snapshot(spark, root, "other") is None
    again = S.snapshot({"parties": books.parties}, root, "books", when=DAY[1])
    assert _files(again, "parties") == []
    wider = S.snapshot({"parties": books.parties.withColumn("phone", F.lit("1"))}, root, "books", when=DAY[2])
    assert _files(wider, "parties")  # other columns: taken anew


def test_rows_that_differ_only_in_nulls_and_borders_have_other_digests(spark):
    def digest(rows):
        df = spark.createDataFrame(rows, "a string, b string")
        return S.digests(S._bucketed(df, 1)).first().digest

    kinds = [[("a", None)], [(None, "a")], [("a", "")], [("", "a")], [("a|1:b", "c")], [("a", "b|1:c")], [("-", None)], [(None, None)], [("a", None)] * 2]
    assert len({digest(k) for k in kinds}) == len(kinds)
    assert digest([("a", "b"), ("c", "d")]) == digest([("c", "d"), ("a", "b")])
