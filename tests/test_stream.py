"""The streaming import is exactly-once at its sink and continues ids across batches."""

import os
import tempfile

from pyspark.sql import functions as F

from tallyframe.sources.schemas import PARTIES, TRANSACTIONS
from tallyframe.streaming.stream_import import read_accepted, start_stream_import

COLUMNS = ["row_id", "Date", "Customer Name", "Amount"]


def _drop(folder, name, rows):
    with open(os.path.join(folder, name), "w") as f:
        f.write(",".join(COLUMNS) + "\n")
        for r in rows:
            f.write(",".join(r) + "\n")


def test_stream_restart_and_new_file(spark):
    base = tempfile.mkdtemp(prefix="tf-stream-")
    drop, out, ckpt = (os.path.join(base, x) for x in ("drop", "out", "ckpt"))
    os.makedirs(drop)
    parties = spark.createDataFrame([(1, "Acme", "acme", "Customer", True)], PARTIES)
    tx = spark.createDataFrame([(10, None, None, 1, "Sale", "Cash", None)], TRANSACTIONS)
    _drop(drop, "a.csv", [("2", "01.01.26", "Acme", "5"), ("3", "02.01.26", "New One", "6"), ("4", "NA", "X", "1")])

    def run():
        start_stream_import(spark, drop, parties, tx, out, ckpt, pivot_year=2076).awaitTermination()
        return sorted((r.row_id, r.txn_id, r.party_id) for r in read_accepted(spark, out).collect())

    first = run()
    assert first == [(2, 11, 1), (3, 12, 2)]
    assert run() == first                      # restart: nothing is imported twice
    _drop(drop, "b.csv", [("2", "03.01.26", "new one", "7"), ("3", "04.01.26", "Another", "8")])
    second = run()
    # the later file gets the next ids; "new one" finds the party created by the first batch
    assert second == sorted(first + [(2, 13, 2), (3, 14, 3)])
    rejected = spark.read.parquet(os.path.join(out, "rejected")).select("row_id", "reason").collect()
    assert [tuple(r) for r in rejected] == [(4, "Missing date")]
    parties_made = spark.read.parquet(os.path.join(out, "parties")).orderBy("party_id")
    assert [(r.party_id, r.normalized_name) for r in parties_made.collect()] == [(2, "new_one"), (3, "another")]
    assert spark.read.parquet(os.path.join(out, "accepted")).select(F.countDistinct("batch_id")).first()[0] == 2


def test_stream_numbers_lines_without_row_id(spark):
    base = tempfile.mkdtemp(prefix="tf-stream-")
    drop, out, ckpt = (os.path.join(base, x) for x in ("drop", "out", "ckpt"))
    os.makedirs(drop)
    cols = ["Date", "Customer Name", "Amount"]
    with open(os.path.join(drop, "a.csv"), "w") as f:
        f.write(",".join(cols) + "\n01.01.26,Acme,5\n,Acme,6\n03.01.26,Acme,7\n")
    parties = spark.createDataFrame([(1, "Acme", "acme", "Customer", True)], PARTIES)
    start_stream_import(spark, drop, parties, parties.select(F.lit(0).cast("long").alias("txn_id")), out, ckpt,
                        pivot_year=2076).awaitTermination()
    assert sorted(r.row_id for r in read_accepted(spark, out).collect()) == [2, 4]
    rej = spark.read.parquet(os.path.join(out, "rejected")).collect()
    assert [(r.row_id, r.reason) for r in rej] == [(3, "Missing date")]


def _base(spark):
    base = tempfile.mkdtemp(prefix="tf stream ")  # with a blank
    drop, out, ckpt = (os.path.join(base, x) for x in ("drop", "out", "ckpt"))
    os.makedirs(drop)
    return drop, out, ckpt, spark.createDataFrame([(1, "Acme", "acme", "Customer", True)], PARTIES), spark.createDataFrame([], TRANSACTIONS)


def _put(folder, name, text):
    with open(os.path.join(folder, name), "w", newline="") as f:
        f.write(text)


def test_stream_reads_each_file_by_its_own_header(spark):
    drop, out, ckpt, parties, tx = _base(spark)
    _put(drop, "a b+c.csv", 'Date,Party,Amount\n01.01.26,"Smith ""Bob"" Co",40\n02.01.26,"C:\\",2\n03.01.26,"two\nlines",3\n')
    _put(drop, "b%20.csv", "Amount,date,Date,Customer Name\r\n5,09.09.09,04.01.26,Acme\r\n6,05.01.26,,acme\r\n7,,06.01.26,Acme,extra\r\n")
    _put(drop, "c.csv", 'Party,Date\nX,07.01.26\nY,"08.01.26\n')  # the last quote is not closed
    for range_bytes in (1 << 20, 17):  # whole files, and many ranges
        at = f"{out}-{range_bytes}"
        start_stream_import(spark, drop, parties, tx, at, f"{ckpt}-{range_bytes}", pivot_year=2076, range_bytes=range_bytes)
        rows = sorted((os.path.basename(r.file), r.row_id, r.party, str(r.txn_date), float(r.amount)) for r in read_accepted(spark, at).collect())
        assert rows == [("a b+c.csv", 2, 'Smith "Bob" Co', "2026-01-01", 40.0), ("a b+c.csv", 3, "C:\\", "2026-01-02", 2.0),
                        ("a b+c.csv", 4, "two\nlines", "2026-01-03", 3.0), ("b%20.csv", 2, "Acme", "2026-01-04", 5.0),
                        ("b%20.csv", 3, "acme", "2026-01-05", 6.0), ("c.csv", 2, "X", "2026-01-07", 0.0)]
        rejected = sorted((os.path.basename(r.file), r.row_id, r.reason) for r in spark.read.parquet(f"{at}/rejected").collect())
        assert rejected == [("b%20.csv", 4, "Expected 4 fields, saw 5"), ("c.csv", 3, "Unclosed quote")]


def test_same_bytes_are_imported_once(spark):
    drop, out, ckpt, parties, tx = _base(spark)
    text = "Date,Party,Amount\n01.01.26,Acme,1\n02.01.26,Acme,2\n"
    _put(drop, "a.csv", text)
    _put(drop, "b.csv", text)  # a repeat in the same batch
    _put(drop, "c.csv", text + "03.01.26,Acme,3\n")
    _put(drop, "empty.csv", "")
    run = lambda: start_stream_import(spark, drop, parties, tx, out, ckpt, pivot_year=2076, files_per_batch=3, range_bytes=20)
    run()
    _put(drop, "0-again.csv", text)  # a repeat in a later batch, before the others by name
    run()
    run()
    assert sorted((os.path.basename(r.file), r.row_id) for r in read_accepted(spark, out).collect()) == [
        ("a.csv", 2), ("a.csv", 3), ("c.csv", 2), ("c.csv", 3), ("c.csv", 4)]
    files = {os.path.basename(r.file): (r.records, r.same_as and os.path.basename(r.same_as), r.batch_id) for r in spark.read.parquet(f"{out}/files").collect()}
    assert files == {"a.csv": (2, None, 0), "b.csv": (0, "a.csv", 0), "c.csv": (3, None, 0), "empty.csv": (0, None, 1), "0-again.csv": (0, "a.csv", 2)}
    ids = sorted(r.txn_id for r in read_accepted(spark, out).collect())
    assert ids == [1, 2, 3, 4, 5]


def test_failed_batch_has_the_same_files_when_it_runs_again(spark, monkeypatch):
    import pytest

    from tallyframe.streaming import stream_import

    drop, out, ckpt, parties, tx = _base(spark)
    _put(drop, "m.csv", "Date,Party,Amount\n01.01.26,Acme,1\n")
    real = stream_import.import_transactions

    def broken(*a, **k):
        raise RuntimeError("lost")

    monkeypatch.setattr(stream_import, "import_transactions", broken)
    with pytest.raises(Exception, match="lost"):
        start_stream_import(spark, drop, parties, tx, out, ckpt, pivot_year=2076)
    monkeypatch.setattr(stream_import, "import_transactions", real)
    _put(drop, "a.csv", "Date,Party,Amount\n02.01.26,Acme,2\n")  # dropped meanwhile, earlier by name
    start_stream_import(spark, drop, parties, tx, out, ckpt, pivot_year=2076)
    rows = sorted((r.batch_id, os.path.basename(r.file), r.txn_id) for r in spark.read.parquet(f"{out}/accepted").collect())
    assert rows == [(0, "m.csv", 1), (1, "a.csv", 2)]
