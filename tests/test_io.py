"""Sinks and sources: append (S4), JSON report (S5), rejects (S9), snapshot / restore."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tallyframe.sources import io
from tallyframe.sources.schemas import TRANSACTIONS, empty_table


def test_append_json_and_rejects(spark, books):
    d = tempfile.mkdtemp(prefix="tf-io-")
    t = os.path.join(d, "transactions")
    empty_table(spark, "transactions").write.parquet(t)
    io.append_table(books.transactions.limit(10), t)
    io.append_table(books.transactions.limit(5), t)
    back = io.read_parquet_table(spark, t, "transactions")
    assert back.count() == 15
    assert [(f.name, f.dataType) for f in back.schema] == [(f.name, f.dataType) for f in TRANSACTIONS]
    io.write_report_json(back.select("txn_id", F.col("amount").cast("double")), os.path.join(d, "report"))
    assert spark.read.json(os.path.join(d, "report")).count() == 15
    rej = spark.createDataFrame([(2, "Missing date")], "row_id long, reason string")
    io.write_rejects(rej, os.path.join(d, "rejects"))
    assert spark.read.option("header", True).csv(os.path.join(d, "rejects")).first().reason == "Missing date"


def test_snapshot_restore_and_missing(spark, books):
    d = tempfile.mkdtemp(prefix="tf-snap-")
    folder = io.snapshot({"parties": books.parties}, d, "books", prefix="auto_")
    assert os.path.basename(folder).startswith("auto_books_")
    out = io.restore(spark, folder, ["parties"], os.path.join(d, "current"))
    assert out["parties"].count() == books.parties.count()
    with pytest.raises(FileNotFoundError):
        io.restore(spark, os.path.join(d, "nope"), ["parties"], os.path.join(d, "current2"))


def test_csv_source_maps_pandas_missing_tokens(spark):
    d = tempfile.mkdtemp(prefix="tf-csv-")
    with open(os.path.join(d, "f.csv"), "w") as f:
        f.write("Date,Customer Name\nNA,Acme\n01.01.26,null\n")
    rows = sorted(io.read_import_csv(spark, d).collect(), key=lambda r: r.row_id)
    assert [(r.row_id, r.Date, r["Customer Name"]) for r in rows] == [(2, None, "Acme"), (3, "01.01.26", None)]


def test_one_sheet_opens_without_the_others(spark):
    rows = [(p, f"Party {p}", k, f'cell "{k}",\nline') for p in range(60) for k in range(5 if p != 7 else 700)]
    df = spark.createDataFrame(rows, "party_id long, party string, id long, note string").repartition(7)
    path = os.path.join(tempfile.mkdtemp(prefix="tf sheets "), "x")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # many ranges of these few rows
    try:
        io.export_report_csv(df, path, sheet_col="party", key_col="party_id", order_by=["id"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = [f for d, _, fs in os.walk(path) for f in fs if f.endswith(".csv")]
    assert len(files) >= 6
    one = io.read_sheet(spark, path, "Party 33")
    assert len(one.inputFiles()) <= 2 < len(files)
    assert [(int(r.id), r.note, r.sheet) for r in one.collect()] == [(k, f'cell "{k}",\nline', "Party 33") for k in range(5)]
    hot = io.read_sheet(spark, path, "Party 7")
    assert len(hot.inputFiles()) > 2 and sorted(int(r.id) for r in hot.collect()) == list(range(700))
    with pytest.raises(KeyError):
        io.read_sheet(spark, path, "Nobody")
    io.export_report_csv(df.limit(0), path + "2", sheet_col="party", key_col="party_id")
    with pytest.raises(KeyError):
        io.read_sheet(spark, path + "2", "Party 1")
