"""The import-file source: against the rows that were written and the pandas reader; ranges of any size, odd names, odd files."""

import os
import random
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import importing as I
from tallyframe.sources import import_files as S
from tallyframe.sources import io

CELLS = ["a", "", "x y", "1,200", 'q"q', "l\nm", "é", "日本", "\r\n", "NA", "C:\\", '"', "  ", "\\", '""', "a\\\"b"]


def _write(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write(text)
    return path


def _by_ranges(path, range_bytes):
    """Records of a file read in ranges, put together by the marks in plain Python."""
    size = os.path.getsize(path)
    rows, marks, out, state = {}, {}, [], 0
    ranges = S.ranges_of([(path, size)], range_bytes)
    for r in ranges:
        for batch in S.read_range(r):
            for x in batch.to_pylist():
                if x["ends"] is None:
                    rows.setdefault((x["part"], x["state"]), []).append((x["seq"], dict(x["cells"]), x["problem"]))
                else:
                    marks[x["part"], x["state"]] = x["ends"], x["n"]
    for r in ranges:
        got = rows.get((r.part, state), [])
        assert [g[0] for g in got] == list(range(marks[r.part, state][1]))
        out += [g[1:] for g in got]
        state = marks[r.part, state][0]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_records_equal_what_was_written(monkeypatch, seed):
    rng, folder = random.Random(seed), tempfile.mkdtemp(prefix="tf-src-")

    def cell(c):
        quoted = any(x in c for x in ",\n\r") or c.startswith('"') or rng.random() < 0.2
        return '"' + c.replace('"', '""') + '"' if quoted else c

    for k in range(25):
        eol = rng.choice(["\n", "\r\n", "\r"])
        rows = [[rng.choice(CELLS) for _ in range(3)] for _ in range(rng.randint(0, 12))]
        text = ("\ufeff" if rng.random() < 0.2 else "") + 'Date,Party,"Am\nount"' + eol
        for r in rows:
            blank = rng.choice(["", "  "]) + eol if rng.random() < 0.1 else ""
            text += blank + ",".join(map(cell, r)) + eol
        if rng.random() < 0.3:
            text = text.removesuffix(eol)
        path = _write(folder, f"{k}.csv", text)
        want = [(dict(zip(["Date", "Party", "Am\nount"], r)), None) for r in rows]
        if eol != "\r":  # the pandas reader trips over lone carriage returns
            theirs = pd.read_csv(path, dtype=str, keep_default_na=False, na_filter=False)
            assert theirs.to_dict("records") == [w[0] for w in want]
        for range_bytes in (1 << 20, 1, 3, 7, 16, 40):
            monkeypatch.setattr(S, "STEP_BYTES", rng.choice([1, 2, 5, 1 << 16]))
            assert _by_ranges(path, range_bytes) == want


def test_probes_of_real_files(spark):
    folder = tempfile.mkdtemp(prefix="tf src ")
    text = ('Date,Customer Name,Amount,Bill No\n01/01/2026,"Smith ""Bob"" Co",1,a\n02/01/2026,"C:\\",2,b\n03/01/2026,Dir",40,c\n'
            '04/01/2026,"Two\nlines",4,"x, y"\n05/01/2026,E,5\n06/01/2026,F,6,g,h\n')
    _write(folder, "my file.csv", text)
    _write(folder, "a+b%41.csv", "Customer Name,Date\nG,07/01/2026\n")
    for range_bytes in (1 << 20, 11):
        rows = io.read_import_csv(spark, folder, range_bytes=range_bytes).orderBy("row_order").collect()
        assert [(os.path.basename(r.file), r.row_id, r["Customer Name"], r.Amount, r["Bill No"], r.problem) for r in rows] == [
            ("a+b%41.csv", 2, "G", None, None, None), ("my file.csv", 2, 'Smith "Bob" Co', "1", "a", None),
            ("my file.csv", 3, "C:\\", "2", "b", None), ("my file.csv", 4, 'Dir"', "40", "c", None),
            ("my file.csv", 5, "Two\nlines", "4", "x, y", None), ("my file.csv", 6, "E", "5", None, None),
            ("my file.csv", 7, "F", "6", "g", "Expected 4 fields, saw 5")]
        clean = I.clean_import(io.read_import_records(spark, folder, range_bytes=range_bytes), pivot_year=2076)
        assert [(r.row_id, r.reason) for r in clean.where("reason IS NOT NULL").collect()] == [(7, "Expected 4 fields, saw 5")]


def test_one_file_is_split_with_exact_numbers(spark):
    folder = tempfile.mkdtemp(prefix="tf-src-")
    n = 3000
    lines = [f'{k % 28 + 1:02d}.01.26,"P ""{k}""{chr(10) * (k % 5 == 0)}",{k}' if k % 3 == 0 else f"{k % 28 + 1:02d}.01.26,Plain {k},{k}" for k in range(n)]
    path = _write(folder, "one.csv", "Date,Party,Amount\n" + "\n".join(lines))
    size = os.path.getsize(path)
    raw = S.register(spark).read.format("import_files").option("paths", f'["{path}"]').option("range_bytes", size // 20).load()
    assert raw.rdd.getNumPartitions() >= 20
    rows = io.read_import_records(spark, path, range_bytes=size // 20)
    got = rows.select("row_id", F.col("cells")["Amount"].cast("long").alias("a")).orderBy("row_id").collect()
    assert [(r.row_id, r.a) for r in got] == [(k + 2, k) for k in range(n)]
    alone = io.read_import_records(spark, path)
    assert sorted(map(str, alone.collect())) == sorted(map(str, rows.collect()))


def test_nothing_is_read_before_the_scan(spark, monkeypatch):
    folder = tempfile.mkdtemp(prefix="tf-src-")
    _write(folder, "x.csv", "Date,Party\n01.01.26,A\n")
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    frame = io.read_import_records(spark, folder)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before and frame.count() == 1


def test_names_of_columns(spark):
    assert S.column_names(["Date", "Party", "Date", "", "Date", "Date.1"]) == ["Date", "Party", "Date.1", "Unnamed: 3", "Date.2", "Date.1.1"]
    folder = tempfile.mkdtemp(prefix="tf-src-")
    _write(folder, "x.csv", "Date,Party,Date,date\n01.01.26,A,x,y\n")
    clean = I.clean_import(io.read_import_records(spark, folder), pivot_year=2076)
    assert [(str(r.txn_date), r.party, r.reason) for r in clean.collect()] == [("2026-01-01", "A", None)]


def test_empty_and_missing_files(spark):
    folder = tempfile.mkdtemp(prefix="tf-src-")
    _write(folder, "none.csv", "")
    _write(folder, "head.csv", "Date,Party\n\n  \n")
    _write(folder, "_skipped.csv", "Date\n1\n")
    os.makedirs(os.path.join(folder, "sub dir"))
    _write(folder, "sub dir/x.csv", "Date\n01.01.26\n")
    assert [r.Date for r in io.read_import_csv(spark, folder).collect()] == ["01.01.26"]
    assert io.read_import_records(spark, [os.path.join(folder, "none.csv"), os.path.join(folder, "head.csv")]).collect() == []
    assert [os.path.basename(n) for n, _ in S.list_files([os.path.join(folder, "*.csv")])] == ["head.csv", "none.csv"]
    with pytest.raises(FileNotFoundError):
        io.read_import_records(spark, os.path.join(folder, "gone.csv"))


def test_csv_that_is_written_is_read_back(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="tf-src-"), "out")
    cells = [c for c in CELLS if c.strip()]  # the writer trims what is blank
    io.write_csv(spark.createDataFrame([(k, c) for k, c in enumerate(cells)], "Line long, Text string"), path)
    back = io.read_import_csv(spark, path, pandas_missing=False)
    assert {int(r.Line): r.Text for r in back.collect()} == dict(enumerate(cells))
