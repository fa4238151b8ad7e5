"""Import (M11), entry validation (M12), the CSV source (S2) and the streaming import."""

import os
import tempfile

from pyspark.sql import functions as F

from tallyframe.operators import importing as I
from tallyframe.sources import io
from tallyframe.sources.schemas import PARTIES


def _parties(spark):
    return spark.createDataFrame([(1, "Acme Co", "acme_co", "Customer", True),
                                  (2, "Beta", "beta", "Credit Customer", True),
                                  (3, "Nul", "nul", None, False)], PARTIES)


def test_first_failing_reason_and_defaults(spark):
    raw = spark.createDataFrame([
        (2, None, "B1", None, "SALE", "CASH", "10"),          # missing date wins over missing party
        (3, "junk", "B2", "Acme Co", "sale", "cash", "10"),   # invalid date
        (4, "17.01.26", "B3", None, "sale", "cash", "10"),    # missing party
        (5, "17.01.26", None, "Acme Co", None, None, None),   # defaults: Sale, Cash, 0, bill ""
        (6, "05/02/2026", "B5", "New  Guy", "g-pay", "GPAY", "1,200"),
    ], "row_id long, Date string, `Bill No` string, `Customer Name` string, Type string, `Payment Mode` string, "
       "Amount string")
    res = I.import_transactions(raw, _parties(spark), pivot_year=2076)
    assert {r.row_id: r.reason for r in res.rejected.collect()} == {
        2: "Missing date", 3: "Invalid date format: junk", 4: "Missing party name"}
    acc = {r.row_id: r for r in res.accepted.collect()}
    assert (acc[5].txn_type, acc[5].payment_mode, str(acc[5].amount), acc[5].bill_no) == ("Sale", "Cash", "0.00", "")
    assert (acc[6].txn_type, acc[6].payment_mode, str(acc[6].amount), acc[6].amount_ok) == ("G-Pay", "Gpay", "0.00",
                                                                                             False)
    assert str(acc[6].txn_date) == "2026-02-05"
    assert [tuple(r) for r in res.counts.orderBy("status").collect()] == [("error", 3), ("success", 2)]
    new_parties, accepted = res.with_ids()
    np = new_parties.collect()
    assert [(r.party_id, r.name, r.normalized_name, r.type, r.credit_allowed) for r in np] == [
        (4, "New  Guy", "new__guy", "Customer", True)]
    assert sorted((r.row_id, r.party_id, r.txn_id) for r in accepted.collect()) == [(5, 1, 1), (6, 4, 2)]


def test_header_aliases_and_na_tokens(spark):
    raw = spark.createDataFrame([(1, "NA", "2024-01-05", "Acme Co", "receipt", "upi", "5")],
                                "row_id long, date string, txn_date string, Party string, txn_type string, "
                                "Mode string, amount string")
    cleaned = I.clean_import(I.na_tokens_to_null(raw))
    r = cleaned.first()
    assert (str(r.txn_date), r.party, r.txn_type, r.payment_mode, r.reason) == ("2024-01-05", "Acme Co", "Receipt",
                                                                                "Upi", None)


def test_entry_validation(spark):
    entries = spark.createDataFrame([
        (1, "2024-01-01", "B", "Acme Co", "Sale", "Credit", "5"),
        (2, "2024-01-01", "B", "Beta", "Sale", "Credit", "5"),
        (3, "2024-01-01", "B", "Nul", "Sale", "Credit", "5"),
        (4, "2024-01-01", "B", "Ghost", "Sale", "Cash", "5"),
        (5, "", "B", "Acme Co", "Sale", "Cash", "5"),
        (6, "2024-01-01", "B", "  ", "Sale", "Cash", "5"),
    ], "row_id long, date string, bill_no string, party string, txn_type string, mode string, amount string")
    strict = {r.row_id: r.reason for r in I.validate_entries(entries, _parties(spark)).collect()}
    assert strict[1] == ("Credit Mode is NOT allowed for 'Acme Co' (Type: Customer). "
                         "Only 'Credit Customer' can take credit.")
    assert strict[2] is None and strict[3] is None
    assert strict[4] == "Party 'Ghost' not found. Create it in 'Manage > Add Party' first."
    assert strict[5] == strict[6] == I.REQUIRED_MSG
    loose = {r.row_id: (r.reason, r.creates_party) for r in I.validate_entries(entries, _parties(spark), False).collect()}
    assert loose[4] == (None, True) and loose[2] == (None, False)


def test_csv_source_numbers_lines(spark):
    d = tempfile.mkdtemp(prefix="tf-csv-")
    p = os.path.join(d, "upload.csv")
    with open(p, "w") as f:
        f.write("Date,Customer Name,Amount\n")
        for i in range(50):
            f.write(f"0{1 + i % 9}.01.26,Party {i},{i}\n")
    df = io.read_import_csv(spark, p)
    rows = sorted((r.row_id, r["Customer Name"]) for r in df.collect())
    assert rows[0] == (2, "Party 0") and rows[-1] == (51, "Party 49")


def test_first_rejects_is_top_k(spark):
    rej = spark.range(100).select(F.col("id").alias("row_id"), F.col("id").alias("row_order"), F.lit("x").alias("reason"))
    assert [r.row_id for r in I.first_rejects(rej, 20).collect()] == list(range(20))


def test_non_strict_entries_create_parties(spark):
    from tallyframe.operators.changes import create_parties

    entries = spark.createDataFrame([
        (1, "2024-01-01", "B", "Ghost", "Sale", "Cash", "5"),
        (2, "2024-01-01", "B", "Ghost", "Sale", "Cash", "6"),
        (3, "2024-01-01", "B", "Acme Co", "Sale", "Cash", "5"),
    ], "row_id long, date string, bill_no string, party string, txn_type string, mode string, amount string")
    v = I.validate_entries(entries, _parties(spark), strict=False)
    creates = I.parties_to_create(v, "Credit Customer")
    assert [tuple(r) for r in creates.collect()] == [(1, "Ghost", "Credit Customer", True)]
    res = create_parties(_parties(spark), creates)
    assert [(r.party_id, r.name, r.credit_allowed) for r in res.table.where("name = 'Ghost'").collect()] == [
        (4, "Ghost", True)]


def test_date_texts_of_real_files(spark):
    from tallyframe.functions.dates import parse_day_first

    golden = {"05-Jan-2026": "2026-01-05", "05-Jan-26": "2026-01-05", "05/Jan/2026": "2026-01-05", "17/01/2026 10:30": "2026-01-17",
              "17.01.2026 10:30:00": "2026-01-17", "01-13-2026": "2026-01-13", "01.13.2026": "2026-01-13", "2026-1-17": "2026-01-17",
              "2026.01.17": "2026-01-17", "Jan 5 2026": "2026-01-05", "17 01 2026": "2026-01-17", "2026-01-17 10:00:00.000": "2026-01-17",
              "January 5, 2026": "2026-01-05", "20260117": "2026-01-17", "31/02/2026": "None", "Foo 5 2026": "None", "": "None"}
    df = spark.createDataFrame([(t,) for t in golden], "t string")
    got = {r.t: str(r.d) for r in df.select("t", parse_day_first("t", pivot_year=2076).alias("d")).collect()}
    assert got == golden


def test_amounts_out_of_range_are_rejected(spark):
    raw = spark.createDataFrame([(k, "01.01.26", "Acme Co", a) for k, a in enumerate(["1e17", "inf", "1_000", "1,200", "abc", "99999999999999999"])],
                                "row_id long, Date string, Party string, Amount string")
    res = I.import_transactions(raw, _parties(spark), pivot_year=2076)
    assert {r.row_id: r.reason for r in res.rejected.collect()} == {
        k: f"Amount out of range: {a}" for k, a in ((0, "1e17"), (1, "inf"), (5, "99999999999999999"))}
    assert {r.row_id: str(r.amount) for r in res.accepted.collect()} == {2: "1000.00", 3: "0.00", 4: "0.00"}


def test_files_of_two_layouts_and_quoted_line_breaks(spark):
    folder = tempfile.mkdtemp(prefix="tf-csv-")
    with open(os.path.join(folder, "a.csv"), "w") as f:
        f.write('Date,Party,Amount\n05.01.26,"Acme\nCo",5\n06.01.26,Beta,6\n')
    with open(os.path.join(folder, "b.csv"), "w") as f:
        f.write("Customer Name,Date,Amount\nAcme Co,07.01.26,7\n")
    clean = I.clean_import(io.read_import_csv(spark, folder), pivot_year=2076)
    rows = sorted(clean.collect(), key=lambda r: r.row_order)
    assert [(os.path.basename(r.file), r.row_id, str(r.txn_date), r.party) for r in rows] == [
        ("a.csv", 2, "2026-01-05", "Acme\nCo"), ("a.csv", 3, "2026-01-06", "Beta"), ("b.csv", 2, "2026-01-07", "Acme Co")]


def test_sheets_whose_names_agree_stay_apart(spark):
    long = "A very long party name that goes on "
    rows = spark.createDataFrame([(1, long + "one", 1), (2, long + "two", 2), (3, "A/B", 3), (4, "A?B", 4), (1, long + "one", 5)],
                                 "party_id long, party string, id long")
    path = os.path.join(tempfile.mkdtemp(prefix="tf-sheets-"), "x")
    io.export_report_csv(rows, path, sheet_col="party", key_col="party_id", order_by=["id"])
    back = spark.read.option("header", True).csv(path).collect()
    sheets = {}
    for r in back:
        sheets.setdefault(r.sheet, set()).add(r.party_id)
    assert len(sheets) == 4 and all(len(v) == 1 and len(k) <= 31 for k, v in sheets.items()) and len(back) == 5


def test_float_texts(spark):
    from tallyframe.functions.money import py_float_text

    values = [25.0, 12345678.5, 0.0005, 1e16, 1.5e16, 5e-5, 1.234e-7, 123456789012345.6, -12345678.25, 0.1, 1e15, 1e22, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r.t for r in df.select("x", py_float_text("x").alias("t")).orderBy(F.monotonically_increasing_id()).collect()] == list(map(str, values))
