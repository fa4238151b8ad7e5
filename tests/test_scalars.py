"""Tiny goldens for the scalar functions (FIXTURES.md and the reference's own examples)."""

import datetime as dt
import unicodedata

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyframe.functions import dates as D
from tallyframe.functions import money as M
from tallyframe.functions import text as X


def _one(spark, values, fn, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {dtype}")
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


def test_next_bill_number(spark):
    got = _one(spark, ["L-145", "INV-099", "A99", "000", "abc", "", None, "9", "  ", "INV-99", "BILL123", "A1",
                       "145", "X-0999", "99999999999999999999999"], X.next_bill_number)
    assert got == ["L-146", "INV-100", "A100", "001", "abc", "", "", "10", "", "INV-100", "BILL124", "A2",
                   "146", "X-1000", "100000000000000000000000"]


def test_title_case(spark):
    got = _one(spark, ["sale return", "G-PAY", "o'neil x2y", "UPI", "GPay", None, "CREDIT", "  cash  "], X.title_case)
    assert got == ["Sale Return", "G-Pay", "O'Neil X2Y", "Upi", "Gpay", None, "Credit", "  Cash  "]


def test_money_formats(spark):
    got = _one(spark, [1234567.891, -100000.0, 999.5, None, 12.0, 100.0, 1000.0], M.indian_money, "double")
    assert got == ["12,34,567.89", "-1,00,000.00", "999.50", "0.00", "12.00", "100.00", "1,000.00"]


def test_balance_label_and_fixed(spark):
    got = _one(spark, ["123.45", "-123.45", "0.00"], lambda c: M.balance_label(c.cast("decimal(18,2)")))
    assert got == ["123.45 Dr", "123.45 Cr", "0.00 Dr"]
    assert _one(spark, ["2.675", "7"], lambda c: M.fixed2(c.cast("decimal(18,3)"))) == ["2.68", "7.00"]


def test_day_first_dates(spark):
    vals = ["17.01.26", "05/02/2026", "01/13/2026", "2026-01-05", "junk", "09.03.95", "31.02.2020", None,
            "5 Jan 2026", "20260117"]
    got = _one(spark, vals, lambda c: D.parse_day_first(c, pivot_year=2076))
    assert got == [dt.date(2026, 1, 17), dt.date(2026, 2, 5), dt.date(2026, 1, 13), dt.date(2026, 1, 5), None,
                   dt.date(1995, 3, 9), None, None, dt.date(2026, 1, 5), dt.date(2026, 1, 17)]
    swapped = _one(spark, ["2026-01-05", "2026-01-13"], lambda c: D.parse_day_first(c, iso="dayfirst", pivot_year=2076))
    assert swapped == [dt.date(2026, 5, 1), dt.date(2026, 1, 13)]


def test_keys(spark):
    names = [" Hello  World ", "Ünïcode Co.", "", "A\tB"]
    assert _one(spark, names, X.company_key) == ["hello_world", "ncode_co", "default", "a_b"]
    assert _one(spark, names, X.server_key) == ["_hello__world_", "ünïcode_co.", "", "a\tb"]
    assert _one(spark, names, X.client_key) == ["_hello_world_", "ünïcode_co.", "", "a_b"]


def test_ladders(spark):
    types = ["Reciept", "sale", "Sale Return", " EXPENSE ", "Purchase", None]
    assert _one(spark, types, X.type_norm) == ["receipt", "sale", "sale", "expense", "purchase", "none"]
    modes = ["Google Pay", "GPay", "g-pay", "Cash", "BANK transfer", "upi", "Credit", "cheque", None]
    assert _one(spark, modes, X.mode_norm) == ["gpay", "gpay", "gpay", "cash", "bank", "upi", "credit", "cheque",
                                               "none"]


def test_sheet_name_and_particulars(spark):
    assert _one(spark, ["a/b\\c?d*e[f]g", "x" * 40], X.sheet_name) == ["a_b_c_d_e_f_g", "x" * 31]
    df = spark.createDataFrame([(" Sale ", "Cash"), ("Receipt", ""), (None, None)], "t string, m string")
    got = [r[0] for r in df.select(X.particulars("t", "m")).collect()]
    assert got == ["Sale / Cash", "Receipt", ""]


def test_display_date_and_month(spark):
    assert _one(spark, ["1998-06-15", "not a date"], D.date_text) == ["15-06-1998", "not a date"]
    assert _one(spark, ["1998-06-15"], D.month_key) == ["1998-06"]


def test_amount_parse(spark):
    got = _one(spark, ["1200", " 12.5 ", "1,200", None, "abc", "-3"], M.parse_amount)
    assert [str(x) for x in got] == ["1200.00", "12.50", "0.00", "0.00", "0.00", "-3.00"]


def test_day_first_more_layouts(spark):
    vals = ["1-2-2024", "01-02-24", "29.02.2024", "29.02.2023", "1/2/24", "13/13/2024", "2024-02-29 10:11:12",
            "2024-02-29 25:00:00", "2024-02-29T10:11", "1.2-2024", "01.02.024", "2024/2/3", "Mar 3, 2024", "00.01.24"]
    got = _one(spark, vals, lambda c: D.parse_day_first(c, pivot_year=2076))
    assert got == [dt.date(2024, 2, 1), dt.date(2024, 2, 1), dt.date(2024, 2, 29), None, dt.date(2024, 2, 1), None,
                   dt.date(2024, 2, 29), None, dt.date(2024, 2, 29), dt.date(2024, 2, 1), None, dt.date(2024, 2, 3),
                   dt.date(2024, 3, 3), None]


def test_dates_as_a_pandas_reader_has_them(spark):
    """Goldens of ``pandas.to_datetime(text, dayfirst=True)``, errors and times of day aside."""
    texts = ["Mon, 05 Jan 2026", "mon 5/1/2026", "5th January 2026", "January 5th, 2026", "17th of January 2026", "05Jan2026", "5Jan26",
             "17-01-2026 10", "17-01-2026 10am", "10:30 17/01/2026", "10am 17/01/2026", "Sat, 17 Jan 2026 10:30:00 GMT", "17-Jan-2026 10:30 PM",
             "Jan 2026", "2026 Jan", "2026-01", "01/2026", "1 2026", "2026", "170126", "17//01/2026", "17/01-2026", "17.01/2026", "17 / 01 / 2026",
             "17/01/2026.", "2026-13-01", "2026-01-05", "22/09/1677", "11/04/2262", "17/01/99", "17/01/75", "17/01/76", "1/1/1"]
    none = ["1600-01-01", "2300-01-01", "01/01/1677", "12/04/2262", "Jan-26", "26 Jan", "17/01", "17", "Jan052026", "2026Jan17", "202601", "17012026",
            "2026-017", "17/01/2026 25:00", "17/01/2026 10:60", "13/13/2026", "31/02/2026", "00/01/2026", "001/01/2026", "17/1/026", "17/01/20266",
            "(17/01/2026)", "17 de enero 2026", "12.30", "1.5", "10.30 17.01.2026", "Q1 2026"]
    got = _one(spark, texts + none, lambda c: D.parse_day_first(c, iso="dayfirst", pivot_year=2076))
    want = [pd.to_datetime(t, dayfirst=True).date() for t in texts]
    assert got == want + [None] * len(none)
    for t in none:
        with pytest.raises(Exception):  # noqa: B017 - of several kinds
            pd.to_datetime(t, dayfirst=True)


def test_title_case_of_every_character(spark):
    """All characters that Spark's Java knows (Unicode 13), at a word's start and inside it."""
    known = [chr(p) for p in range(0x20000) if unicodedata.ucd_3_2_0.category(chr(p))[0] != "C"]
    texts = [c + "ab" for c in known] + ["x" + c + "Yz" for c in known]
    odd = {"\u10fc", "\u019b", "\u0264"}  # their case changed since
    got = _one(spark, texts, X.title_case)
    assert [t for t, g in zip(texts, got, strict=True) if g != t.title() and not odd & set(t)] == []
    assert _one(spark, ["日a ⅷx ﬁne ßeta", "ΑΣ ΣΑΣ", "İx aİ ǆa ŉa"], X.title_case) == ["日A Ⅷx Fine Sseta", "Ας Σας", "İx Ai̇ ǅa ʼNa"]


def test_amounts_in_any_white_space(spark):
    values = ["\xa05", "\u30005.5\t", "\x1c7", "1_000", "1__0", "_1"]
    assert [str(x) for x in _one(spark, values, M.parse_amount)] == ["5.00", "5.50", "7.00", "1000.00", "0.00", "0.00"]
    assert _one(spark, values, M.amount_readable) == [True, True, True, True, False, False]
