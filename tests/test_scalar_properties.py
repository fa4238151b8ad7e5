"""Scalar functions: golden values, and properties on generated text.

Each hypothesis example is a batch of values evaluated in one Spark job.
"""

import datetime as dt
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyframe.functions import dates as D
from tallyframe.functions import text as X

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.too_slow])
ascii_text = st.text(alphabet=st.sampled_from(list("abcXYZ 0189-_./'\t")), max_size=14)


def _eval(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, x string")
    return [r[1] for r in df.select("i", fn(F.col("x"))).orderBy("i").collect()]


BILLS = {None: "", "": "", "  ": "", "7": "8", "INV-9": "INV-10", "INV-009": "INV-010", "A99": "A100", "2024/0099": "2024/0100", "ABC": "ABC",
         "12B": "12B", "A1B2": "A1B3", "x-000": "x-001"}
COMPANIES = {"Alpha Traders": "alpha_traders", "  Alpha   Traders ": "alpha_traders", "A.B. & Co": "ab__co", "": "default", "***": "default",
             "Über Ltd": "ber_ltd", "a_b-c": "a_bc", "9 to 5": "9_to_5", "Tab\tName": "tab_name"}


@SETTINGS
@given(st.lists(ascii_text, min_size=1, max_size=60))
def test_title_case_is_python_title(spark, values):
    assert _eval(spark, values, X.title_case) == [v.title() for v in values]


def test_next_bill_goldens(spark):
    assert _eval(spark, list(BILLS), X.next_bill_number) == list(BILLS.values())


@SETTINGS
@given(st.lists(st.tuples(st.text(alphabet="ABC-/", max_size=5), st.integers(0, 10**6), st.integers(1, 9)), min_size=1, max_size=60))
def test_next_bill_counts_up_and_keeps_its_width(spark, items):
    bills = [f"{head}{n:0{width}d}" for head, n, width in items]
    got = _eval(spark, bills, X.next_bill_number)
    for (head, n, _), old, new in zip(items, bills, got, strict=True):
        assert new.startswith(head) and int(new[len(head):]) == n + 1 and len(new) - len(old) in (0, 1)


def test_company_key_goldens(spark):
    assert _eval(spark, list(COMPANIES), X.company_key) == list(COMPANIES.values())


@SETTINGS
@given(st.lists(ascii_text, min_size=1, max_size=60))
def test_keys_properties(spark, values):
    keys = _eval(spark, values, X.company_key)
    assert all(k and set(k) <= set("abcdefghijklmnopqrstuvwxyz0123456789_") for k in keys)
    assert _eval(spark, keys, X.company_key) == keys  # a key is its own key
    assert _eval(spark, [v.upper() for v in values], X.company_key) == keys
    server = _eval(spark, values, X.server_key)
    assert all(" " not in k and k == k.lower() and len(k) == len(v) for k, v in zip(server, values, strict=True))
    assert all(not re.search(r"\s", k) for k in _eval(spark, values, X.client_key))


dates = st.dates(min_value=dt.date(1950, 1, 1), max_value=dt.date(2060, 12, 31))


@SETTINGS
@given(st.lists(st.tuples(dates, st.sampled_from([".", "/", "-"]), st.booleans(), st.booleans()),
                min_size=1, max_size=60))
def test_numeric_day_first_dates(spark, items):
    texts, want = [], []
    for d, sep, pad, four in items:
        day = f"{d.day:02d}" if pad else str(d.day)
        month = f"{d.month:02d}" if pad else str(d.month)
        year = f"{d.year:04d}" if four else f"{d.year % 100:02d}"
        texts.append(f"{day}{sep}{month}{sep}{year}")
        if four:
            want.append(d)
        else:  # two-digit years pivot at 2076
            y = 2000 + d.year % 100
            want.append(d.replace(year=y - 100 if y >= 2076 else y))
    assert _eval(spark, texts, lambda c: D.parse_day_first(c, pivot_year=2076)) == want
