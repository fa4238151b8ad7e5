"""The cash carry-forward (W4): a hand-worked week and properties of random days."""

import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from tallyframe.operators.cash import carry_forward
from tallyframe.sources.schemas import MONEY


COLUMNS = "date date, cash_in decimal(18,2), cash_expense decimal(18,2), cash_in_hand decimal(18,2)"
# A hand-worked week from a seed of 1000: date, in, expense, count -> opening, needed, closing, short or excess.
WEEK = [
    ("2024-03-01", "200.00", "50.00", None, 1000, 1150, 1150, 0),
    ("2024-03-02", "0.00", "150.00", "990.00", 1150, 1000, 990, -10),  # counted 10 short
    ("2024-03-03", "10.00", "0.00", None, 990, 1000, 1000, 0),  # opens with the count
    ("2024-03-05", "0.00", "0.00", "1000.00", 1000, 1000, 1000, 0),  # a day without business between
    ("2024-03-06", "5.50", "0.00", "1010.00", 1000, 1005.5, 1010, 4.5),  # counted over
    ("2024-03-07", "0.00", "2000.00", None, 1010, -990, -990, 0),  # below zero, not counted
    ("2024-03-08", "0.00", "0.00", "0.00", -990, -990, 0, 990),  # a count of zero is a count
    ("2024-03-09", "7.00", "0.00", None, 0, 7, 7, 0),
]


def test_hand_worked_week(spark):
    days = [(dt.date.fromisoformat(d), Decimal(i), Decimal(e), Decimal(c) if c else None) for d, i, e, c, *_ in WEEK]
    got = carry_forward(spark.createDataFrame(days, COLUMNS), 1000).orderBy("date").select(
        "opening_cash", "cash_needed", "closing_cash", "cash_short_excess").collect()
    assert [tuple(map(float, r)) for r in got] == [tuple(map(float, w[4:])) for w in WEEK]


def test_properties_of_random_days(spark):
    rnd = random.Random(3)
    days = []
    for i in range(400):
        count = Decimal(rnd.randint(0, 900000)) / 100 if rnd.random() < 0.3 else None
        days.append((dt.date(2024, 1, 1) + dt.timedelta(days=i), Decimal(rnd.randint(0, 100000)) / 100, Decimal(rnd.randint(0, 80000)) / 100, count))
    got = carry_forward(spark.createDataFrame(days, COLUMNS), 50000).orderBy("date").collect()
    for r, (_, cin, out, count) in zip(got, days, strict=True):
        assert r.cash_needed - r.opening_cash == cin - out
        assert r.closing_cash - r.cash_needed == r.cash_short_excess
        assert (r.closing_cash == count) if count is not None else (r.cash_short_excess == 0)
    assert all(b.opening_cash == a.closing_cash for a, b in zip(got, got[1:], strict=False))
    # Money is conserved: the last closing is the seed, all movements and all corrections.
    assert got[-1].closing_cash == 50000 + sum(i - o for _, i, o, _ in days) + sum(r.cash_short_excess for r in got)


def test_first_day_counted_and_null_count(spark):
    days = [(dt.date(2024, 1, 1), Decimal("10.00"), Decimal("0.00"), Decimal("5.00")),
            (dt.date(2024, 1, 2), Decimal("1.00"), Decimal("2.00"), None),
            (dt.date(2024, 1, 3), Decimal("0.00"), Decimal("0.00"), None)]
    df = spark.createDataFrame(days, "date date, cash_in decimal(18,2), cash_expense decimal(18,2), "
                                     "cash_in_hand decimal(18,2)")
    got = carry_forward(df, 100).orderBy("date").select("opening_cash", "cash_short_excess").collect()
    assert [(float(a), float(b)) for a, b in got] == [(100.0, -105.0), (5.0, 0.0), (4.0, 0.0)]
    assert df.select(F.lit(1).cast(MONEY)).count() == 3
