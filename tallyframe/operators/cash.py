"""Daily cash reconciliation: per-day cash aggregate (A5), carry-forward with reset (W4),
daily cash summary (R4), short / excess (R5) with its monthly roll-up (A16) and total (A15).

Plan: one scan of transactions, the party lookup (J3) joined to the rows, one map-side
combined aggregate per day. Only the per-day table -- bounded by the calendar, not by the
data -- goes through the ordered carry-forward window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import money as M
from ..functions import text as X
from ..functions.dates import iso_text, month_key

SUMMARY_COLUMNS = ["date", "opening_cash", "cash_in", "cash_expense", "cash_needed", "closing_cash",
                   "cash_in_hand", "cash_short_excess", "bank", "credit_sale", "total_sales"]
SHORT_COLUMNS = ["date", "opening_cash", "cash_in", "cash_expense", "cash_needed", "cash_in_hand",
                 "cash_short_excess"]


def daily_cash_aggregate(tx: DataFrame, parties: DataFrame) -> DataFrame:
    """A5: per day ``cash_in``, ``cash_expense``, ``bank``, ``credit_sale``, ``total_sales`` (DECIMAL).

    Types and modes go through the prefix ladders (F4, F5); null amounts count 0;
    credit-mode receipts count as cash in (Q3). Rows with a null date are left out (Q17).

    The credit-customer flag (J3) is joined to the rows before the per-day aggregate:
    rows rarely repeat a (day, party) pair, so aggregating by it first would only add a
    shuffle. AQE broadcasts ``parties`` when its measured size allows and otherwise splits
    a hot party's partition in the sort-merge join; the per-day aggregate combines map-side.
    """
    cc = parties.select("party_id",
                        (F.lower(X.py_strip(F.coalesce(F.col("type"), F.lit("")))) == "credit customer")
                        .alias("is_cc"))
    rows = tx.where(F.col("txn_date").isNotNull()).select(
        "txn_date", "party_id", X.type_norm("txn_type").alias("t"), X.mode_norm("payment_mode").alias("m"),
        M.zero_if_null("amount").alias("amt"))
    joined = rows.join(cc, "party_id", "left")
    t, m, a = F.col("t"), F.col("m"), F.col("amt")
    is_cc = F.coalesce(F.col("is_cc"), F.lit(False))
    sale, receipt = t == "sale", t == "receipt"
    in_type = t.isin("sale", "receipt")

    def s(cond):
        return M.sum0(F.when(cond, a))

    return joined.groupBy(F.col("txn_date").alias("date")).agg(
        s(((m == "cash") | ((m == "credit") & receipt)) & in_type).alias("cash_in"),
        s((m == "cash") & (t == "expense")).alias("cash_expense"),
        s(X.is_bank_norm(m) & in_type).alias("bank"),
        (s(sale & (is_cc | (m == "credit"))) - s(receipt & is_cc)).alias("credit_sale"),
        s(sale).alias("total_sales"),
    )


def carry_forward(days: DataFrame, seed) -> DataFrame:
    """W4 in closed form over one row per day.

    ``opening`` of a day is the previous day's count when it was counted, else the previous
    day's computed closing; the first day opens with ``seed``. With ``S`` = net of all
    earlier days and ``k`` the last counted day before this one:
    ``opening = count(k) + S - S_incl(k)`` (the net since that count), or ``seed + S``
    when no day before was counted. Every window has the same (date) order, so they run
    in one pass over the per-day table -- bounded by the calendar, not by the data.
    """
    seed_col = (seed if isinstance(seed, Column) else F.lit(seed)).cast(M.WIDE)
    zero = F.lit(0).cast(M.WIDE)
    net = (F.col("cash_in") - F.col("cash_expense")).cast(M.WIDE)
    order = Window.orderBy("date")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    d = days.withColumn("__net", net).select(
        "*",
        F.coalesce(F.sum("__net").over(before), zero).alias("__s"),
        F.sum("__net").over(upto).alias("__s_incl"))
    d = d.select(
        "*",
        F.last("cash_in_hand", ignorenulls=True).over(before).cast(M.WIDE).alias("__last_count"),
        F.last(F.when(F.col("cash_in_hand").isNotNull(), F.col("__s_incl")), ignorenulls=True)
        .over(before).alias("__s_at_count"))
    opening = F.when(F.col("__last_count").isNotNull(),
                     F.col("__last_count") + F.col("__s") - F.col("__s_at_count")) \
               .otherwise(seed_col + F.col("__s"))
    d = d.withColumn("opening_cash", opening.cast(M.WIDE))
    needed = F.col("opening_cash") + F.col("__net")
    return d.select(
        "*",
        needed.alias("cash_needed"),
        F.coalesce(F.col("cash_in_hand").cast(M.WIDE), needed).alias("closing_cash"),
        F.coalesce(F.col("cash_in_hand") - needed, zero).alias("cash_short_excess"),
    ).drop("__net", "__s", "__s_incl", "__last_count", "__s_at_count")


def cash_days(tx: DataFrame, parties: DataFrame, daily_cash: DataFrame) -> DataFrame:
    """Every day that has transactions or a cash count, its figures (A5) and its count (null where not counted)."""
    per_day = daily_cash_aggregate(tx, parties)
    counts = daily_cash.where(F.col("cash_date").isNotNull()).select(
        F.col("cash_date").alias("date"), "cash_in_hand")
    days = per_day.join(counts, "date", "full_outer")
    zero = F.lit(0).cast(M.WIDE)
    return days.select(
        "date",
        *[F.coalesce(F.col(c).cast(M.WIDE), zero).alias(c)
          for c in ["cash_in", "cash_expense", "bank", "credit_sale", "total_sales"]],
        "cash_in_hand")


def daily_cash_summary_decimal(tx: DataFrame, parties: DataFrame, daily_cash: DataFrame,
                               seed) -> DataFrame:
    """R4 with DECIMAL figures and a DATE column, for further composition."""
    return carry_forward(cash_days(tx, parties, daily_cash), seed)


def daily_cash_summary(tx: DataFrame, parties: DataFrame, daily_cash: DataFrame, seed) -> DataFrame:
    """The daily cash summary, money as DOUBLE and the date as ISO text."""
    d = daily_cash_summary_decimal(tx, parties, daily_cash, seed)
    return d.orderBy(F.desc("date")).select(
        iso_text("date").alias("date"),
        *[M.to_double(c).alias(c) for c in SUMMARY_COLUMNS[1:]])


def short_excess(tx: DataFrame, parties: DataFrame, daily_cash: DataFrame, seed) -> DataFrame:
    """R4 projected to the seven short / excess columns."""
    return daily_cash_summary(tx, parties, daily_cash, seed).select(*SHORT_COLUMNS)


def short_excess_monthly(tx: DataFrame, parties: DataFrame, daily_cash: DataFrame, seed) -> DataFrame:
    """Per month, the sum of shorts (< 0), of excesses (> 0) and their net.
    A month whose days are all exact still appears with zeros."""
    d = daily_cash_summary_decimal(tx, parties, daily_cash, seed)
    x = F.col("cash_short_excess")
    return (d.groupBy(month_key("date").alias("month"))
             .agg(M.sum0(F.when(x < 0, x)).alias("short"), M.sum0(F.when(x > 0, x)).alias("excess"))
             .select("month", M.to_double("short").alias("short"), M.to_double("excess").alias("excess"),
                     M.to_double(F.col("short") + F.col("excess")).alias("net"))
             .orderBy(F.desc("month")))


def total_short(tx: DataFrame, parties: DataFrame, daily_cash: DataFrame, seed) -> DataFrame:
    """The sum of negative differences; the row exists only when it is not zero."""
    d = daily_cash_summary_decimal(tx, parties, daily_cash, seed)
    x = F.col("cash_short_excess")
    return (d.agg(M.sum0(F.when(x < 0, x)).alias("total_short"))
             .where(F.col("total_short") != 0)
             .select(M.to_double("total_short").alias("total_short")))
