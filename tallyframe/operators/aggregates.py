"""Single-pass aggregate reports: P&L, trial balance, dashboard, outstanding, daily mode summary.

Plan shape used throughout: the fact table (transactions) is reduced by a partial
aggregation keyed by ``party_id`` *before* it meets ``parties``. The hash aggregate
combines map-side, so a party holding a third of all rows collapses to one row per
task before the shuffle, and the join afterwards sees one row per party. Reports that
need no party attribute are one global aggregate over one scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import money as M
from ..functions import text as X
from ..functions.dates import iso_text, same_month


def _zero() -> Column:
    return F.lit(0).cast(M.MONEY)


def _sum_if(cond: Column, value: Column | None = None) -> Column:
    v = F.col("amount") if value is None else value
    return F.sum(F.when(cond, v))


def _is_type(t: str) -> Column:
    return X.ci_eq("txn_type", t)


def _is_mode(m: str) -> Column:
    return X.ci_eq("payment_mode", m)


def _in_types() -> Column:
    return X.ci_in("txn_type", ["Sale", "Receipt"])


def pnl(tx: DataFrame) -> DataFrame:
    """Sales, expenses and net profit in one scan (the reference runs two)."""
    agg = tx.agg(M.sum0(F.when(_is_type("Sale"), F.col("amount"))).alias("sales"),
                 M.sum0(F.when(_is_type("Expense"), F.col("amount"))).alias("expenses"))
    return agg.select(M.to_double("sales").alias("sales"),
                      M.to_double("expenses").alias("expenses"),
                      M.to_double(F.col("sales") - F.col("expenses")).alias("net_profit"))


def _account_flows(mode_pred: Column, prefix: str) -> list[Column]:
    return [_sum_if(mode_pred & _in_types()).alias(f"{prefix}_in"),
            _sum_if(mode_pred & _is_type("Expense")).alias(f"{prefix}_out")]


def _party_partials(tx: DataFrame, extra: list[Column]) -> DataFrame:
    """Per-party partial sums; rows with a null party form one group of their own."""
    return tx.groupBy("party_id").agg(*extra)


def _matched_flag(parties: DataFrame) -> DataFrame:
    # party_id is the primary key of parties, so this side has one row per key.
    return parties.select("party_id", F.lit(True).alias("matched"))


def trial_balance_figures(tx: DataFrame, parties: DataFrame) -> DataFrame:
    """A8, A7, A11 as one row: every figure of the trial balance from one scan."""
    partial = _party_partials(tx, [
        *_account_flows(X.is_bank_group("payment_mode"), "bank"),
        *_account_flows(_is_mode("Cash"), "cash"),
        *_account_flows(_is_mode("UPI"), "upi"),
        F.sum(F.when(_is_type("Sale"), F.col("amount")).otherwise(-F.col("amount"))).alias("debtors"),
        F.sum(F.when(_is_type("Purchase"), F.col("amount")).otherwise(-F.col("amount"))).alias("creditors"),
        _sum_if(_is_type("Sale")).alias("sales"),
        _sum_if(_is_type("Expense")).alias("expenses"),
    ])
    joined = partial.join(_matched_flag(parties), "party_id", "left")
    m = F.col("matched").isNotNull()
    return joined.agg(
        *[M.sum0(c).alias(c) for c in ["cash_in", "cash_out", "bank_in", "bank_out", "upi_in",
                                        "upi_out", "sales", "expenses"]],
        M.sum0(F.when(m, F.col("debtors"))).alias("debtors"),
        M.sum0(F.when(m, F.col("creditors"))).alias("creditors"),
    ).select(
        (F.col("cash_in") - F.col("cash_out")).alias("cash"),
        (F.col("bank_in") - F.col("bank_out")).alias("bank"),
        (F.col("upi_in") - F.col("upi_out")).alias("upi"),
        "debtors", "creditors", "sales", "expenses")


def trial_balance(tx: DataFrame, parties: DataFrame, with_total: bool = True) -> DataFrame:
    """A9 (+A10): seven accounts as debit / credit, then a TOTAL row.

    The TOTAL is summed inside the same one-row projection as the accounts, so the whole
    report is one scan of transactions and one shuffle of per-party partial sums.
    """
    fig = trial_balance_figures(tx, parties)
    accounts = [
        ("Cash Account", M.debit_part("cash"), M.credit_part("cash")),
        ("Bank Account", M.debit_part("bank"), M.credit_part("bank")),
        ("UPI Account", M.debit_part("upi"), M.credit_part("upi")),
        ("Sundry Debtors", M.debit_part("debtors"), M.credit_part("debtors")),
        ("Sundry Creditors", M.debit_part("creditors"), M.credit_part("creditors")),
        ("Sales Account", _zero(), F.col("sales")),
        ("Expense Account", F.col("expenses"), _zero()),
    ]
    if with_total:
        accounts.append(("TOTAL", sum((d.cast(M.WIDE) for _, d, _ in accounts[1:]), accounts[0][1].cast(M.WIDE)),
                         sum((c.cast(M.WIDE) for _, _, c in accounts[1:]), accounts[0][2].cast(M.WIDE))))
    rows = F.array(*[
        F.struct(F.lit(i + 1).alias("ord"), F.lit(name).alias("account"),
                 debit.cast(M.WIDE).alias("debit"), credit.cast(M.WIDE).alias("credit"))
        for i, (name, debit, credit) in enumerate(accounts)])
    return fig.select(F.inline(rows)).select(
        "ord", "account", M.to_double("debit").alias("debit"), M.to_double("credit").alias("credit"))


def dashboard(tx: DataFrame, parties: DataFrame, as_of: str | None = None) -> DataFrame:
    """A12 + A13: KPIs as of a date (today when not given), in one scan of transactions."""
    day = F.to_date(F.lit(as_of)) if as_of else F.current_date()
    sale = _is_type("Sale")
    partial = _party_partials(tx, [
        _sum_if(sale & (F.col("txn_date") == day)).alias("sales_today"),
        _sum_if(sale & same_month("txn_date", day)).alias("sales_month"),
        *_account_flows(_is_mode("Cash"), "cash"),
        *_account_flows(X.is_bank_group("payment_mode"), "bank"),
        _sum_if(sale).alias("sales_all"),
        _sum_if(_is_type("Receipt")).alias("receipts_all"),
    ])
    cust = parties.select("party_id", X.ci_eq("type", "Customer").alias("is_customer"))
    joined = partial.join(cust, "party_id", "left")
    is_c = F.coalesce(F.col("is_customer"), F.lit(False))
    fig = joined.agg(
        M.sum0("sales_today").alias("sales_today"),
        M.sum0("sales_month").alias("sales_month"),
        (M.sum0("cash_in") - M.sum0("cash_out")).alias("cash_balance"),
        (M.sum0("bank_in") - M.sum0("bank_out")).alias("bank_balance"),
        (M.sum0(F.when(is_c, F.col("sales_all"))) - M.sum0(F.when(is_c, F.col("receipts_all"))))
        .alias("receivables"),
    )
    return fig.select(
        *[M.to_double(c).alias(c) for c in ["sales_today", "sales_month", "cash_balance",
                                             "bank_balance", "receivables"]],
        M.to_double(F.col("cash_balance") + F.col("bank_balance")).alias("total_funds"),
        M.ratio_pct("cash_balance", F.col("cash_balance") + F.col("bank_balance")).alias("cash_ratio"),
    )


def _outstanding(tx: DataFrame, parties: DataFrame) -> DataFrame:
    """A6 with exact balances: per credit customer (grouped by name, as the reference does), Sale - Receipt, kept when > 0."""
    per_party = tx.where(F.col("party_id").isNotNull() & (_is_type("Sale") | _is_type("Receipt"))).groupBy("party_id").agg(
        M.sum0(F.when(_is_type("Sale"), F.col("amount"))).alias("s"),
        M.sum0(F.when(_is_type("Receipt"), F.col("amount"))).alias("r"))
    credit_customers = parties.where(X.ci_eq("type", "Credit Customer")).select("party_id", "name")
    # LEFT JOIN from parties: a party with no rows has balance 0 and is dropped by HAVING.
    joined = credit_customers.join(per_party, "party_id", "left")
    by_name = joined.groupBy("name").agg((M.sum0("s") - M.sum0("r")).alias("balance"))
    return by_name.where(F.col("balance") > 0).select(F.col("name").alias("party"), "balance")


def outstanding(tx: DataFrame, parties: DataFrame) -> DataFrame:
    """Per credit customer, Sale - Receipt, kept when > 0."""
    return _outstanding(tx, parties).select("party", M.to_double("balance").alias("balance"))


def outstanding_total(tx: DataFrame, parties: DataFrame) -> DataFrame:
    """A6 total: sum of the kept balances (0 when none)."""
    return _outstanding(tx, parties).agg(
        F.coalesce(F.sum(F.col("balance").cast(M.WIDE)), F.lit(0).cast(M.WIDE))
        .cast("double").alias("total"))


def daily_mode_summary(tx: DataFrame) -> DataFrame:
    """A4: per day, cash / bank / UPI in and out.

    Rows pass the filter by a case-insensitive mode test, but only the exact spellings
    ``Cash``, ``Bank``, ``UPI`` are added up and only exact ``Sale`` / ``Receipt`` count as
    in (Q2): a day with only GPay rows shows zeros.
    """
    passes = X.ci_in("payment_mode", ["Cash"] + X.BANK_GROUP_MODES)
    amt = M.zero_if_null("amount")
    is_in = F.col("txn_type").isin("Sale", "Receipt")
    mode = F.col("payment_mode")

    def col(m: str, inflow: bool) -> Column:
        cond = (mode == m) & (is_in if inflow else ~is_in | F.col("txn_type").isNull())
        return M.sum0(F.when(cond, amt)).cast("double")

    return (tx.where(passes)
              .groupBy("txn_date")
              .agg(col("Cash", True).alias("cash_in"), col("Cash", False).alias("cash_out"),
                   col("Bank", True).alias("bank_in"), col("Bank", False).alias("bank_out"),
                   col("UPI", True).alias("upi_in"), col("UPI", False).alias("upi_out"))
              .orderBy(F.desc("txn_date"))
              .select(iso_text("txn_date").alias("date"), "cash_in", "cash_out", "bank_in",
                      "bank_out", "upi_in", "upi_out"))


def type_report_total(tx: DataFrame, parties: DataFrame, txn_type: str) -> DataFrame:
    """Total of the type report (null amounts count 0); summed per party first, so only
    per-party partials meet ``parties``."""
    per_party = tx.where(_is_type(txn_type)).groupBy("party_id").agg(F.sum("amount").alias("s"))
    known = per_party.join(parties.select("party_id"), "party_id", "left_semi")
    return known.agg(M.sum0("s").cast("double").alias("total"))


def page_info(tx: DataFrame, page: int, limit: int) -> DataFrame:
    """Page metadata; ``total`` counts every transaction, also those the list join drops."""
    return tx.agg(F.count(F.lit(1)).alias("total")).select(
        F.lit(page).cast("long").alias("page"), F.lit(limit).cast("long").alias("limit"),
        F.col("total").cast("long").alias("total"),
        F.floor((F.col("total") + F.lit(limit - 1)) / F.lit(limit)).cast("long").alias("total_pages"))
