"""Running-balance statements: party ledger (W1), client ledger statement (W2), account statement.

All parties are computed at once; a single party is the same plan behind a pushed-down
filter. Ties within a day are broken by ``txn_id`` (Q6). Null amounts stay null in the
listed rows and count 0 in the balance (Q7).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import money as M
from ..functions import text as X
from ..functions.dates import iso_text
from .running import HOT_ROWS, running_total


def _date_range(tx: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Bounds are applied only when given; both are inclusive."""
    if start:
        tx = tx.where(F.col("txn_date") >= F.to_date(F.lit(start)))
    if end:
        tx = tx.where(F.col("txn_date") <= F.to_date(F.lit(end)))
    return tx


def _known_party_rows(tx: DataFrame, parties: DataFrame, party_key: str | None = None) -> DataFrame:
    """Rows of existing parties (rows of unknown parties have no ledger). With
    ``party_key`` only that party, matched on ``normalized_name`` as the reference
    matches the key the client sends; an unknown key gives an empty ledger."""
    if party_key is not None:
        parties = parties.where(F.col("normalized_name") == F.lit(party_key))
    return tx.join(parties.select("party_id"), "party_id", "left_semi")


def party_ledger(tx: DataFrame, parties: DataFrame, start: str | None = None,
                 end: str | None = None, hot_rows: int = HOT_ROWS,
                 parts: int | None = None, party_key: str | None = None) -> DataFrame:
    """Balance starts at 0 inside the date range; exact ``Sale`` adds, everything else
    subtracts. All parties at once, or one with ``party_key``."""
    rows = _known_party_rows(_date_range(tx, start, end), parties, party_key)
    amt = M.zero_if_null("amount")
    signed = F.when(F.col("txn_type") == "Sale", amt).otherwise(-amt)
    out = running_total(rows, signed, "balance", ["party_id"], "txn_date", "txn_id", hot_rows, parts)
    return out.select(
        "party_id", F.col("txn_id").alias("id"), iso_text("txn_date").alias("date"),
        F.coalesce(F.col("bill_no"), F.lit("")).alias("bill_no"),
        F.col("txn_type").alias("type"), F.col("payment_mode").alias("mode"),
        M.to_double("amount").alias("amount"), M.to_double("balance").alias("balance"))


def ledger_statement(tx: DataFrame, parties: DataFrame, start: str | None = None,
                     end: str | None = None, hot_rows: int = HOT_ROWS,
                     parts: int | None = None, party_key: str | None = None) -> DataFrame:
    """The client's statement: debit / credit columns and a ``Dr`` / ``Cr`` balance label.

    Its sign rule differs from W1: only receipt, reciept and sale return (lower-trimmed)
    go to the credit side; everything else, purchases included, is a debit.
    """
    rows = _known_party_rows(_date_range(tx, start, end), parties, party_key)
    amt = M.zero_if_null("amount")
    on_credit = F.lower(X.py_strip(F.coalesce(F.col("txn_type"), F.lit("")))).isin(X.CREDIT_SIDE_TYPES)
    signed = F.when(on_credit, -amt).otherwise(amt)
    out = running_total(rows.withColumn("__credit", on_credit), signed, "balance",
                        ["party_id"], "txn_date", "txn_id", hot_rows, parts)
    c = F.col("__credit")
    return out.select(
        "party_id", F.col("txn_id").alias("id"), iso_text("txn_date").alias("date"),
        F.coalesce(F.col("bill_no"), F.lit("")).alias("bill_no"),
        X.particulars("txn_type", "payment_mode").alias("particulars"),
        F.when(~c, amt).cast("double").alias("debit"),
        F.when(c, amt).cast("double").alias("credit"),
        M.to_double("balance").alias("balance"),
        M.balance_label("balance").alias("balance_label"))


def account_rows(tx: DataFrame, parties: DataFrame, mode: str) -> DataFrame:
    """W3 rows: ``bank`` (any case) selects the bank group, any other mode is compared
    case-insensitively; rows go through the inner join with parties (J1)."""
    pred: Column = X.is_bank_group("payment_mode") if mode.lower() == "bank" \
        else X.ci_eq("payment_mode", mode)
    return tx.where(pred).join(parties.select("party_id", F.col("name").alias("party")),
                               "party_id", "inner")


def account_statement(tx: DataFrame, parties: DataFrame, mode: str,
                      hot_rows: int = HOT_ROWS, parts: int | None = None) -> DataFrame:
    """One account's debit (exact Sale / Receipt) and credit (all else), running over the
    whole account: days carry to the next, and days of more than ``hot_rows`` rows are ranged (no single-task window)."""
    rows = account_rows(tx, parties, mode)
    amt = M.zero_if_null("amount")
    is_in = F.col("txn_type").isin("Sale", "Receipt")
    is_in = F.coalesce(is_in, F.lit(False))
    signed = F.when(is_in, amt).otherwise(-amt)
    out = running_total(rows.withColumn("__in", is_in), signed, "balance", [], "txn_date",
                        "txn_id", hot_rows, parts)
    i = F.col("__in")
    zero = F.lit(0).cast(M.MONEY)
    return out.select(
        F.col("txn_id").alias("id"), iso_text("txn_date").alias("date"),
        F.coalesce(F.col("bill_no"), F.lit("")).alias("bill_no"),
        "party", F.col("txn_type").alias("type"),
        F.when(i, amt).otherwise(zero).cast("double").alias("debit"),
        F.when(i, zero).otherwise(amt).cast("double").alias("credit"),
        M.to_double("balance").alias("balance"))
