"""Row lists: day book (R1), transactions page (R2), type report (R3), search (P13),
party list (P18), audit trail (R7)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import money as M
from ..functions import text as X
from ..functions.dates import date_text, iso_text, timestamp_text

LIST_COLUMNS = ["id", "date", "bill_no", "party", "type", "mode", "amount"]


def joined_list(tx: DataFrame, parties: DataFrame) -> DataFrame:
    """J1 + P1: transactions with their party name, in the reference's row contract.

    Rows whose party is null or unknown drop out, as in the inner join of the reference.
    No broadcast hint: AQE broadcasts ``parties`` when its measured size allows, and
    otherwise splits the partitions of a hot party in the sort-merge join (skew join).
    """
    j = tx.join(parties.select("party_id", F.col("name").alias("party")), "party_id", "inner")
    return j.select(
        F.col("txn_id").alias("id"), F.col("txn_date"),
        iso_text("txn_date").alias("date"),
        F.coalesce(F.col("bill_no"), F.lit("")).alias("bill_no"),
        "party", F.col("txn_type").alias("type"), F.col("payment_mode").alias("mode"),
        F.col("amount"))


def _finish(df: DataFrame) -> DataFrame:
    return df.select(*[M.to_double("amount").alias("amount") if c == "amount" else F.col(c)
                       for c in LIST_COLUMNS])


def day_book(tx: DataFrame, parties: DataFrame, date: str) -> DataFrame:
    """One day's rows, newest id first. The date filter is applied to the scan."""
    day = tx.where(F.col("txn_date") == F.to_date(F.lit(date)))
    return _finish(joined_list(day, parties).orderBy(F.desc("txn_date"), F.desc("id")))


def transactions_page(tx: DataFrame, parties: DataFrame, page: int = 1, limit: int = 100) -> DataFrame:
    """One page in (date desc, id desc) order. Spark plans this as a bounded top-k
    (offset + limit rows per task), not a full sort."""
    return _finish(_top(tx, parties, limit, (page - 1) * limit))


def _top(tx: DataFrame, parties: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """The page's rows: the top-k runs over three narrow columns of the rows with a party, and only
    its ``limit`` rows meet the whole tables."""
    narrow = tx.select("txn_date", "txn_id", "party_id").join(parties.select("party_id"), "party_id", "left_semi")
    keys = narrow.orderBy(F.desc("txn_date"), F.desc("txn_id")).offset(offset).limit(limit).select(F.col("txn_id").alias("__id"))
    page = tx.join(F.broadcast(keys), F.col("txn_id") == F.col("__id"), "left_semi")  # ``limit`` rows
    return joined_list(page, parties).orderBy(F.desc("txn_date"), F.desc("id"))


def transactions_page_after(tx: DataFrame, parties: DataFrame, after_date: str | None,
                            after_id: int | None, limit: int = 100) -> DataFrame:
    """O4 for deep pages: the next ``limit`` rows after the last row shown (keyset paging).

    Same order as ``transactions_page``; rows strictly before (``after_date``,
    ``after_id``) in (date desc, id desc) order. Unlike an offset, the filter is applied
    before the top-k, so every page costs the same however deep it is.
    """
    if after_date is not None and after_id is not None:
        d = F.to_date(F.lit(after_date))
        tx = tx.where((F.col("txn_date") < d) | ((F.col("txn_date") == d) & (F.col("txn_id") < after_id)))
    return _finish(_top(tx, parties, limit))


def type_report(tx: DataFrame, parties: DataFrame, txn_type: str) -> DataFrame:
    """Rows of one type (case-insensitive), by date."""
    rows = joined_list(tx.where(X.ci_eq("txn_type", txn_type)), parties)
    return rows.orderBy("txn_date", "id").select(
        "id", "date", "bill_no", "party", "mode", M.to_double("amount").alias("amount"))


def _shown(col) -> F.Column:
    # A template literal shows a missing value as "null".
    return F.coalesce(col.cast("string"), F.lit("null"))


def shown_cells() -> list[F.Column]:
    """The cells of a list row as a search sees them: date as DD-MM-YYYY, amount with two decimals."""
    return [F.date_format("txn_date", "dd-MM-yyyy"), F.col("bill_no"), _shown(F.col("party")), _shown(F.col("type")),
            _shown(F.col("mode")), F.coalesce(M.fixed2("amount"), F.lit(""))]


def matches(query: str) -> F.Column:
    """Whether any displayed cell of a list row contains ``query``, case-insensitively."""
    return reduce(lambda a, b: a | b, [F.upper(c).contains(F.lit(query.upper())) for c in shown_cells()])


def search(tx: DataFrame, parties: DataFrame, query: str) -> DataFrame:
    """Rows where any displayed cell contains ``query``, case-insensitively.

    Cells are matched as displayed: date as DD-MM-YYYY, amount with two decimals.
    An empty query keeps every row.
    """
    rows = joined_list(tx, parties)
    return _finish(rows.where(matches(query)) if query else rows)


def party_list(parties: DataFrame) -> DataFrame:
    """Party names and types in name order (ties by id, so a name shared by many
    parties does not fall into one range of the sort)."""
    return parties.orderBy("name", "party_id").select("name", "type")


def audit_trail(audit: DataFrame, company: str | None = None) -> DataFrame:
    """Audit rows of one company (``default`` when none), newest first.
    A null company never matches."""
    comp = company or "default"
    return (audit.where(F.col("company") == F.lit(comp))
                 .orderBy(F.desc("timestamp"), F.desc("id"))
                 .select(timestamp_text("timestamp").alias("timestamp"), "username", "action", "details"))
