"""Import of transaction files (M11) and client entry validation.

The reference cleans one row at a time and makes two or three database round trips per
row. Here the whole file is one plan with two outputs, accepted rows and rejected rows
with the first failing reason, plus the parties the file creates (J7).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import money as M
from ..functions import text as X
from ..functions.dates import iso_text, parse_day_first
from ..session import materialized
from ..sources.schemas import MONEY
from .running import dense_number

# Fixed values that must equal the reference's: header aliases, first present non-null wins.
DATE_ALIASES = ["Date", "date", "txn_date"]
BILL_ALIASES = ["Bill No / Invoice", "BillNo", "Bill No", "bill_no"]
PARTY_ALIASES = ["Customer Name", "Party", "party", "Name"]
TYPE_ALIASES = ["Transaction Type", "Type", "txn_type"]
MODE_ALIASES = ["Payment Mode", "payment Mode", "yment Mo", "Mode", "payment_mode"]
AMOUNT_ALIASES = ["Amount", "amount"]

# Text a pandas CSV reader takes as missing by default (Q20).
PANDAS_NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
                    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

NEW_PARTY_TYPE = "Customer"

# Fixed values that must equal the reference's: why a row or an entry is rejected.
MISSING_DATE, INVALID_DATE, MISSING_PARTY = "Missing date", "Invalid date format: ", "Missing party name"
REQUIRED_MSG = "All fields (Date, Party, Type, Mode, Amount) are mandatory."
NO_CREDIT = ("Credit Mode is NOT allowed for '", "' (Type: ", "). Only 'Credit Customer' can take credit.")
NO_PARTY = ("Party '", "' not found. Create it in 'Manage > Add Party' first.")


def _known_cell(cell: Column) -> Column:
    return F.when(~cell.isin(PANDAS_NA_TOKENS), cell)


def na_tokens_to_null(df: DataFrame, keep: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """Q20: map the missing-value tokens of a pandas reader to null in every text column."""
    return df.select(*[
        F.col(f"`{c}`") if c in keep else
        F.when(F.col(f"`{c}`").isin(PANDAS_NA_TOKENS), F.lit(None).cast("string"))
         .otherwise(F.col(f"`{c}`")).alias(c)
        for c in df.columns])


def first_present(df: DataFrame, aliases: list[str], default: Column | None = None) -> Column:
    """coalesce over the alias columns that exist in this file, then the default. Records of import files have
    their cells in a map, by the exact names of their file's header."""
    if "cells" in df.columns:
        cols = [_known_cell(F.col("cells")[a]) for a in aliases]
    else:
        cols = [F.col(f"`{a}`").cast("string") for a in aliases if a in df.columns]
    if default is not None:
        cols.append(default)
    if not cols:
        return F.lit(None).cast("string")
    return F.coalesce(*cols) if len(cols) > 1 else cols[0]


@dataclass
class ImportResult:
    """Outputs of one import. ``accepted`` and ``new_parties`` carry no ids; ids are given
    when rows are appended (``with_ids``), as an identity column is filled on insert."""
    accepted: DataFrame       # row_id, file, row_order, txn_date, bill_no, party, party_key, txn_type, payment_mode, amount
    rejected: DataFrame       # file, row_id, row_order, reason
    new_parties: DataFrame    # name, normalized_name, type, credit_allowed, first_row
    counts: DataFrame         # status, n
    parties: DataFrame
    transactions: DataFrame | None

    def with_ids(self, last_party: int | None = None, last_txn: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(new parties with ``party_id``, accepted rows with ``party_id`` and ``txn_id``),
        numbered after the largest existing ids (or the given ones) in (file, record) order (W6). Both are written
        once below ``spark.checkpoint.dir`` when called."""
        max_party = (F.lit(last_party) if last_party is not None
                     else self.parties.select(F.coalesce(F.max("party_id"), F.lit(0))).scalar())
        parties = dense_number(materialized(self.new_parties, "import-parties"), "first_row", "party_id", start=max_party).select(
            "party_id", "name", "normalized_name", "type", "credit_allowed")
        known = self.parties.select(F.col("normalized_name").alias("party_key"), "party_id")
        ids = known.unionByName(parties.select(F.col("normalized_name").alias("party_key"), "party_id"))
        # Numbering reads its rows twice (cuts, then rows), so the joined rows are written first.
        resolved = materialized(self.accepted.join(ids, "party_key", "inner"), "import-resolved")
        max_txn = F.lit(last_txn) if last_txn is not None else (self.transactions.select(F.coalesce(F.max("txn_id"), F.lit(0))).scalar()
                   if self.transactions is not None else F.lit(0))
        accepted = dense_number(resolved, "row_order", "txn_id", start=max_txn)
        return parties, accepted.drop("row_order")


def clean_import(raw: DataFrame, iso: str = "ymd", pivot_year: int | None = None) -> DataFrame:
    """One cleaned row per input row (columns by name, or records of
    ``io.read_import_records``), with ``reason`` set on the
    first failing check (a record that is not whole, missing date, invalid date, missing party, an amount too
    large for the column) and null otherwise."""
    date_raw = first_present(raw, DATE_ALIASES)
    party = first_present(raw, PARTY_ALIASES)
    bill = first_present(raw, BILL_ALIASES, F.lit(""))
    ttype = first_present(raw, TYPE_ALIASES)
    mode = first_present(raw, MODE_ALIASES)
    amount_text = first_present(raw, AMOUNT_ALIASES)
    # Two projections: the date is parsed once and the reason reads the parsed column.
    first = raw.select(
        F.col("row_id"),
        (F.col("file") if "file" in raw.columns else F.lit(None).cast("string")).alias("file"),
        (F.col("row_order") if "row_order" in raw.columns else F.col("row_id")).cast("long").alias("row_order"),
        (F.col("problem") if "problem" in raw.columns else F.lit(None).cast("string")).alias("__problem"),
        date_raw.alias("__date_raw"),
        parse_day_first(date_raw, iso=iso, pivot_year=pivot_year).alias("txn_date"),
        bill.alias("bill_no"),
        party.alias("party"),
        ttype.alias("__type"), mode.alias("__mode"), amount_text.alias("__amount"))
    # Barrier: filters on the parsed date (``reason IS NULL``) would otherwise be pushed
    # below this projection with the parse expression substituted, parsing every row twice.
    # A filter on a generator's output stays above it.
    first = first.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in first.columns]))))
    d, p, t, m, a = (F.col(c) for c in ("__date_raw", "party", "__type", "__mode", "__amount"))
    reason = (F.when(F.col("__problem").isNotNull(), F.col("__problem"))
               .when(d.isNull() | (d == ""), F.lit(MISSING_DATE))
               .when(F.col("txn_date").isNull(), F.concat(F.lit(INVALID_DATE), d))
               .when(p.isNull() | (p == ""), F.lit(MISSING_PARTY))
               .when(M.amount_out_of_range(a), F.concat(F.lit("Amount out of range: "), a)))
    return first.select(
        "row_id", "file", "row_order", "txn_date", "bill_no", "party",
        X.server_key(p).alias("party_key"),
        F.when(t.isNull() | (t == ""), F.lit("Sale")).otherwise(X.title_case(t)).alias("txn_type"),
        F.when(m.isNull() | (m == ""), F.lit("Cash")).otherwise(X.title_case(m)).alias("payment_mode"),
        M.parse_amount(a).alias("amount"),
        M.amount_readable(a).alias("amount_ok"),
        reason.alias("reason"),
    )


def import_transactions(raw: DataFrame, parties: DataFrame, transactions: DataFrame | None = None,
                        iso: str = "ymd", pivot_year: int | None = None,
                        materialize: bool = False) -> ImportResult:
    """Accepted rows, rejects with reasons, created parties, counters.

    A party name whose key (F2) is unknown creates one party of type ``Customer`` with
    credit allowed, named as in its first row; the row is accepted (Q13). Every output
    derives from the cleaned rows; when all of them will be written (as in the stream),
    ``materialize=True`` writes the cleaned rows once below ``spark.checkpoint.dir`` so
    the file is parsed once.
    """
    cleaned = clean_import(raw, iso=iso, pivot_year=pivot_year)
    if materialize:
        cleaned = materialized(cleaned, "import-cleaned")
    ok = cleaned.where(F.col("reason").isNull())
    rejected = cleaned.where(F.col("reason").isNotNull()).select("file", "row_id", "row_order", "reason")
    accepted = ok.select("row_id", "file", "row_order", "txn_date", "bill_no", "party", "party_key", "txn_type", "payment_mode",
                         "amount", "amount_ok")

    # Keys not in parties, each named by its first row. min over a struct is an
    # aggregate (map-side combined), so a key used by a third of the file is one row per task.
    known = parties.select(F.col("normalized_name").alias("party_key"))
    unknown = accepted.join(known, "party_key", "left_anti")
    new_parties = unknown.groupBy("party_key").agg(F.min(F.struct("row_order", "party")).alias("first")).select(
        F.col("first.party").alias("name"), F.col("party_key").alias("normalized_name"),
        F.lit(NEW_PARTY_TYPE).alias("type"), F.lit(True).alias("credit_allowed"),
        F.col("first.row_order").alias("first_row"))
    counts = cleaned.agg(
        F.count(F.when(F.col("reason").isNull(), 1)).alias("success"),
        F.count(F.when(F.col("reason").isNotNull(), 1)).alias("errors"),
    ).select(F.inline(F.array(
        F.struct(F.lit("success").alias("status"), F.col("success").cast("long").alias("n")),
        F.struct(F.lit("error").alias("status"), F.col("errors").cast("long").alias("n")))))
    return ImportResult(accepted, rejected, new_parties, counts, parties, transactions)


def accepted_contract(accepted: DataFrame) -> DataFrame:
    """The ``import_accepted`` columns: date as ISO text, amount as DOUBLE."""
    return accepted.select("row_id", iso_text("txn_date").alias("date"), "bill_no", "party_key",
                           F.col("txn_type").alias("type"), F.col("payment_mode").alias("mode"),
                           M.to_double("amount").alias("amount"))


def as_transactions(accepted: DataFrame) -> DataFrame:
    """Accepted rows in the ``transactions`` schema, ready to append."""
    return accepted.select("txn_id", "txn_date", "bill_no", "party_id", "txn_type", "payment_mode",
                           F.col("amount").cast(MONEY).alias("amount"))


def first_rejects(rejected: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` rejects in file order (a top-k, not a sort of all rejects)."""
    return rejected.orderBy("row_order").limit(n)


# ---- M12: client entry validation -------------------------------------------------------

def validate_entries(entries: DataFrame, parties: DataFrame, strict: bool = True) -> DataFrame:
    """The client's checks on entries (row_id, date, bill_no, party, txn_type, mode, amount).

    Checks in order, first failing reason wins: all fields present; ``Credit`` mode only for
    a party whose known type is ``Credit Customer`` (an unknown party, or one with no type,
    passes); the party must exist by exact name when ``strict``. Otherwise ``reason`` is null
    and ``creates_party`` tells whether the entry would create its party.
    """
    party = X.py_strip(F.col("party"))
    # partyTypes is keyed by name; with duplicate names the reference keeps one of them,
    # here the type of the highest party_id.
    types = parties.groupBy(F.col("name").alias("__name")).agg(
        F.max_by("type", "party_id").alias("__ptype"))
    e = entries.withColumn("__party", party)
    j = e.join(types, e["__party"] == types["__name"], "left")
    known = F.col("__name").isNotNull()
    ptype = F.col("__ptype")

    def empty(c: Column) -> Column:
        return c.isNull() | (c.cast("string") == "")

    required = (empty(F.col("date")) | empty(F.col("amount")) | empty(F.col("txn_type"))
                | empty(F.col("mode")) | empty(F.col("__party")))
    credit_bad = (F.col("mode") == "Credit") & ptype.isNotNull() & (ptype != "") & (ptype != "Credit Customer")
    credit_msg = F.concat(F.lit(NO_CREDIT[0]), F.col("__party"), F.lit(NO_CREDIT[1]), ptype, F.lit(NO_CREDIT[2]))
    missing_msg = F.concat(F.lit(NO_PARTY[0]), F.col("__party"), F.lit(NO_PARTY[1]))
    reason = F.when(required, F.lit(REQUIRED_MSG)).when(credit_bad, credit_msg)
    if strict:
        reason = reason.when(~known, missing_msg)
    return j.select(*entries.columns, reason.alias("reason"),
                    (F.lit(not strict) & ~known & ~required & ~F.coalesce(credit_bad, F.lit(False)))
                    .alias("creates_party"))


def parties_to_create(validated: DataFrame, ptype: str = "Customer") -> DataFrame:
    """M12, non-strict mode: one create request (seq, name, ptype, credit) per unknown party
    name, in the order of its first entry, for ``create_parties``. The credit flag is set
    only for ``Credit Customer``, as the client does; ``ptype`` is what the user would
    answer at the prompt (its default is ``Customer``)."""
    wanted = validated.where(F.col("creates_party"))
    return wanted.groupBy(X.py_strip(F.col("party")).alias("name")).agg(F.min("row_id").alias("seq")).select(
        "seq", "name", F.lit(ptype).alias("ptype"), F.lit(ptype == "Credit Customer").alias("credit"))
