"""Named queries: each takes (spark, sf_dir) and returns a DataFrame over the whole tables.

Parameters fixed by the test fixtures: opening cash seed 50000, as-of date 1998-06-15,
company ``Alpha Traders``, two-digit-year pivot 2076.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import aggregates as A
from ..operators import cash as C
from ..operators import ledgers as L
from ..operators import lists as R
from ..sources.fixtures import AS_OF, OPENING_CASH_SEED
from .tables import Books

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def query(name: str):
    def deco(fn):
        _REGISTRY[name] = fn
        return fn
    return deco


def registry() -> dict[str, Query]:
    return dict(_REGISTRY)


# ---- single-pass aggregates -------------------------------------------------------------

@query("pnl")
def q_pnl(spark, sf_dir):
    b = Books(spark, sf_dir)
    return A.pnl(b.transactions)


@query("trial_balance")
def q_trial_balance(spark, sf_dir):
    b = Books(spark, sf_dir)
    return A.trial_balance(b.transactions, b.parties).orderBy("ord").select("account", "debit", "credit")


@query("dashboard")
def q_dashboard(spark, sf_dir):
    b = Books(spark, sf_dir)
    return A.dashboard(b.transactions, b.parties, AS_OF)


@query("outstanding")
def q_outstanding(spark, sf_dir):
    b = Books(spark, sf_dir)
    return A.outstanding(b.transactions, b.parties)


@query("outstanding_total")
def q_outstanding_total(spark, sf_dir):
    b = Books(spark, sf_dir)
    return A.outstanding_total(b.transactions, b.parties)


@query("daily_mode_summary")
def q_daily_mode_summary(spark, sf_dir):
    return A.daily_mode_summary(Books(spark, sf_dir).transactions)


# ---- cash reconciliation ----------------------------------------------------------------

@query("daily_cash_summary")
def q_daily_cash_summary(spark, sf_dir):
    b = Books(spark, sf_dir)
    return C.daily_cash_summary(b.transactions, b.parties, b.daily_cash, OPENING_CASH_SEED)


@query("short_excess")
def q_short_excess(spark, sf_dir):
    b = Books(spark, sf_dir)
    return C.short_excess(b.transactions, b.parties, b.daily_cash, OPENING_CASH_SEED)


@query("short_excess_monthly")
def q_short_excess_monthly(spark, sf_dir):
    b = Books(spark, sf_dir)
    return C.short_excess_monthly(b.transactions, b.parties, b.daily_cash, OPENING_CASH_SEED)


@query("total_short")
def q_total_short(spark, sf_dir):
    b = Books(spark, sf_dir)
    return C.total_short(b.transactions, b.parties, b.daily_cash, OPENING_CASH_SEED)


@query("cash_month_after_counts")
def q_cash_month_after_counts(spark, sf_dir):
    """R4 of March 1997 after a batch of counts (M6), from the stored months: those that the batch counts are recomputed."""
    from pyspark.sql import functions as F

    from ..operators.carries import month_number
    from ..operators.cash_months import CashMonths
    from ..session import materialized, shared_work_dir

    b = Books(spark, sf_dir)
    months = CashMonths(spark, shared_work_dir(spark, "cash-months"))
    months.create(b.transactions, b.parties, b.daily_cash)
    done = _changes().upsert_cash(b.daily_cash, b.batch("cash_counts"))
    counts = materialized(done.table, "daily-cash")
    changed = done.outcome.where("reason IS NULL").select(month_number(F.col("cash_date")).alias("m")).distinct()
    months.update(b.transactions, b.parties, counts, [r.m for r in changed.collect()])  # one row a month
    return months.summary(b.transactions, b.parties, counts, 1997 * 12 + 2, OPENING_CASH_SEED)


# ---- running balances -------------------------------------------------------------------

@query("party_ledger")
def q_party_ledger(spark, sf_dir):
    b = Books(spark, sf_dir)
    return L.party_ledger(b.transactions, b.parties)


@query("party_ledger_range")
def q_party_ledger_range(spark, sf_dir):
    b = Books(spark, sf_dir)
    return L.party_ledger(b.transactions, b.parties, start="1997-01-01", end="1997-12-31")


@query("ledger_statement")
def q_ledger_statement(spark, sf_dir):
    b = Books(spark, sf_dir)
    return L.ledger_statement(b.transactions, b.parties)


@query("account_cash")
def q_account_cash(spark, sf_dir):
    b = Books(spark, sf_dir)
    return L.account_statement(b.transactions, b.parties, "Cash")


@query("account_bank")
def q_account_bank(spark, sf_dir):
    b = Books(spark, sf_dir)
    return L.account_statement(b.transactions, b.parties, "bank")


@query("account_upi")
def q_account_upi(spark, sf_dir):
    b = Books(spark, sf_dir)
    return L.account_statement(b.transactions, b.parties, "UPI")


# ---- lists ------------------------------------------------------------------------------

@query("type_report_expense")
def q_type_report_expense(spark, sf_dir):
    b = Books(spark, sf_dir)
    return R.type_report(b.transactions, b.parties, "Expense")


@query("type_report_total")
def q_type_report_total(spark, sf_dir):
    b = Books(spark, sf_dir)
    return A.type_report_total(b.transactions, b.parties, "Expense")


@query("day_book")
def q_day_book(spark, sf_dir):
    b = Books(spark, sf_dir)
    return R.day_book(b.transactions, b.parties, AS_OF)


@query("transactions_page")
def q_transactions_page(spark, sf_dir):
    b = Books(spark, sf_dir)
    return R.transactions_page(b.transactions, b.parties, page=3, limit=100)


@query("page_info")
def q_page_info(spark, sf_dir):
    return A.page_info(Books(spark, sf_dir).transactions, page=3, limit=100)


@query("search")
def q_search(spark, sf_dir):
    b = Books(spark, sf_dir)
    return R.search(b.transactions, b.parties, "gpay")


@query("party_list")
def q_party_list(spark, sf_dir):
    return R.party_list(Books(spark, sf_dir).parties)


@query("audit_trail")
def q_audit_trail(spark, sf_dir):
    return R.audit_trail(Books(spark, sf_dir).audit_logs, "default")


# ---- import and entry validation --------------------------------------------------------

def _import(spark, sf_dir, materialize=False):
    from ..operators.importing import import_transactions
    from ..sources.fixtures import PIVOT_YEAR

    b = Books(spark, sf_dir)
    return import_transactions(b.raw_import, b.parties, b.transactions, pivot_year=PIVOT_YEAR, materialize=materialize)


@query("import_accepted")
def q_import_accepted(spark, sf_dir):
    from ..operators.importing import accepted_contract

    return accepted_contract(_import(spark, sf_dir).accepted)


@query("import_rejected")
def q_import_rejected(spark, sf_dir):
    return _import(spark, sf_dir).rejected.select("row_id", "reason")


@query("import_counts")
def q_import_counts(spark, sf_dir):
    return _import(spark, sf_dir).counts


@query("import_new_parties")
def q_import_new_parties(spark, sf_dir):
    return _import(spark, sf_dir).new_parties.drop("first_row")


@query("entry_validation")
def q_entry_validation(spark, sf_dir):
    from ..operators.importing import validate_entries

    b = Books(spark, sf_dir)
    return validate_entries(b.entries, b.parties, strict=True).select("row_id", "reason")


# ---- batch changes ----------------------------------------------------------------------

def _changes():
    from ..operators import changes as CH

    return CH


def _outcome_contract(df: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    from ..functions.dates import iso_text

    out = []
    for name, dtype in df.dtypes:
        if dtype == "date":
            out.append(iso_text(name).alias(name))
        elif dtype.startswith("decimal"):
            out.append(F.col(name).cast("double").alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


@query("add_transactions")
def q_add_transactions(spark, sf_dir):
    b = Books(spark, sf_dir)
    return _outcome_contract(_changes().add_transactions(b.transactions, b.parties, b.batch("adds")).outcome)


@query("create_parties")
def q_create_parties(spark, sf_dir):
    b = Books(spark, sf_dir)
    return _changes().create_parties(b.parties, b.batch("creates")).outcome


def _edit(spark, sf_dir):
    b = Books(spark, sf_dir)
    return _changes().edit_transactions(b.transactions, b.batch("edits"))


@query("edit_transactions")
def q_edit_transactions(spark, sf_dir):
    return _changes().transactions_contract(_edit(spark, sf_dir).table)


@query("edit_audit")
def q_edit_audit(spark, sf_dir):
    return _edit(spark, sf_dir).audit.select("username", "action", "details")


def _delete(spark, sf_dir):
    b = Books(spark, sf_dir)
    return _changes().delete_transactions(b.transactions, b.batch("deletes"))


@query("delete_transactions")
def q_delete_transactions(spark, sf_dir):
    return _changes().transactions_contract(_delete(spark, sf_dir).table)


@query("delete_audit")
def q_delete_audit(spark, sf_dir):
    return _delete(spark, sf_dir).audit.select("username", "action", "details")


@query("rename_parties")
def q_rename_parties(spark, sf_dir):
    b = Books(spark, sf_dir)
    return _changes().rename_parties(b.parties, b.batch("renames")).table.select(
        "party_id", "name", "normalized_name")


@query("upsert_cash")
def q_upsert_cash(spark, sf_dir):
    from pyspark.sql import functions as F

    from ..functions.dates import iso_text

    b = Books(spark, sf_dir)
    t = _changes().upsert_cash(b.daily_cash, b.batch("cash_counts")).table
    return t.select(iso_text("cash_date").alias("key"), F.col("cash_in_hand").cast("double").alias("value"))


def _settings_after_changes(spark, sf_dir):
    b = Books(spark, sf_dir)
    return _changes().upsert_settings(b.app_settings, b.batch("setting_changes"))


@query("upsert_setting")
def q_upsert_setting(spark, sf_dir):
    return _settings_after_changes(spark, sf_dir).selectExpr("setting_key AS key", "setting_value AS value")


@query("seed_if_absent")
def q_seed_if_absent(spark, sf_dir):
    b = Books(spark, sf_dir)
    return _changes().seed_if_absent(b.app_settings, b.batch("setting_seeds"))


@query("setting_value")
def q_setting_value(spark, sf_dir):
    return _changes().setting_value(_settings_after_changes(spark, sf_dir), "opening_cash_seed", 0.0,
                                    alias="opening_cash")


@query("company_list")
def q_company_list(spark, sf_dir):
    b = Books(spark, sf_dir)
    settings = _changes().seed_if_absent(b.app_settings, b.batch("setting_seeds"))
    return _changes().company_list(settings)


@query("audit_append")
def q_audit_append(spark, sf_dir):
    from ..sources.fixtures import COMPANY_NAME

    b = Books(spark, sf_dir)
    CH = _changes()
    from pyspark.sql import functions as F

    from pyspark.sql import Window

    from ..session import materialized

    # The three batches number their requests independently: edits come first, then deletes,
    # then renames, each in its own request order. One number for (batch, seq): batches are offset by
    # the largest request number of those before, which one row a batch tells.
    audits = [CH.edit_transactions(b.transactions, b.batch("edits")).audit,
              CH.delete_transactions(b.transactions, b.batch("deletes")).audit,
              CH.rename_parties(b.parties, b.batch("renames")).audit]
    rows = None
    for k, audit in enumerate(audits):
        part = audit.withColumn("batch", F.lit(k))
        rows = part if rows is None else rows.unionByName(part)
    rows = materialized(rows, "audit-rows")
    spans = rows.groupBy("batch").agg((F.max("seq") + 1).alias("span"))  # three rows
    before = spans.select("batch", F.coalesce(F.sum("span").over(
        Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    rows = rows.join(before, "batch").withColumn("seq", F.col("seq") + F.col("offset")).drop("batch", "offset")
    log = CH.audit_append(b.audit_logs, rows, company=COMPANY_NAME)
    return log.select("username", "action", "details", "company")


@query("audit_backfill")
def q_audit_backfill(spark, sf_dir):
    from ..sources.fixtures import COMPANY_NAME

    log = _changes().backfill_company(Books(spark, sf_dir).audit_logs, COMPANY_NAME)
    return log.groupBy("company").count().withColumnRenamed("count", "n")


# ---- scalar functions over whole columns ------------------------------------------------

@query("normalise_keys")
def q_normalise_keys(spark, sf_dir):
    from pyspark.sql import functions as F

    from ..functions import text as X

    b = Books(spark, sf_dir)
    names = b.parties.select("name").unionByName(
        b.raw_import.select(F.col("Customer Name").alias("name"))).where(F.col("name").isNotNull())
    return names.select("name", X.company_key("name").alias("company_key"),
                        X.server_key("name").alias("server_key"), X.client_key("name").alias("client_key"))


@query("normalise_modes")
def q_normalise_modes(spark, sf_dir):
    from pyspark.sql import functions as F

    from ..functions import text as X

    tx = Books(spark, sf_dir).transactions
    g = tx.groupBy("txn_type", "payment_mode").agg(F.count(F.lit(1)).alias("n"))
    m = X.mode_norm("payment_mode")
    return g.select("txn_type", "payment_mode", X.type_norm("txn_type").alias("type_norm"), m.alias("mode_norm"),
                    X.is_bank_norm(m).alias("is_bank_group"), "n")


@query("title_case")
def q_title_case(spark, sf_dir):
    from pyspark.sql import functions as F

    from ..functions import text as X

    r = Books(spark, sf_dir).raw_import
    raw = (r.select(F.col("Type").alias("raw")).unionByName(r.select(F.col("Payment Mode").alias("raw")))
           .unionByName(r.select(F.col("Customer Name").alias("raw"))).where(F.col("raw").isNotNull()).distinct())
    return raw.select("raw", X.title_case("raw").alias("title"))


@query("next_bill")
def q_next_bill(spark, sf_dir):
    from ..functions import text as X

    tx = Books(spark, sf_dir).transactions
    return tx.select("bill_no", X.next_bill_number("bill_no").alias("next_bill_no"))


@query("display_formats")
def q_display_formats(spark, sf_dir):
    from pyspark.sql import functions as F

    from ..functions import dates as D
    from ..functions import money as M
    from ..functions import text as X
    from ..operators.lists import joined_list

    b = Books(spark, sf_dir)
    rows = joined_list(b.transactions, b.parties)
    return rows.select("id", D.date_text("date").alias("date_text"), D.month_key("date").alias("month"),
                       M.indian_money("amount").alias("money_text"), M.fixed2("amount").alias("fixed_text"),
                       M.balance_label("amount").alias("label"), X.sheet_name("party").alias("sheet_name"),
                       D.stamp_text(F.col("date").cast("timestamp")).alias("stamp"))


# ---- sinks, snapshots and the streaming import ------------------------------------------

BOOK_TABLES = ["parties", "transactions", "daily_cash", "audit_logs", "app_settings"]


def _checksum(df):
    """(rows, checksum): the sum over rows of 32 bits of the md5 of all columns as text."""
    from pyspark.sql import functions as F

    cells = [F.unix_micros(F.col(c).cast("timestamp")) if t.startswith("timestamp") else F.col(c) for c, t in df.dtypes]
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("~")) for c in cells])
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.sum(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")).alias("checksum"))


@query("snapshot_roundtrip")
def q_snapshot_roundtrip(spark, sf_dir):
    """S7 + S8: snapshot the books, snapshot them again after the cash counts have changed, restore the second to a new place (most
    of it from the first), count and sum up what came back."""
    import datetime as dt
    from functools import reduce

    from pyspark.sql import functions as F

    from ..session import shared_work_dir
    from ..sources import io

    b = Books(spark, sf_dir)
    work = shared_work_dir(spark, "snapshot")
    taken = {t: getattr(b, t) for t in BOOK_TABLES}
    changed = taken | {"daily_cash": taken["daily_cash"].where(F.dayofmonth("cash_date") > 9)}
    io.snapshot(changed, f"{work}/backups", "books", prefix="auto_", when=dt.datetime(2026, 1, 1))
    folder = io.snapshot(taken, f"{work}/backups", "books", prefix="auto_", when=dt.datetime(2026, 1, 2))
    restored = io.restore(spark, folder, BOOK_TABLES, f"{work}/current")
    sums = [_checksum(restored[t].select(*taken[t].columns)).select(F.lit(t).alias("table"), "rows", "checksum") for t in BOOK_TABLES]
    return reduce(lambda a, c: a.unionByName(c), sums)


@query("export_csv_roundtrip")
def q_export_csv_roundtrip(spark, sf_dir):
    """Export every party's transactions as CSV, a sheet a party, and read the rows back."""
    from pyspark.sql import functions as F

    from ..session import shared_work_dir
    from ..sources import io

    b = Books(spark, sf_dir)
    path = shared_work_dir(spark, "export")
    report = b.transactions.join(b.parties.select("party_id", F.col("name").alias("party")), "party_id").select(
        "party_id", F.col("txn_id").alias("id"), F.col("txn_date").cast("string").alias("date"), "bill_no", "party", "amount")
    io.export_report_csv(report, path, sheet_col="party", key_col="party_id", order_by=["date", "id"])
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return back.select("sheet", F.col("party_id").cast("long"), F.col("id").cast("long"), "date", "bill_no", "party",
                       F.col("amount").cast("double"))


#: Records of a dropped import file at most.
IMPORT_FILE_ROWS = 1_000_000


def _layouts(raw):
    """Two layouts of the import file: names and order of columns differ."""
    from pyspark.sql import functions as F

    other = [F.col("Amount").alias("amount"), F.col("Customer Name").alias("Party"), F.col("Date").alias("txn_date"),
             F.col("Type").alias("Transaction Type"), F.col("Payment Mode").alias("Mode"), F.col("Bill No").alias("bill_no")]
    return [c for c in raw.columns if c not in ("part", "row_id")], other


def _drop_csv(rows, path, *by):
    """Writes ``rows`` as CSV files, ranges of (``by``, row_id) in order, as many as the rows need."""
    out = rows.write.option("header", True).option("escape", '"').option("maxRecordsPerFile", IMPORT_FILE_ROWS)
    (out.partitionBy(*by) if by else out).csv(path)


def _drop_import_files(raw, path):
    """Writes ``raw`` (with ``part`` and ``row_id``) as CSV files below ``path``, two layouts of two parts; the folders of the parts.
    Names ascend with row_id inside a part."""
    from pyspark.sql import functions as F

    for k, cols in enumerate(_layouts(raw)):
        rows = raw.where(F.col("part") % 2 == k).repartitionByRange("part", "row_id").sortWithinPartitions("part", "row_id")
        _drop_csv(rows.select(*cols, "part"), f"{path}/layout{k}", "part")
    return [f"{path}/layout{p % 2}/part={p}" for p in range(4)]


@query("import_csv_roundtrip")
def q_import_csv_roundtrip(spark, sf_dir):
    """S2 + S9: the import file dropped as CSV files of two layouts (names and order of columns differ),
    read back by name, imported; part and record in the part's files of every row, accepted or not."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from ..functions.dates import iso_text
    from ..operators.importing import clean_import
    from ..session import shared_work_dir
    from ..sources import io
    from ..sources.fixtures import PIVOT_YEAR

    path = shared_work_dir(spark, "drop")
    raw = Books(spark, sf_dir).raw_import.withColumn("part", F.col("row_id") % 4)
    files = _drop_import_files(raw, path)
    clean = clean_import(io.read_import_records(spark, files), pivot_year=PIVOT_YEAR).withColumn("part", F.regexp_extract("file", "part=([0-9])", 1))
    # A part's files follow one another; its records are numbered on through them (the header is 1).
    sizes = clean.groupBy("part", "file").agg((F.max("row_id") - 1).alias("n"))
    before = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    clean = clean.join(sizes, "file").withColumn("row_id", F.col("row_id") + F.col("before"))
    return clean.select("part", "row_id", iso_text("txn_date").alias("date"), "party",
                        F.col("txn_type").alias("type"), F.col("amount").cast("double").alias("amount"), "reason")


@query("import_appended")
def q_import_appended(spark, sf_dir):
    """M11 to its end: the accepted rows as they are appended, with the ids of their parties and their own."""
    from ..functions.dates import iso_text
    from ..operators.importing import as_transactions

    from pyspark.sql import functions as F

    _, accepted = _import(spark, sf_dir, materialize=True).with_ids()
    rows = as_transactions(accepted)
    return rows.select("txn_id", "party_id", iso_text("txn_date").alias("date"), "bill_no", F.col("amount").cast("double").alias("amount"))


@query("cash_audit")
def q_cash_audit(spark, sf_dir):
    """M6: the audit rows of the cash counts, amounts as a float prints."""
    b = Books(spark, sf_dir)
    return _changes().upsert_cash(b.daily_cash, b.batch("cash_counts")).audit.select("username", "action", "details")


@query("stream_import")
def q_stream_import(spark, sf_dir):
    """The import file dropped as CSV files of two layouts in three goes, each imported by a restart of the stream. The last go
    also drops a file of the first again under another name, which is not imported twice."""
    from pyspark.sql import functions as F

    from ..operators.importing import accepted_contract
    from ..session import copy_file, shared_work_dir
    from ..sources.fixtures import PIVOT_YEAR
    from ..sources.import_files import list_files
    from ..streaming.stream_import import read_accepted, start_stream_import

    b = Books(spark, sf_dir)
    work = shared_work_dir(spark, "stream")
    one, other = _layouts(b.raw_import)
    for go, cols in enumerate((one, other, one)):
        rows = b.raw_import.where(F.col("row_id") % 3 == go).repartitionByRange("row_id").sortWithinPartitions("row_id")
        _drop_csv(rows.select(*cols, "row_id"), f"{work}/drop/go-{go}")
        if go == 2:
            copy_file(spark, list_files([f"{work}/drop/go-0"])[0][0], f"{work}/drop/again.csv")
        start_stream_import(spark, f"{work}/drop", b.parties, b.transactions, f"{work}/out", f"{work}/checkpoint", pivot_year=PIVOT_YEAR)
    return accepted_contract(read_accepted(spark, f"{work}/out"))


# ---- totals kept by deltas --------------------------------------------------------------

def _kept_totals(spark, sf_dir):
    """Totals of the table, then four batches (edits, deletes, adds, an import) of which only the changes are read, and one
    compaction on the way."""
    from ..operators.importing import as_transactions
    from ..operators.totals import StoredTotals, signed
    from ..session import shared_work_dir

    b = Books(spark, sf_dir)
    CH = _changes()
    kept = StoredTotals(spark, shared_work_dir(spark, "totals"))
    kept.create(b.transactions)
    edited = CH.edit_transactions(b.transactions, b.batch("edits"))
    kept.apply(1, edited.delta)
    kept.apply(2, CH.delete_transactions(edited.table, b.batch("deletes")).delta)
    kept.compact()
    kept.apply(3, CH.add_transactions(b.transactions, b.parties, b.batch("adds")).delta)
    _, accepted = _import(spark, sf_dir, materialize=True).with_ids()
    kept.apply(4, signed(as_transactions(accepted), 1))
    return b, kept


@query("totals_by_deltas")
def q_totals_by_deltas(spark, sf_dir):
    """A6, A9, A11, A12 kept: the stored groups after four batches."""
    from pyspark.sql import functions as F

    from ..functions.dates import iso_text

    _, kept = _kept_totals(spark, sf_dir)
    return kept.totals().select("party_id", iso_text("txn_date").alias("date"), F.col("txn_type").alias("type"),
                                F.col("payment_mode").alias("mode"), "n", F.col("amount").cast("double").alias("amount"))


@query("reports_from_totals")
def q_reports_from_totals(spark, sf_dir):
    """P&L, trial balance, dashboard and outstanding of the books after the batches, from the stored totals alone."""
    from pyspark.sql import functions as F

    b, kept = _kept_totals(spark, sf_dir)
    rows = kept.rows()
    tall = lambda df, name: df.select(F.lit(name).alias("report"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("item"), F.col(c).alias("value")) for c in df.columns])))
    balance = A.trial_balance(rows, b.parties)
    out = tall(A.pnl(rows), "pnl").unionByName(tall(A.dashboard(rows, b.parties, AS_OF), "dashboard"))
    out = out.unionByName(tall(A.outstanding_total(rows, b.parties), "outstanding"))
    return out.unionByName(balance.select(F.lit("trial balance").alias("report"), F.col("account").alias("item"),
                                          (F.col("debit") - F.col("credit")).alias("value")))


# ---- changes that rewrite what they touch -------------------------------------------------

@query("changes_by_bucket")
def q_changes_by_bucket(spark, sf_dir):
    """M3, M4, M1 on a table in buckets of ids: each batch rewrites the buckets it touches; the table after all three."""
    from ..session import shared_work_dir
    from ..sources.buckets import BucketedTransactions

    b = Books(spark, sf_dir)
    table = BucketedTransactions(spark, shared_work_dir(spark, "bucketed"))
    table.create(b.transactions)
    table.edit(b.batch("edits"))
    table.delete(b.batch("deletes"))
    return _changes().transactions_contract(table.add(b.parties, b.batch("adds")).table)


# ---- statements with the balance brought forward -----------------------------------------

def _forward(spark, sf_dir, account: bool):
    """Openings of the books, repaired by a batch of deletes, and a quarter's statement of the rows as a layout by day."""
    from pyspark.sql import functions as F

    from ..operators import carries as Y
    from ..session import shared_work_dir
    from ..sources import io

    b = Books(spark, sf_dir)
    known = b.parties.select("party_id")
    own = (lambda df: Y.accounts_of(df.join(known, "party_id", "left_semi"))) if account else (lambda df: df.join(known, "party_id", "left_semi"))
    key, value = ("account", Y.account_value) if account else ("party_id", Y.party_value)
    work = shared_work_dir(spark, "forward")
    deleted = _changes().delete_transactions(b.transactions, b.batch("deletes"))
    io.write_transactions_layout(deleted.table, f"{work}/transactions")
    openings = Y.MonthOpenings(spark, f"{work}/openings", [key], value)
    openings.create(own(b.transactions))
    openings.apply(own(deleted.delta))
    rows = own(spark.read.parquet(f"{work}/transactions"))
    return Y.statement_contract(openings.statement(rows, "1997-02-10", "1997-04-20"), key)


@query("party_statement_forward")
def q_party_statement_forward(spark, sf_dir):
    """W1 for a date range, opening with the balance brought forward, from stored month openings."""
    return _forward(spark, sf_dir, account=False)


@query("account_statement_forward")
def q_account_statement_forward(spark, sf_dir):
    """W3 for a date range of all accounts, opening with the balance brought forward."""
    return _forward(spark, sf_dir, account=True)


@query("transactions_page_after")
def q_transactions_page_after(spark, sf_dir):
    """O4, keyset form: the 100 rows after (1997-01-01, id 7000), a place inside that day, in (date desc, id desc) order."""
    b = Books(spark, sf_dir)
    return R.transactions_page_after(b.transactions, b.parties, "1997-01-01", 7000, limit=100)


@query("transactions_page_direct")
def q_transactions_page_direct(spark, sf_dir):
    """O4 by the order-statistics index: page 3 of 100 rows and the last page, each read from the ranges that have it."""
    from pyspark.sql import functions as F

    from ..operators.paging import PageIndex
    from ..session import shared_work_dir

    b = Books(spark, sf_dir)
    index = PageIndex(spark, shared_work_dir(spark, "pages"))
    index.build(b.transactions, b.parties)
    last = index.info(1, 100)[3]
    pages = [index.page(n, 100).withColumn("page", F.lit(name)) for n, name in ((3, "third"), (last, "last"))]
    return pages[0].unionByName(pages[1])


@query("search_indexed")
def q_search_indexed(spark, sf_dir):
    """P13 by the trigram index: a common text, a rare one, and one too short for it (which scans)."""
    from pyspark.sql import functions as F

    from ..operators.search_index import SearchIndex
    from ..session import shared_work_dir

    b = Books(spark, sf_dir)
    index = SearchIndex(spark, shared_work_dir(spark, "search"))
    index.build(b.transactions, b.parties)
    found = None
    for text in ("gpay", "inv-1234", "99"):
        rows = index.search(text).withColumn("searched", F.lit(text))
        found = rows if found is None else found.unionByName(rows)
    return found


@query("import_first_rejects")
def q_import_first_rejects(spark, sf_dir):
    """The first 20 rejects of the import in file order (the limit is the report)."""
    from ..operators.importing import first_rejects

    return first_rejects(_import(spark, sf_dir).rejected, 20).select("row_id", "reason")


@query("set_opening_cash")
def q_set_opening_cash(spark, sf_dir):
    """M7 via opening-cash requests: one audit row per valid request, in request order."""
    b = Books(spark, sf_dir)
    res = _changes().set_opening_cash(b.app_settings, b.batch("opening_cash_requests"))
    return res.audit.select("username", "action", "details")
