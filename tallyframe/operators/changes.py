"""Batch changes (M1-M10): the reference changes one row per request; a Spark user applies a
whole batch and gets the new table, the rejects with reasons, and the audit rows.

Every operator is a pure function of DataFrames. Nothing is updated in place: the new
table is a new DataFrame (write it to a new location, S4/S8). Batches carry ``seq`` to fix
the order the reference would have seen the requests in; "last wins" is an aggregate
(``max_by``) so a key that holds a third of a batch is combined map-side, and ordered
windows run only over per-block summaries or inside blocks of bounded size
(see ``running.py``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.money import py_float_text
from ..functions.dates import iso_text
from ..session import materialized
from ..sources.schemas import MONEY, TRANSACTIONS
from .running import HOT_ROWS, dense_number, number_where, previous_value
from .totals import KEYS as TOTAL_KEYS
from .totals import signed


# Fixed values that must equal the reference's: why a request is rejected.
BANK_MSG = "Only one Bank account is allowed."
DUP_PARTY_MSG = "Party already exists"
PARTY_NOT_FOUND = "Party not found"
INVALID_FIELD = "Invalid field"
NOT_FOUND = "Transaction not found"
EMPTY_VALUE = "Enter a value"
NEW_NAME_TAKEN = "New name already exists"
NO_CASH = "Enter valid Cash In Hand"
NO_OPENING_CASH = "Enter valid opening cash"
# Fixed values of the audit log: the names of actions.
EDIT_ACTION, DELETE_ACTION, RENAME_ACTION = "Edit Transaction", "Delete Transaction", "Rename Party"
CASH_ACTION, OPENING_ACTION = "Set Cash In Hand", "Set Opening Cash"


@dataclass
class ChangeResult:
    table: DataFrame          # the table after the batch
    outcome: DataFrame        # every request with ``reason`` (null when applied)
    audit: DataFrame | None   # username, action, details (one row per applied request)
    delta: DataFrame | None = None   # M1, M3, M4: the signed rows by which the batch changes stored totals (``totals.py``)


def _scalar_max(df: DataFrame, col: str) -> Column:
    return df.select(F.coalesce(F.max(col), F.lit(0)).cast("long")).scalar()


# ---- M1: add transactions ---------------------------------------------------------------

def add_transactions(tx: DataFrame, parties: DataFrame, adds: DataFrame) -> ChangeResult:
    """M1: adds (seq, date, bill_no, party, txn_type, mode, amount). The checked batch is written
    once below ``spark.checkpoint.dir`` when called.

    The party is looked up by its server key (F2); an unknown or missing party is rejected
    with "Party not found". Accepted rows get the next ids in ``seq`` order (W6).
    """
    keys = parties.select(F.col("normalized_name").alias("__key"), F.col("party_id").alias("__pid"))
    a = adds.withColumn("__key", X.server_key("party"))
    j = a.join(keys, "__key", "left")
    when = F.col("date").cast("string").try_cast("date")
    amount = F.col("amount").cast("string").try_cast(MONEY)
    reason = (F.when(F.col("__pid").isNull(), F.lit(PARTY_NOT_FOUND))
               .when(when.isNull(), F.lit("Invalid date"))
               .when(amount.isNull(), F.lit("Invalid amount")))
    checked = j.select("seq", when.alias("txn_date"), "bill_no", F.col("__pid").alias("party_id"),
                       "txn_type", F.col("mode").alias("payment_mode"), amount.alias("amount"),
                       reason.alias("reason"))
    checked = materialized(checked, "adds-checked")  # read by every branch of the numbering
    outcome = number_where(checked, F.col("reason").isNull(), "seq", "txn_id", start=_scalar_max(tx, "txn_id"))
    outcome = outcome.select("seq", "txn_id", "txn_date", "bill_no", "party_id", "txn_type", "payment_mode",
                             "amount", "reason")
    new_rows = outcome.where(F.col("reason").isNull()).select(*[f.name for f in TRANSACTIONS.fields])
    table = tx.unionByName(new_rows)
    return ChangeResult(table, outcome, None, signed(new_rows, 1))


# ---- M2: create parties -----------------------------------------------------------------

def create_parties(parties: DataFrame, creates: DataFrame) -> ChangeResult:
    """M2: creates (seq, name, ptype, credit) applied in ``seq`` order.

    A create of type ``Bank`` is rejected once any bank exists (one in the table, or one
    created earlier in the batch); a name whose key (F2) exists, or was created earlier in
    the batch, is rejected. The sequential outcome is computed in closed form: the first
    bank created in the batch is the first ``bank``-typed create that is the first of its
    key; ``Bank`` creates after it (or all of them, when the table has a bank) are
    rejected; of the rest, the first create of each new key wins. The checked batch is written
    once below ``spark.checkpoint.dir`` when called.
    """
    c = creates.withColumn("__key", X.server_key("name"))
    existing = parties.select(F.col("normalized_name").alias("__key")).distinct() \
        .withColumn("__exists", F.lit(True))
    c = c.join(existing, "__key", "left").withColumn("__exists", F.coalesce("__exists", F.lit(False)))
    # Scalar subqueries (Spark 4 ``DataFrame.scalar``).
    bank_in_table = parties.select(F.max(F.coalesce(X.ci_eq("type", "Bank"), F.lit(False)))).scalar()
    # One aggregate per key: its first create, and its first non-Bank and first Bank create,
    # from which the first create that the bank rule lets through follows below.
    is_bank = F.coalesce(F.col("ptype") == "Bank", F.lit(False))
    first_seq = c.groupBy("__key").agg(
        F.min("seq").alias("__first_any"),
        F.min(F.when(~is_bank, F.col("seq"))).alias("__first_other"),
        F.min(F.when(is_bank, F.col("seq"))).alias("__first_bank_create"))
    c = c.join(first_seq, "__key", "left")
    first_bank = c.where(X.ci_eq("ptype", "Bank") & (F.col("seq") == F.col("__first_any"))
                         & ~F.col("__exists") & F.col("name").isNotNull()) \
                  .select(F.min("seq")).scalar()
    # Both scalars are projected once, so each subquery runs once per read of the batch.
    c = c.withColumn("__bank_in_table", F.coalesce(bank_in_table, F.lit(False))) \
         .withColumn("__first_bank", first_bank)
    in_table, fb = F.col("__bank_in_table"), F.col("__first_bank")
    # A Bank create is blocked when the table has a bank or it comes after the first bank.
    bank_open = ~in_table & (fb.isNull() | (F.col("seq") <= fb))
    c = c.withColumn("__bank_blocked", is_bank & ~bank_open)
    # Bank creates of a key are seq-ordered, so its first one passes iff any of them does.
    key_bank_open = ~in_table & (fb.isNull() | (F.col("__first_bank_create") <= fb))
    c = c.withColumn("__first_ok", F.least(
        F.col("__first_other"), F.when(key_bank_open, F.col("__first_bank_create"))))
    reason = (F.when(F.col("name").isNull(), F.lit("Missing name"))
               .when(F.col("__bank_blocked"), F.lit(BANK_MSG))
               .when(F.col("__exists") | (F.col("seq") != F.col("__first_ok")), F.lit(DUP_PARTY_MSG)))
    checked = materialized(c.withColumn("reason", reason).select("seq", "name", "__key", "ptype", "credit", "reason"),
                           "creates-checked")  # read by every branch of the numbering
    numbered = number_where(checked, F.col("reason").isNull(), "seq", "party_id",
                            start=_scalar_max(parties, "party_id"))
    outcome = numbered.select("seq", "party_id", "name", F.col("__key").alias("normalized_name"),
                              F.col("ptype").alias("type"), F.col("credit").cast("boolean").alias("credit_allowed"),
                              "reason")
    table = parties.unionByName(outcome.where(F.col("reason").isNull()).select(
        "party_id", "name", "normalized_name", "type", "credit_allowed"))
    return ChangeResult(table, outcome, None)


# ---- M3: edit transactions --------------------------------------------------------------

def _typed(field: str, text: Column) -> Column:
    if field == "txn_date":
        return text.try_cast("date")
    if field == "amount":
        return text.try_cast(MONEY)
    return text


def edit_transactions(tx: DataFrame, edits: DataFrame, hot_rows: int = HOT_ROWS, parts: int | None = None) -> ChangeResult:
    """M3: edits (seq, txn_id, admin_user, field, new_value).

    A field outside the white list, an unknown id, an empty value or a value that does not
    read as the field's type is rejected. For each (txn_id, field) the last edit by ``seq``
    wins; each applied edit is audited with the value it replaced, which is the previous
    applied edit's value or the table's value (``None`` when null). The checked batch is written once
    below ``spark.checkpoint.dir`` when called.
    """
    # One join with the table both validates the id and brings the current values as text
    # (for the audit's "from" part).
    ids = tx.select(F.col("txn_id").alias("__tid"), F.lit(True).alias("__found"),
                    *[X.py_str(F.col(f)).alias(f"__old_{f}") for f in X.EDITABLE_FIELDS])
    e = edits.join(ids, edits["txn_id"] == ids["__tid"], "left").drop("__tid")
    castable = F.lit(True)
    for f in X.EDITABLE_FIELDS:
        if f in ("txn_date", "amount"):
            castable = F.when(F.col("field") == f, _typed(f, F.col("new_value")).isNotNull()).otherwise(castable)
    reason = (F.when(~F.col("field").isin(X.EDITABLE_FIELDS) | F.col("field").isNull(), F.lit(INVALID_FIELD))
               .when(F.col("__found").isNull(), F.lit(NOT_FOUND))
               .when(F.col("new_value").isNull() | (F.col("new_value") == ""), F.lit(EMPTY_VALUE))
               .when(~castable, F.concat(F.lit("Invalid value for "), F.col("field"))))
    table_text = None
    for f in X.EDITABLE_FIELDS:
        table_text = (F.when(F.col("field") == f, F.col(f"__old_{f}")) if table_text is None
                      else table_text.when(F.col("field") == f, F.col(f"__old_{f}")))
    checked = e.withColumn("reason", reason).withColumn("__table_text", table_text).drop(
        "__found", *[f"__old_{f}" for f in X.EDITABLE_FIELDS])
    checked = materialized(checked, "edits-checked")
    ok = checked.where(F.col("reason").isNull())

    # The next edit replaces what this one stored, so carry the stored value's text.
    stored = F.col("new_value")
    for f in ("txn_date", "amount"):
        stored = F.when(F.col("field") == f, X.py_str(_typed(f, F.col("new_value")))).otherwise(stored)
    prev = previous_value(ok.withColumn("__stored", stored), ["txn_id", "field"], "seq", "__stored", "__prev", hot_rows, parts)
    audit = prev.select(
        "seq", F.col("admin_user").alias("username"), F.lit(EDIT_ACTION).alias("action"),
        F.concat(F.lit("Changed "), F.col("field"), F.lit(" from "),
                 F.coalesce(F.col("__prev"), F.col("__table_text")), F.lit(" to "), F.col("new_value"),
                 F.lit(" for Txn ID "), F.col("txn_id").cast("string")).alias("details"))
    checked = checked.drop("__table_text")

    last = ok.groupBy("txn_id").pivot("field", X.EDITABLE_FIELDS).agg(F.max_by("new_value", "seq"))
    last = last.select("txn_id", *[F.col(f).alias(f"__new_{f}") for f in X.EDITABLE_FIELDS])
    t = tx.join(last, "txn_id", "left")
    table = t.select("txn_id", *[
        F.when(F.col(f"__new_{f}").isNotNull(), _typed(f, F.col(f"__new_{f}"))).otherwise(F.col(f))
        .cast(TRANSACTIONS[f].dataType).alias(f) if f in X.EDITABLE_FIELDS else F.col(f)
        for f in [fl.name for fl in TRANSACTIONS.fields if fl.name != "txn_id"]])
    # What the edited rows were and what they are: written once, as the rows are found in the table by their ids.
    old = tx.join(last, "txn_id")
    both = old.select(*TOTAL_KEYS, "amount", *[F.col(f"__new_{f}") for f in X.EDITABLE_FIELDS])
    new = both.select(*[F.coalesce(_typed(f, F.col(f"__new_{f}")), F.col(f)).cast(TRANSACTIONS[f].dataType).alias(f)
                        if f in X.EDITABLE_FIELDS else F.col(f) for f in [*TOTAL_KEYS, "amount"]])
    return ChangeResult(table, checked, audit, signed(both, -1).unionByName(signed(new, 1)))


# ---- M4: delete transactions ------------------------------------------------------------

def delete_transactions(tx: DataFrame, deletes: DataFrame) -> ChangeResult:
    """M4: deletes (seq, txn_id, admin_user). An unknown id, or one already deleted by an
    earlier request of the batch, is rejected; the audit keeps date, bill and amount."""
    first = deletes.groupBy("txn_id").agg(F.min("seq").alias("__first"))
    d = deletes.join(first, "txn_id")
    found = tx.select(*[f.name for f in TRANSACTIONS.fields], F.lit(True).alias("__exists"))
    j = d.join(found, "txn_id", "left")
    reason = F.when(F.col("__exists").isNull() | (F.col("seq") != F.col("__first")), F.lit(NOT_FOUND))
    checked = j.withColumn("reason", reason)
    ok = checked.where(F.col("reason").isNull())
    table = tx.join(ok.select("txn_id"), "txn_id", "left_anti")
    audit = ok.select(
        "seq", F.col("admin_user").alias("username"), F.lit(DELETE_ACTION).alias("action"),
        F.concat(F.lit("Deleted Txn ID "), F.col("txn_id").cast("string"), F.lit(". Date: "),
                 X.py_str("txn_date"), F.lit(", Bill: "), X.py_str("bill_no"), F.lit(", Amount: "),
                 X.py_str("amount")).alias("details"))
    return ChangeResult(table, checked.select("seq", "txn_id", "admin_user", "reason"), audit, signed(ok, -1))


# ---- M5: rename parties -----------------------------------------------------------------

def _first_wins(requests: DataFrame) -> DataFrame:
    """The requests (seq, pid, key) that apply in ``seq`` order when one applies only if neither
    its party nor its new key is taken by an applied one before it.

    In rounds: a request that is the first left of both its party and its key applies, and all
    others of that party or key leave. The first request left always applies, so it ends; unless
    requests hang together in long chains a few rounds do. Each round is written below
    ``spark.checkpoint.dir`` (it is read three times), and only aggregates and joins by
    key run, so a party or key with a third of the batch combines map-side.
    """
    # Repeats of one (party, key) pair after its first can never apply.
    left = materialized(requests.groupBy("pid", "key").agg(F.min("seq").alias("seq")), "rename-requests")
    won = None
    while left.limit(1).count():
        of_party = left.groupBy("pid").agg(F.min("seq").alias("__p"))
        of_key = left.groupBy("key").agg(F.min("seq").alias("__k"))
        marked = left.join(of_party, "pid").join(of_key, "key")
        now = materialized(marked.where((F.col("seq") == F.col("__p")) & (F.col("seq") == F.col("__k")))
                           .select("seq", "pid", "key"), "rename-round")
        won = now if won is None else won.unionByName(now)
        left = materialized(left.join(now.select("pid"), "pid", "left_anti").join(now.select("key"), "key", "left_anti"),
                            "rename-left")
    return left.select("seq", "pid", "key") if won is None else won


def rename_parties(parties: DataFrame, renames: DataFrame) -> ChangeResult:
    """M5: renames (seq, old_name, new_name, admin_user), checked against the table before
    the batch. The old name is found by its key (F2); the new key must not belong to another
    party. Requests apply in ``seq`` order: one whose party an applied request has renamed
    finds no party, one whose new key an applied request has given is taken; requests that
    are themselves rejected count for neither. History follows the party through
    ``party_id``. Runs jobs when called (see ``_first_wins``)."""
    keys = parties.select(F.col("normalized_name").alias("__old_key"), F.col("party_id").alias("__pid"))
    r = renames.withColumn("__old_key", X.server_key("old_name")).withColumn("__new_key", X.server_key("new_name"))
    r = r.join(keys, "__old_key", "left")
    owners = parties.select(F.col("normalized_name").alias("__new_key"), F.col("party_id").alias("__owner"))
    r = r.join(owners, "__new_key", "left")
    other_owner = F.col("__owner").isNotNull() & (F.col("__owner") != F.col("__pid"))
    possible = r.where(F.col("__pid").isNotNull() & F.col("__new_key").isNotNull() & ~other_owner)
    won = _first_wins(possible.select("seq", F.col("__pid").alias("pid"), F.col("__new_key").alias("key")))
    by_party = won.select(F.col("pid").alias("__pid"), F.col("seq").alias("__won_party"))
    by_key = won.select(F.col("key").alias("__new_key"), F.col("seq").alias("__won_key"))
    r = r.join(by_party, "__pid", "left").join(by_key, "__new_key", "left")
    reason = (F.when(F.col("__pid").isNull() | (F.col("__won_party") < F.col("seq")), F.lit(PARTY_NOT_FOUND))
               .when(other_owner | F.col("__new_key").isNull() | (F.col("__won_key") < F.col("seq")), F.lit(NEW_NAME_TAKEN)))
    checked = r.withColumn("reason", reason)
    ok = checked.where(F.col("reason").isNull()).select(
        F.col("__pid").alias("party_id"), F.col("new_name").alias("__new_name"), "__new_key")
    t = parties.join(ok, "party_id", "left")
    table = t.select("party_id", F.coalesce("__new_name", "name").alias("name"),
                     F.coalesce("__new_key", "normalized_name").alias("normalized_name"), "type", "credit_allowed")
    audit = checked.where(F.col("reason").isNull()).select(
        "seq", F.col("admin_user").alias("username"), F.lit(RENAME_ACTION).alias("action"),
        F.concat(F.lit("Renamed "), F.col("old_name"), F.lit(" to "), F.col("new_name")).alias("details"))
    outcome = checked.select("seq", "old_name", "new_name", F.col("__pid").alias("party_id"), "reason")
    return ChangeResult(table, outcome, audit)


# ---- M6 / M7 / M9: upserts and insert-if-absent -----------------------------------------

def upsert_latest(table: DataFrame, changes: DataFrame, key: str, value: str) -> DataFrame:
    """M6 / M7: the last change per key (by ``seq``) replaces or adds that key's value.
    ``max_by`` is an aggregate, so a key with a third of the changes combines map-side."""
    latest = changes.groupBy(key).agg(F.max_by(F.struct(F.col(value)), "seq").alias("__new"))
    j = table.join(latest, key, "full_outer")
    # The struct tells a change to null from no change.
    return j.select(key, F.when(F.col("__new").isNotNull(), F.col(f"__new.{value}")).otherwise(F.col(value)).alias(value))


def upsert_cash(daily_cash: DataFrame, counts: DataFrame, now: Column | None = None) -> ChangeResult:
    """M6: cash counts (seq, date, cash_in_hand, admin_user); an unreadable count is rejected. A table with ``updated_at`` has
    ``now`` (the current time, if not given) on the days that the batch counts."""
    c = counts.select("seq", F.col("date").cast("string").try_cast("date").alias("cash_date"),
                      F.col("cash_in_hand").cast("string").try_cast(MONEY).alias("cash_in_hand"),
                      "admin_user", F.col("cash_in_hand").cast("string").alias("__text"),
                      F.col("date").cast("string").alias("__date_text"))
    reason = (F.when(F.col("cash_date").isNull(), F.lit("Invalid date"))
               .when(F.col("cash_in_hand").isNull(), F.lit(NO_CASH)))
    checked = c.withColumn("reason", reason)
    ok = checked.where(F.col("reason").isNull())
    table = upsert_latest(daily_cash.select("cash_date", "cash_in_hand"), ok, "cash_date", "cash_in_hand")
    if "updated_at" in daily_cash.columns:
        kind = daily_cash.schema["updated_at"].dataType
        counted = ok.select("cash_date").distinct().withColumn("__at", (F.current_timestamp() if now is None else now).cast(kind))
        times = daily_cash.select("cash_date", "updated_at").join(counted, "cash_date", "full_outer")
        table = table.join(times.select("cash_date", F.coalesce("__at", "updated_at").alias("updated_at")), "cash_date", "left")
    audit = ok.select("seq", F.col("admin_user").alias("username"), F.lit(CASH_ACTION).alias("action"),
                      F.concat(F.col("__date_text"), F.lit(" = "), py_float_text(F.col("__text").try_cast("double")))
                      .alias("details"))
    return ChangeResult(table, checked.drop("__text", "__date_text"), audit)


def upsert_settings(settings: DataFrame, changes: DataFrame) -> DataFrame:
    """M7: settings changes (seq, setting_key, setting_value); the value is stored as text."""
    ch = changes.select("seq", "setting_key", F.col("setting_value").cast("string").alias("setting_value"))
    return upsert_latest(settings.select("setting_key", "setting_value"), ch, "setting_key", "setting_value")


def set_opening_cash(settings: DataFrame, requests: DataFrame) -> ChangeResult:
    """M7 for the opening cash seed: requests (seq, amount, admin_user). An amount that does
    not read as a number is rejected ("Enter valid opening cash"); the last valid request
    is stored as ``str(float)`` text under ``opening_cash_seed`` and each is audited."""
    r = requests.select("seq", "admin_user", F.col("amount").cast("string").try_cast("double").alias("__v"))
    checked = r.withColumn("reason", F.when(F.col("__v").isNull() | F.isnan("__v"),
                                            F.lit(NO_OPENING_CASH)))
    ok = checked.where(F.col("reason").isNull()).select(
        "seq", "admin_user", F.lit("opening_cash_seed").alias("setting_key"),
        py_float_text("__v").alias("setting_value"))
    table = upsert_settings(settings, ok.select("seq", "setting_key", "setting_value"))
    audit = ok.select("seq", F.col("admin_user").alias("username"), F.lit(OPENING_ACTION).alias("action"),
                      F.concat(F.lit("Opening Cash Seed set to "), F.col("setting_value")).alias("details"))
    return ChangeResult(table, checked.select("seq", "admin_user", F.col("__v").alias("amount"), "reason"), audit)


def seed_if_absent(settings: DataFrame, seeds: DataFrame) -> DataFrame:
    """Insert (setting_key, setting_value) only for keys not present; within the
    batch the first seed of a key (by ``seq``) is the one inserted."""
    first = seeds.groupBy("setting_key").agg(F.min_by("setting_value", "seq").alias("setting_value"))
    new = first.join(settings.select("setting_key"), "setting_key", "left_anti")
    return settings.select("setting_key", "setting_value").unionByName(new)


# ---- M8 / M10: audit log ----------------------------------------------------------------

def audit_append(audit: DataFrame, rows: DataFrame, company: str | None = None) -> DataFrame:
    """M8: append (username, action, details[, company]) with new ids after the log's
    largest; a missing company is the current company, else ``default``. ``rows`` is read twice
    when called: hand in a written table (``session.materialized``) when it ends a costly plan."""
    comp = F.lit(company or "default")
    r = rows
    if "company" not in r.columns:
        r = r.withColumn("company", F.lit(None).cast("string"))
    if "seq" not in r.columns:
        r = r.withColumn("seq", F.monotonically_increasing_id())
    numbered = dense_number(r, "seq", "id", start=_scalar_max(audit, "id"))
    new = numbered.select("id", F.current_timestamp().cast("timestamp_ntz").alias("timestamp"), "username",
                          "action", "details", F.coalesce(F.col("company"), comp).alias("company"))
    return audit.select("id", "timestamp", "username", "action", "details", "company").unionByName(new)


def backfill_company(audit: DataFrame, company_name: str) -> DataFrame:
    """Add ``company`` when the log has none, and fill its nulls with ``company_name``."""
    if "company" not in audit.columns:
        return audit.withColumn("company", F.lit(company_name))
    return audit.withColumn("company", F.coalesce(F.col("company"), F.lit(company_name)))


# ---- P16 / P17: settings read -----------------------------------------------------------

def setting_value(settings: DataFrame, key: str, default: float = 0.0, alias: str = "value") -> DataFrame:
    """One row: the setting read as a number; missing, null or unreadable -> default.
    An aggregate over the filtered table, so the row exists even when the key does not."""
    v = F.col("setting_value").cast("string").try_cast("double")
    return settings.where(F.col("setting_key") == key).agg(
        F.coalesce(F.max(v), F.lit(float(default))).alias(alias))


def company_list(settings: DataFrame) -> DataFrame:
    """The stored company name (or ``default``) and its key (F1)."""
    name = settings.where(F.col("setting_key") == "company_name").agg(
        F.coalesce(F.max(F.nullif(F.col("setting_value"), F.lit(""))), F.lit("default")).alias("name"))
    return name.select("name", X.company_key("name").alias("key"))


def transactions_contract(tx: DataFrame) -> DataFrame:
    """The transactions table with the date as ISO text and money as DOUBLE."""
    return tx.select("txn_id", iso_text("txn_date").alias("txn_date"), "bill_no", "party_id", "txn_type",
                     "payment_mode", F.col("amount").cast("double").alias("amount"))
