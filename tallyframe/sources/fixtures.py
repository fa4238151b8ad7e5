"""Bookkeeping tables derived from the driver's benchmark tables.

The reference keeps six SQL tables; the test data is a TPC-H-like star schema. These
functions only map columns of the given tables onto the bookkeeping schemas (the
mapping is fixed by FIXTURES.md); they do none of the queries' work. Every function
reads only the columns it needs, so the parquet scans are pruned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import MONEY

# Fixed values of the test fixtures (FIXTURES.md).
OPENING_CASH_SEED = 50000
COMPANY_NAME = "Alpha Traders"
AS_OF = "1998-06-15"
PIVOT_YEAR = 2076


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Source S1: one parquet table of the driver's data set."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _when_chain(pairs, otherwise) -> Column:
    expr = None
    for cond, value in pairs:
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    return expr.otherwise(otherwise)


def parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    seg = F.col("c_mktsegment")
    ptype = _when_chain([
        (F.col("c_custkey") == 1, F.lit("Bank")),
        (F.col("c_custkey") % 50 == 0, F.lit(None).cast("string")),
        (seg == "BUILDING", F.lit("Customer")),
        (seg.isin("AUTOMOBILE", "HOUSEHOLD"), F.lit("Credit Customer")),
        (seg == "MACHINERY", F.lit("Supplier")),
    ], F.lit("Expense Account"))
    return c.select(
        F.col("c_custkey").alias("party_id"),
        F.col("c_name").alias("name"),
        F.lower(F.replace(F.col("c_name"), F.lit(" "), F.lit("_"))).alias("normalized_name"),
        ptype.alias("type"),
        seg.isin("AUTOMOBILE", "HOUSEHOLD").alias("credit_allowed"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transaction_columns(read_table(spark, sf_dir, "orders"))


def _transaction_columns(o: DataFrame, *more: Column) -> DataFrame:
    k = F.col("o_orderkey")
    pri = F.col("o_orderpriority")
    txn_type = _when_chain([
        (k % 100 == 15, F.lit("Reciept")),
        (k % 10 < 4, F.lit("Sale")),
        (k % 10 == 4, F.lit("sale")),
        (k % 10 < 7, F.lit("Receipt")),
        (k % 10 == 7, F.lit("Expense")),
        (k % 10 == 8, F.lit("Sale Return")),
    ], F.lit("Purchase"))
    mode = _when_chain([
        (pri == "1-URGENT", F.lit("Cash")),
        (pri == "2-HIGH", F.lit("Bank")),
        ((pri == "3-MEDIUM") & (k % 4 == 0), F.lit("Upi")),
        (pri == "3-MEDIUM", F.lit("UPI")),
        (pri == "4-NOT SPECIFIED", F.lit("Credit")),
        (k % 3 == 0, F.lit("GPay")),
        (k % 3 == 1, F.lit("Gpay")),
    ], F.lit("Google Pay"))
    return o.select(
        k.alias("txn_id"),
        F.col("o_orderdate").cast("date").alias("txn_date"),
        F.when(k % 11 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("INV-"), k.cast("string"))).alias("bill_no"),
        F.when(k % 97 == 0, F.lit(None).cast("long")).otherwise(F.col("o_custkey")).alias("party_id"),
        txn_type.alias("txn_type"),
        mode.alias("payment_mode"),
        F.when(k % 101 == 0, F.lit(None).cast(MONEY))
         .otherwise(F.col("o_totalprice").cast(MONEY)).alias("amount"),
        *more,
    )


def daily_cash(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select("l_shipdate", "l_extendedprice")
    return (li.where(F.dayofmonth("l_shipdate") % 9 == 0)
              .groupBy(F.col("l_shipdate").cast("date").alias("cash_date"))
              .agg(F.max("l_extendedprice").cast(MONEY).alias("cash_in_hand")))


def audit_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props")
    u = F.col("user_id")
    company = _when_chain([
        (u % 3 == 0, F.lit(None).cast("string")),
        (u % 3 == 1, F.lit(COMPANY_NAME)),
    ], F.lit("default"))
    return ev.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("user_"), u.cast("string")).alias("username"),
        F.col("event_type").alias("action"),
        F.col("props").alias("details"),
        company.alias("company"),
    )


#: Letters whose title case is not what cutting at other characters and capitals would give.
ODD_TYPE = "日a ⅷx ﬁne ßeta"


def _import_name() -> Column:
    k = F.col("o_orderkey")
    return _when_chain([
        (k % 83 == 0, F.lit(None).cast("string")),
        (k % 107 == 0, F.lit('Smith "Bob", Sons\\\n& Co')),
        (k % 7 == 0, F.concat(F.lit("New Party "), (F.col("o_custkey") % 40).cast("string"))),
    ], F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")))


def raw_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An import file as text columns, keyed by ``row_id`` (the file's line order)."""
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    k = F.col("o_orderkey")
    d = F.col("o_orderdate")
    pri = F.col("o_orderpriority")
    dd = F.lpad(F.dayofmonth(d).cast("string"), 2, "0")
    mm = F.lpad(F.month(d).cast("string"), 2, "0")
    yyyy = F.year(d).cast("string")
    date_text = _when_chain([
        (k % 97 == 0, F.lit(None).cast("string")),
        (k % 89 == 0, F.lit("not-a-date")),
        (k % 31 == 0, F.date_format(d, "dd-MMM-yyyy")),
        (k % 37 == 0, F.date_format(d, "dd/MM/yyyy 10:30")),
        (k % 41 == 0, F.date_format(d, "yyyy-M-d")),
        (k % 43 == 0, F.date_format(d, "MMM d yyyy")),
        (k % 47 == 0, F.date_format(d, "dd MM yyyy")),
        # Month first: read so only where day-first is impossible.
        (k % 53 == 0, F.date_format(d, "MM-dd-yyyy")),
        (k % 59 == 0, F.date_format(d, "yyyy.MM.dd")),
        (k % 61 == 0, F.date_format(d, "dd.MM.yyyy 10:30:00")),
        (k % 67 == 0, F.date_format(d, "dd-MMM-yy")),
        (k % 103 == 0, F.date_format(d, "EEE, dd MMM yyyy")),
        (k % 107 == 0, F.date_format(d, "ddMMMyyyy")),
        (k % 109 == 0, F.date_format(d, "MMM yyyy")),
        (k % 113 == 0, F.date_format(d, "'10:30' dd/MM-yyyy")),
        (k % 127 == 0, F.date_format(d, "dd.MM.'1600'")),
        (k % 3 == 0, F.concat(dd, F.lit("/"), mm, F.lit("/"), yyyy)),
    ], F.concat(dd, F.lit("."), mm, F.lit("."), F.substring(yyyy, 3, 2)))
    name = _import_name()
    ttype = _when_chain([
        (k % 13 == 0, F.lit(None).cast("string")),
        (k % 131 == 0, F.lit(ODD_TYPE)),
        (k % 10 < 5, F.lit("SALE")),
        (k % 10 < 7, F.lit("receipt")),
        (k % 10 == 7, F.lit("EXPENSE")),
    ], F.lit("sale return"))
    mode = _when_chain([
        (k % 17 == 0, F.lit(None).cast("string")),
        (pri == "1-URGENT", F.lit("CASH")),
        (pri == "2-HIGH", F.lit("bank")),
        (pri == "3-MEDIUM", F.lit("UPI")),
        (pri == "4-NOT SPECIFIED", F.lit("CREDIT")),
    ], F.lit("GPay"))
    amount = _when_chain([
        (k % 79 == 0, F.lit("1,200")),
        (k % 101 == 0, F.lit(None).cast("string")),
        (k % 71 == 0, F.lit("1e17")),
        (k % 137 == 0, F.lit("\u00a05 ")),
        (k % 73 == 0, F.lit("12345678.5")),
        (k % 29 == 0, F.lit("5.5")),
    ], F.col("o_totalprice").cast(MONEY).cast("string"))
    return o.select(
        k.alias("row_id"),
        date_text.alias("Date"),
        F.when(k % 11 == 0, F.lit(None).cast("string"))
         .when(k % 103 == 0, F.concat(F.lit('C:\\"'), k.cast("string"), F.lit('",\\')))
         .otherwise(F.concat(F.lit("INV-"), k.cast("string"))).alias("Bill No"),
        name.alias("Customer Name"),
        ttype.alias("Type"),
        mode.alias("Payment Mode"),
        amount.alias("Amount"),
    )


def app_settings(spark: SparkSession) -> DataFrame:
    """The settings table before any change: the opening cash seed alone (the company's name is
    first set by the batches)."""
    from .schemas import APP_SETTINGS

    return spark.createDataFrame(
        [("opening_cash_seed", str(float(OPENING_CASH_SEED)))],
        APP_SETTINGS)


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry-form rows: a transaction's fields as text, with the party typed by name as in
    the import file of the same order (so some names are unknown and some are missing)."""
    rows = _transaction_columns(read_table(spark, sf_dir, "orders"), _import_name().alias("party"))
    return rows.select(
        F.col("txn_id").alias("row_id"),
        F.col("txn_date").cast("string").alias("date"),
        "bill_no", "party", "txn_type",
        F.col("payment_mode").alias("mode"),
        F.col("amount").cast("string").alias("amount"))


# ---- change batches, derived from the same tables ------------------------

EDIT_FIELD_CYCLE = ["txn_date", "bill_no", "txn_type", "payment_mode", "amount", "party"]
SECOND_BATCH = 1_000_000_000_000


def _field_at(i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(f) for f in EDIT_FIELD_CYCLE]), (i % len(EDIT_FIELD_CYCLE) + 1).cast("int"))


def adds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Add requests: the entry rows, in row order."""
    return entries(spark, sf_dir).withColumnRenamed("row_id", "seq")


def creates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Create-party requests: every name of the import file, typed by its payment mode."""
    r = raw_import(spark, sf_dir)
    ptype = (F.when(F.col("Payment Mode") == "bank", F.lit("Bank"))
              .when(F.col("Payment Mode") == "CREDIT", F.lit("Credit Customer"))
              .otherwise(F.lit("Customer")))
    return r.select(F.col("row_id").alias("seq"), F.col("Customer Name").alias("name"), ptype.alias("ptype"),
                    (ptype == "Credit Customer").alias("credit"))


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit requests: a first batch takes the import file's text as new values; a second,
    later batch edits the same field of the next transaction, so most fields are edited
    twice and the audit must show the first edit's value as the old one."""
    r = raw_import(spark, sf_dir)
    f1 = _field_at(F.col("row_id"))
    v1 = (F.when(f1 == "txn_date", F.col("Date")).when(f1 == "bill_no", F.col("Bill No"))
           .when(f1 == "txn_type", F.col("Type")).when(f1 == "payment_mode", F.col("Payment Mode"))
           .when(f1 == "amount", F.col("Amount")).otherwise(F.col("Customer Name")))
    first = r.select(F.col("row_id").alias("seq"), F.col("row_id").alias("txn_id"), F.lit("admin").alias("admin_user"),
                     f1.alias("field"), v1.alias("new_value"))
    t = transactions(spark, sf_dir)
    target = F.col("txn_id") + 1
    f2 = _field_at(target)
    v2 = (F.when(f2 == "txn_date", F.date_add("txn_date", 1).cast("string"))
           .when(f2 == "bill_no", F.concat(F.coalesce(F.col("bill_no"), F.lit("INV")), F.lit("-R")))
           .when(f2 == "txn_type", F.lit("Receipt")).when(f2 == "payment_mode", F.lit("Cash"))
           .when(f2 == "amount", (F.coalesce(F.col("amount"), F.lit(0)) + 1).cast(MONEY).cast("string"))
           .otherwise(F.lit("x")))
    second = t.select((F.col("txn_id") + SECOND_BATCH).alias("seq"), target.alias("txn_id"),
                      F.lit("auditor").alias("admin_user"), f2.alias("field"), v2.alias("new_value"))
    return first.unionByName(second)


def deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delete requests: every purchase, then one request per event naming an id (some do
    not exist, some were deleted already)."""
    t = transactions(spark, sf_dir).where(F.col("txn_type") == "Purchase")
    ev = read_table(spark, sf_dir, "events").select("event_id", "user_id")
    return t.select(F.col("txn_id").alias("seq"), "txn_id", F.lit("admin").alias("admin_user")).unionByName(
        ev.select((F.col("event_id") + SECOND_BATCH).alias("seq"), (F.col("event_id") * 2).alias("txn_id"),
                  F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("admin_user")))


def renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rename requests, one per order: the order's party name gets a suffix, or (every fifth
    order) the name of the next customer, which is taken."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    old = _import_name()
    new = F.when(F.col("o_orderkey") % 5 == 0,
                 F.concat(F.lit("Customer#"), F.lpad((F.col("o_custkey") + 1).cast("string"), 9, "0"))) \
           .otherwise(F.concat(old, F.lit(" & Co")))
    return o.select(F.col("o_orderkey").alias("seq"), old.alias("old_name"), new.alias("new_name"),
                    F.lit("admin").alias("admin_user"))


def cash_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cash counts, one per line item: many per day, the last by ``seq`` wins."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate",
                                                      "l_extendedprice")
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
                     F.col("l_shipdate").cast("date").cast("string").alias("date"),
                     F.col("l_extendedprice").cast(MONEY).cast("string").alias("cash_in_hand"),
                     F.lit("admin").alias("admin_user"))


def setting_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings changes, one per event: purchases set the opening cash, others a preference of their
    type; the value is the event's value as text."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return ev.select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", F.lit("opening_cash_seed"))
                     .otherwise(F.concat(F.lit("pref_"), F.col("event_type"))).alias("setting_key"),
                     F.col("value").cast(MONEY).cast("string").alias("setting_value"))


def setting_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert-if-absent seeds, one per event: signups try to seed ``company_name``."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    key = F.when(F.col("event_type") == "signup", F.lit("company_name")) \
           .otherwise(F.concat(F.lit("seed_"), F.col("event_type")))
    return ev.select(F.col("event_id").alias("seq"), key.alias("setting_key"), F.col("props").alias("setting_value"))


def opening_cash_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opening-cash requests, one per event: the event's value as the amount; every 13th is in
    larger units (above 1e7), every 17th no number."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    amount = (F.when(F.col("event_id") % 17 == 0, F.lit("n/a"))
               .when(F.col("event_id") % 13 == 0, (F.col("event_id") + 20000000.5).cast("decimal(18,2)").cast("string"))
               .otherwise(F.col("value").cast("string")))
    return ev.select(
        F.col("event_id").alias("seq"), amount.alias("amount"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("admin_user"))
