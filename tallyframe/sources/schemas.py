"""Fixed schemas of the bookkeeping tables (S3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

PARTIES = T.StructType([
    T.StructField("party_id", T.LongType(), False),
    T.StructField("name", T.StringType()),
    T.StructField("normalized_name", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("credit_allowed", T.BooleanType()),
])

TRANSACTIONS = T.StructType([
    T.StructField("txn_id", T.LongType(), False),
    T.StructField("txn_date", T.DateType()),
    T.StructField("bill_no", T.StringType()),
    T.StructField("party_id", T.LongType()),
    T.StructField("txn_type", T.StringType()),
    T.StructField("payment_mode", T.StringType()),
    T.StructField("amount", MONEY),
])

DAILY_CASH = T.StructType([
    T.StructField("cash_date", T.DateType(), False),
    T.StructField("cash_in_hand", MONEY),
])

AUDIT_LOGS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("username", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("details", T.StringType()),
    T.StructField("company", T.StringType()),
])

APP_SETTINGS = T.StructType([
    T.StructField("setting_key", T.StringType(), False),
    T.StructField("setting_value", T.StringType()),
])

# Header of an import file as the reference's client exports it; every column is text.
RAW_IMPORT_COLUMNS = ["Date", "Bill No", "Customer Name", "Type", "Payment Mode", "Amount"]

TABLES = {
    "parties": PARTIES,
    "transactions": TRANSACTIONS,
    "daily_cash": DAILY_CASH,
    "audit_logs": AUDIT_LOGS,
    "app_settings": APP_SETTINGS,
}


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    """An empty frame with the fixed schema of ``name`` (table creation, S3)."""
    return spark.createDataFrame([], TABLES[name])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` onto ``schema``: same names, order and types."""
    from pyspark.sql import functions as F

    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
