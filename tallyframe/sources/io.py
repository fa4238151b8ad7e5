"""Sources and sinks (S1-S9). CSV is written and read with quotes doubled, as RFC 4180 and spreadsheets have it.

Every writer takes a target path and writes a *new* location: parquet has no in-place
update, so a changed table is written next to the old one and the caller switches over
(S8 restores the same way). Paths on a cluster must be shared storage; the helpers in
``session.py`` derive them from ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sheet_name
from ..session import list_folders, path_exists
from .import_files import RANGE_BYTES, cells_as_columns, header_names, read_records_of
from .schemas import TABLES
from .snapshots import restore, snapshot, snapshot_folder  # noqa: F401 - S7, S8


def read_parquet_table(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """A table at rest. With ``name`` the fixed schema is enforced on read."""
    reader = spark.read
    if name is not None:
        reader = reader.schema(TABLES[name])
    return reader.parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict[str, str],
              partition_column: str | None = None, lower: int | None = None, upper: int | None = None,
              num_partitions: int | None = None) -> DataFrame:
    """S1 for a live database: a partitioned JDBC read (one query per partition).
    Not exercised by the tests here, which have no database."""
    if partition_column is not None:
        return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower, upperBound=upper,
                               numPartitions=num_partitions, properties=properties)
    return spark.read.jdbc(url, table, properties=properties)


def read_import_records(spark: SparkSession, path: str | list[str], row_id: str = "row_id",
                        range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of import files (CSV with a header row each), read by the ``import_files`` source.

    ``path`` names files, folders or patterns; files may differ in their headers. ``cells`` maps a header's names to the
    record's texts, as they stand. Beside it: ``row_id``, the file's own column of that name or the record's number in its
    file (the header is 1, as the reference reports rows), ``file``, ``row_order`` (unique, in order of file and record) and
    ``problem``, what is wrong with the record itself (an unclosed quote, more cells than the header has names).
    Nothing is read before the scan, and large files are split.
    """
    return read_records_of(spark, path, range_bytes, row_id)


def read_import_csv(spark: SparkSession, path: str | list[str], row_id: str = "row_id", columns: list[str] | None = None,
                    pandas_missing: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """S2 with a column for every name, all text: ``read_import_records`` and the names of ``columns`` or, without them, of
    all files' headers (the first record of each is read for them). With ``pandas_missing`` the texts a pandas
    reader takes as missing (``NA``, ``null``, ...) become null, as in the reference (Q20). Names that differ only in
    case do not go side by side as columns: use the records for such files, as an import does.
    """
    df = cells_as_columns(read_import_records(spark, path, row_id, range_bytes),
                          columns if columns is not None else header_names(spark, path))
    if pandas_missing:
        from ..operators.importing import na_tokens_to_null

        df = na_tokens_to_null(df, keep=(row_id, "file", "row_order", "problem"))
    return df


def write_transactions_layout(tx: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """S3/S4 at scale: the transactions table partitioned by ``txn_date`` and sorted by
    (party_id, txn_id) inside each day, replacing the reference's secondary indexes.

    Day-book and date-range filters (P6, P7) then prune whole partitions, and a party's
    rows are clustered so parquet row-group statistics skip the rest. The shuffle is a
    range partitioning on (day, party, id): boundaries fall inside a day when it is
    large, so a day holding a third of all rows is written by many tasks, not one.
    """
    keys = ["txn_date", "party_id", "txn_id"]
    (tx.repartitionByRange(*keys).sortWithinPartitions(*keys)
       .write.mode(mode).partitionBy("txn_date").parquet(path))


def append_table(df: DataFrame, path: str) -> None:
    """Append rows to a parquet table."""
    df.write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, quotes inside a cell doubled."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_report_json(df: DataFrame, path: str) -> None:
    """A report as JSON lines (one object per row)."""
    df.write.mode("overwrite").json(path)


def unique_sheets(df: DataFrame, sheet_col: str, key_col: str) -> DataFrame:
    """key_col and ``sheet``: the sheet name (F21) of each key, made unique: of keys whose names
    agree after the cut, all but the smallest end in ``~key``."""
    names = df.groupBy(key_col).agg(F.min(sheet_col).alias("__name")).withColumn("__cut", F.coalesce(sheet_name(F.col("__name")), F.lit("")))
    first = names.groupBy("__cut").agg(F.min(key_col).alias("__first"))
    tail = F.concat(F.lit("~"), F.col(key_col).cast("string"))
    own = F.concat(F.substring(F.col("__cut"), F.lit(1), F.lit(31) - F.length(tail)), tail)
    return names.join(first, "__cut").select(key_col, F.when(F.col(key_col) == F.col("__first"), F.col("__cut")).otherwise(own).alias("sheet"))


def export_report_csv(df: DataFrame, path: str, sheet_col: str | None = None, key_col: str | None = None,
                      order_by: list[str] | None = None) -> None:
    """A report as CSV with a header.

    With ``sheet_col`` every party's sheet is exported at once: rows are grouped by ``key_col``
    (the party id; two parties whose names agree in the 31 characters of a sheet name stay
    two sheets), ``sheet`` names the sheet, and rows are range-partitioned and sorted by
    (key, order), so each sheet is contiguous and a file holds many sheets. (One folder per
    sheet would mean one file per party -- millions of tiny files at scale.) ``_sheets`` beside the files tells which
    ranges hold a sheet, for ``read_sheet``.
    """
    if sheet_col is None:
        write_csv(df, path)
        return
    if key_col is None:
        raise ValueError("sheets need the column that tells the parties apart")
    w = df.join(unique_sheets(df, sheet_col, key_col), key_col)
    # Ranges on (key, order columns): a sheet holding a third of the rows is split
    # over several tasks and files, still contiguous and in order.
    keys = [key_col, *(order_by or [])]
    w = w.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("range", F.spark_partition_id())
    w.write.mode("overwrite").option("header", True).option("escape", '"').partitionBy("range").csv(path)
    spark = df.sparkSession
    if list_folders(spark, path) != ["_SUCCESS"]:  # the index: which ranges hold a sheet, a row a sheet and range
        found = _read_sheets(spark, path).groupBy("sheet", "range").agg(F.count(F.lit(1)).alias("rows"))
        found.sort("sheet", "range").write.mode("overwrite").parquet(f"{path}/_sheets")


def _read_sheets(spark: SparkSession, paths: str | list[str], base: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", True)
    return (reader.option("basePath", base) if base else reader).csv(paths)


def read_sheet(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """One sheet of an export, from the files that its index names. An unknown sheet raises KeyError."""
    ranges = spark.read.parquet(f"{path}/_sheets").where(F.col("sheet") == sheet).select("range").collect() if path_exists(
        spark, f"{path}/_sheets/_SUCCESS") else []
    if not ranges:
        raise KeyError(f"no sheet {sheet!r} at {path}")
    rows = _read_sheets(spark, [f"{path}/range={r.range}" for r in ranges], path)
    return rows.where(F.col("sheet") == sheet).drop("range")


def write_rejects(rejected: DataFrame, path: str) -> None:
    """The reject report (row, reason) as CSV."""
    write_csv(rejected, path)
