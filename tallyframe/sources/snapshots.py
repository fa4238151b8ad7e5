"""Snapshots (S7, S8) that write what has changed and are verified before they are restored.

A table's rows fall into buckets by a hash of all their columns. A bucket has a digest: the number of its rows and the
sums of two halves of their md5, which do not depend on order and combine map-side. A snapshot digests every bucket and writes
only those that the snapshot before it does not hold already; its manifest, a small table (table, bucket, folder, rows,
digest), names for every bucket the snapshot that has its rows. So an unchanged table costs one pass over its rows and no
bytes, and a snapshot is whole as long as those it refers to are.

``restore`` digests what it has read and raises, before it writes anything, where a bucket differs from the manifest.
"""

from __future__ import annotations

import datetime as _dt
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import list_folders, path_exists

#: Rows of a bucket, which decides their number when a table is first taken.
BUCKET_ROWS = 1 << 20
MANIFEST = "table string, bucket int, folder string, n long, digest string, buckets int, fields string"


def snapshot_folder(root: str, database: str, prefix: str = "", when: _dt.datetime | None = None) -> str:
    """``{root}/{prefix}{database}_{yyyyMMdd_HHmmss}``."""
    stamp = (when or _dt.datetime.now()).strftime("%Y%m%d_%H%M%S")
    return f"{root.rstrip('/')}/{prefix}{database}_{stamp}"


def _text(df: DataFrame) -> Column:
    """A row as text in which no two different rows agree: every cell with its length, null apart from all texts."""
    cells = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        c = F.unix_micros(c.cast("timestamp")).cast("string") if f.dataType.typeName().startswith("timestamp") else c.cast("string")
        cells.append(F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")))
    return F.concat_ws("|", *cells)


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumn("__text", F.md5(_text(df))).withColumn("bucket", F.pmod(F.xxhash64("__text"), F.lit(buckets)).cast("int"))


def digests(bucketed: DataFrame) -> DataFrame:
    """(bucket, n, digest) of the rows of ``_bucketed``."""
    half = lambda at: F.sum(F.conv(F.substring("__text", at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return bucketed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.concat_ws(":", half(1), half(16)).alias("digest"))


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The buckets of a snapshot. A missing or incomplete one raises FileNotFoundError."""
    if not path_exists(spark, f"{folder.rstrip('/')}/manifest/_SUCCESS"):
        raise FileNotFoundError(f"Backup file not found: {folder}")
    return spark.read.schema(MANIFEST).parquet(f"{folder.rstrip('/')}/manifest")


def last_snapshot(spark: SparkSession, root: str, database: str, prefix: str = "") -> str | None:
    """The latest complete snapshot of a database below ``root`` (names end in their time)."""
    names = [n for n in list_folders(spark, root) if n.startswith(f"{prefix}{database}_") and len(n) == len(prefix) + len(database) + 16]
    done = [n for n in sorted(names) if path_exists(spark, f"{root.rstrip('/')}/{n}/manifest/_SUCCESS")]
    return f"{root.rstrip('/')}/{done[-1]}" if done else None


def snapshot(tables: dict[str, DataFrame], root: str, database: str, prefix: str = "", when: _dt.datetime | None = None,
             bucket_rows: int = BUCKET_ROWS) -> str:
    """Take every table into a new time-stamped folder; returns the folder. Buckets that the last complete snapshot of the
    database holds are referred to. The manifest is written last, so a snapshot that failed is none; taking
    it again replaces what it left."""
    folder = snapshot_folder(root, database, prefix, when)
    entries = None
    for name, df in tables.items():
        spark = df.sparkSession
        before = last_snapshot(spark, root, database, prefix)
        known = manifest(spark, before).where(F.col("table") == name) if before and before != folder else None
        sizes = known.agg(F.max("buckets"), F.max("fields")).first() if known is not None else (None, None)
        fields = json.dumps([[f.name, f.dataType.simpleString()] for f in df.schema.fields])
        if sizes[0] is None or sizes[1] != fields:  # never taken, or of other columns
            known, buckets = None, max(1, -(-df.count() // bucket_rows))
        else:
            buckets = sizes[0]
        rows = _bucketed(df, buckets)
        now = digests(rows)
        if known is not None:
            old = known.select("bucket", F.col("n").alias("__n"), F.col("digest").alias("__digest"), F.col("folder").alias("__folder"))
            now = now.join(old, "bucket", "left")
            same = F.coalesce((F.col("n") == F.col("__n")) & (F.col("digest") == F.col("__digest")), F.lit(False))
        else:
            same, now = F.lit(False), now.withColumn("__folder", F.lit(None).cast("string"))
        now = now.select(F.lit(name).alias("table"), "bucket", F.when(same, F.col("__folder")).otherwise(F.lit(folder)).alias("folder"), "n", "digest",
                         F.lit(buckets).alias("buckets"), F.lit(fields).alias("fields"))
        now.write.mode("overwrite").parquet(f"{folder}/digests/{name}")  # one row a bucket
        now = spark.read.schema(MANIFEST).parquet(f"{folder}/digests/{name}")
        changed = rows.drop("__text").join(now.where(F.col("folder") == folder).select("bucket"), "bucket", "left_semi")
        changed.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/{name}")
        # A table without rows has one entry, for its columns.
        none = spark.createDataFrame([(name, -1, folder, 0, "", buckets, fields)], MANIFEST)
        now = now if now.limit(1).count() else none
        entries = now if entries is None else entries.unionByName(now)
    if entries is None:
        raise ValueError("a snapshot needs tables")
    entries.write.mode("overwrite").parquet(f"{folder}/manifest")
    return folder


def read_snapshot(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a snapshot as it was taken, verified against the manifest."""
    entries = manifest(spark, folder).where(F.col("table") == name).collect()  # one row a bucket
    if not entries:
        raise FileNotFoundError(f"Backup file not found: {folder.rstrip('/')}/{name}")
    columns = ", ".join(f"`{n}` {t}" for n, t in json.loads(entries[0].fields))
    entries = [e for e in entries if e.bucket >= 0]
    rows = spark.createDataFrame([], f"{columns}, bucket int")
    for at in sorted({e.folder for e in entries}):
        paths = [f"{at}/{name}/bucket={e.bucket}" for e in entries if e.folder == at]
        missing = [p for p in paths if not path_exists(spark, p)]
        if missing:
            raise ValueError(f"Backup is damaged: {missing[0]} is missing")
        reader = spark.read.schema(f"{columns}, bucket int").option("basePath", f"{at}/{name}")
        rows = rows.unionByName(reader.parquet(*paths))
    rows = rows.drop("bucket")
    if not entries:
        return rows
    try:
        found = {r.bucket: (r.n, r.digest) for r in digests(_bucketed(rows, entries[0].buckets)).collect()}
    except Exception as e:  # noqa: BLE001 - a file that cannot be read at all
        raise ValueError(f"Backup is damaged: a file of {name} cannot be read") from e
    wrong = sorted(set(found.items()) ^ {(e.bucket, (e.n, e.digest)) for e in entries})
    if wrong:
        raise ValueError(f"Backup is damaged: bucket {wrong[0][0]} of {name} is not what was taken")
    return rows


def restore(spark: SparkSession, folder: str, names: list[str], target_root: str) -> dict[str, DataFrame]:
    """Read a snapshot and write it as the current tables at ``target_root`` (a new location, never the one being
    read). All tables are verified before the first is written. A missing snapshot raises FileNotFoundError, a
    damaged one ValueError."""
    read = {name: read_snapshot(spark, folder, name) for name in names}
    out = {}
    for name, rows in read.items():
        target = f"{target_root.rstrip('/')}/{name}"
        rows.write.mode("overwrite").parquet(target)
        out[name] = spark.read.parquet(target)
    return out
