"""A transactions table that batches of changes rewrite only where they touch it (M1, M3, M4).

Rows stand in buckets of ``bucket_ids`` consecutive ids, a folder each. Which folder holds a bucket is a small table (bucket,
folder, rows), written last for every version: readers see the version before a batch or the one after it, a batch that fails
leaves the old one in force, and one that is run again replaces its own folders. A batch's ids give its buckets by
arithmetic, so no file is opened to find them; only those are read, changed by the operators of ``changes`` as
they stand, and written again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes as CH
from ..session import list_folders, materialized, path_exists
from .schemas import TRANSACTIONS

BUCKET_IDS = 1 << 20
COLUMNS = [f.name for f in TRANSACTIONS.fields]


class BucketedTransactions:
    """Transactions below ``root``, of which one writer at a time makes new versions."""

    def __init__(self, spark: SparkSession, root: str, bucket_ids: int = BUCKET_IDS):
        self.spark, self.root, self.bucket_ids = spark, root.rstrip("/"), bucket_ids

    def version(self) -> int:
        """The last complete version, -1 for none."""
        return max((int(n[8:]) for n in list_folders(self.spark, self.root)
                    if n.startswith("version=") and path_exists(self.spark, f"{self.root}/{n}/buckets/_SUCCESS")), default=-1)

    def buckets(self) -> dict[int, tuple[str, int]]:
        """(folder, rows) of every bucket that has rows: one entry for each ``bucket_ids`` ids."""
        version = self.version()
        if version < 0:
            raise FileNotFoundError(f"No table at {self.root}")
        rows = self.spark.read.schema("bucket long, folder string, n long").parquet(f"{self.root}/version={version}/buckets")
        return {r.bucket: (r.folder, r.n) for r in rows.collect()}

    def read(self, wanted: set[int] | None = None) -> DataFrame:
        """The table, or of it the buckets ``wanted``."""
        held = self.buckets()
        folders = [folder for b, (folder, _) in sorted(held.items()) if wanted is None or b in wanted]
        if not folders:
            return self.spark.createDataFrame([], TRANSACTIONS)
        return self.spark.read.schema(TRANSACTIONS).parquet(*folders)

    def _bucket(self, column: str = "txn_id"):
        return F.expr(f"{column} DIV {self.bucket_ids}")

    def touched(self, ids: DataFrame) -> set[int]:
        """The buckets of ``ids`` (txn_id) that the table has: at most as many as it has buckets."""
        found = ids.where("txn_id IS NOT NULL").select(self._bucket().alias("b")).distinct()
        held = self.spark.createDataFrame([(b,) for b in self.buckets()], "b long")
        return {r.b for r in found.join(held, "b", "left_semi").collect()}

    def create(self, tx: DataFrame) -> None:
        self._put(tx, {})

    def _put(self, rows: DataFrame, kept: dict[int, tuple[str, int]]) -> None:
        """The next version: ``rows`` in folders of its own beside the buckets that are kept."""
        place = f"{self.root}/version={self.version() + 1}"
        # Ranges of ids: a bucket is one task's or a few neighbours', in order.
        placed = rows.select(*COLUMNS, self._bucket().alias("bucket")).repartitionByRange("bucket", "txn_id").sortWithinPartitions("bucket", "txn_id")
        placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{place}/rows")
        written = [n for n in list_folders(self.spark, f"{place}/rows") if n.startswith("bucket=")]
        own = self.spark.read.parquet(f"{place}/rows").groupBy("bucket").count().collect() if written else []
        entries = [(b, f, n) for b, (f, n) in kept.items()] + [(r["bucket"], f"{place}/rows/bucket={r['bucket']}", r["count"]) for r in own]
        manifest = self.spark.createDataFrame(sorted(entries), "bucket long, folder string, n long")
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{place}/buckets")

    def _replace(self, result: CH.ChangeResult, touched: set[int]) -> CH.ChangeResult:
        """Store what a batch made of the buckets ``touched``; its other results as written tables, for their inputs go on changing."""
        kept = {b: e for b, e in self.buckets().items() if b not in touched}
        outcome = materialized(result.outcome, "batch-outcome")
        audit = None if result.audit is None else materialized(result.audit, "batch-audit")
        delta = None if result.delta is None else materialized(result.delta, "batch-delta")
        self._put(result.table, kept)
        return CH.ChangeResult(self.read(), outcome, audit, delta)

    def edit(self, edits: DataFrame) -> CH.ChangeResult:
        """M3: as ``changes.edit_transactions`` on the whole table."""
        touched = self.touched(edits.select("txn_id"))
        return self._replace(CH.edit_transactions(self.read(touched), edits), touched)

    def delete(self, deletes: DataFrame) -> CH.ChangeResult:
        """M4: as ``changes.delete_transactions`` on the whole table."""
        touched = self.touched(deletes.select("txn_id"))
        return self._replace(CH.delete_transactions(self.read(touched), deletes), touched)

    def add(self, parties: DataFrame, adds: DataFrame) -> CH.ChangeResult:
        """M1: as ``changes.add_transactions``: new ids follow the largest, so only the last bucket is read and written again."""
        last = max(self.buckets(), default=None)
        touched = set() if last is None else {last}
        return self._replace(CH.add_transactions(self.read(touched), parties, adds), touched)
