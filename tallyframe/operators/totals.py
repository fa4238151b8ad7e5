"""Stored totals per (party, day, type, mode), kept up to date by signed deltas.

The reports that need no single row (P&L, trial balance, dashboard, outstanding) are sums over transactions grouped by
party, day, type and mode. ``StoredTotals`` keeps those groups in a folder of generations: the first sums up the table, and
every batch of changes (M1 adds, M3 edits, M4 deletes, M11 imports) appends one that sums up its own rows alone, what it adds
with sign 1, what it takes away with -1. A batch never reads the table or earlier generations; a read adds the generations
up, and ``compact`` writes that sum as one. Sums are exact decimals, so totals kept this way equal those computed anew.

``rows`` gives the totals in the columns of ``transactions``, a row a group with its summed amount, so the reports of
``aggregates`` take them as they take the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import money as M
from ..session import path_exists, list_folders

KEYS = ["party_id", "txn_date", "txn_type", "payment_mode"]
#: ``n`` rows, of which ``known`` have an amount, whose sum is ``amount``.
SCHEMA = "party_id long, txn_date date, txn_type string, payment_mode string, n long, known long, amount decimal(38,2)"


def signed(rows: DataFrame, sign: int) -> DataFrame:
    """``rows`` (transactions) as changes of one sign."""
    return rows.select(*KEYS, F.col("amount"), F.lit(sign).cast("long").alias("sign"))


def summed(changes: DataFrame) -> DataFrame:
    """Totals of signed rows: one row a group, combined map-side."""
    known = F.when(F.col("amount").isNotNull(), F.col("sign")).otherwise(F.lit(0).cast("long"))
    return changes.groupBy(*KEYS).agg(
        F.sum("sign").alias("n"), F.sum(known).alias("known"),
        F.coalesce(F.sum(F.col("sign").cast("decimal(3,0)") * F.col("amount")), F.lit(0)).cast(M.WIDE).alias("amount"))


class StoredTotals:
    """The totals below ``root``: ``base=<k>`` sums up everything before generation k, ``gen=<k>`` is one batch."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _numbers(self, kind: str) -> list[int]:
        return sorted(int(f[len(kind) + 1 :]) for f in list_folders(self.spark, self.root) if f.startswith(f"{kind}=") and
                      path_exists(self.spark, f"{self.root}/{f}/_SUCCESS"))

    def create(self, tx: DataFrame) -> None:
        """Sum up the whole table, once."""
        summed(signed(tx, 1)).write.mode("overwrite").parquet(f"{self.root}/base=0")

    def apply(self, number: int, changes: DataFrame) -> None:
        """Append the sums of batch ``number`` (1 or more, each once and in order). A batch that is run again replaces its own."""
        last = max(self._numbers("base"), default=None)
        if last is None or number <= last:
            raise ValueError(f"batch {number} is summed up already, or there are no totals at {self.root}")
        summed(changes).write.mode("overwrite").parquet(f"{self.root}/gen={number}")

    def folders(self) -> list[str]:
        """What a read reads: the last base and the generations after it."""
        base = max(self._numbers("base"), default=None)
        if base is None:
            raise FileNotFoundError(f"No totals at {self.root}")
        return [f"{self.root}/base={base}", *[f"{self.root}/gen={k}" for k in self._numbers("gen") if k > base]]

    def totals(self) -> DataFrame:
        """The groups that have rows, with n, known and amount."""
        folders = self.folders()
        rows = self.spark.read.schema(SCHEMA).parquet(*folders)
        if len(folders) > 1:
            rows = rows.groupBy(*KEYS).agg(F.sum("n").alias("n"), F.sum("known").alias("known"), F.sum("amount").cast(M.WIDE).alias("amount"))
        return rows.where(F.col("n") != 0)

    def rows(self) -> DataFrame:
        """The totals in the columns of ``transactions``; a group without any amount has none."""
        return self.totals().select(*KEYS, F.when(F.col("known") != 0, F.col("amount")).alias("amount"))

    def compact(self) -> None:
        """Write the sum of all generations as the new base. Readers go on with what they have listed; generations summed up
        are left to the owner of the folder."""
        last = max(self._numbers("gen"), default=0)
        if last > max(self._numbers("base")):
            self.totals().write.mode("overwrite").parquet(f"{self.root}/base={last}")
