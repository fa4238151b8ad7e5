"""Any page of the transaction list directly, by its place in the order.

An offset reads everything before the page it is to show. ``PageIndex`` writes the list once in its order (date, id), in ranges of
about equal rows, a folder each, with every row's place in its range; the counts of the ranges (one row a range) then map a
page number to the one or two ranges that have its rows, of which the filter on the place skips all row groups but the page's own.

Changes after the index was built are not in it: it belongs to the table version that it was built from. Null dates come last, as
in the list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import path_exists
from .lists import LIST_COLUMNS, _finish, joined_list
from .running import ranged


class PageIndex:
    """The list below ``root``: ``rows/blk=<k>`` and ``counts``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def build(self, tx: DataFrame, parties: DataFrame, parts: int | None = None) -> None:
        """Order the list of ``tx`` into ``parts`` ranges (Spark's own number, if not given)."""
        rows = ranged(joined_list(tx, parties), ["txn_date", "id"], parts, "page-order")
        rows = rows.select(*dict.fromkeys([*LIST_COLUMNS, "txn_date"]), F.col("__pos").alias("pos"), F.col("__blk").alias("blk"))
        # A range is one task's already; sorting keeps places together in row groups.
        rows.repartition("blk").sortWithinPartitions("blk", "pos").write.mode("overwrite").partitionBy("blk").parquet(f"{self.root}/rows")
        rows.groupBy("blk").agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/counts")

    def counts(self) -> list[tuple[int, int]]:
        """(range, rows) in order: as many entries as there are ranges."""
        if not path_exists(self.spark, f"{self.root}/counts/_SUCCESS"):
            raise FileNotFoundError(f"No page index at {self.root}")
        return sorted((r.blk, r.n) for r in self.spark.read.schema("blk long, n long").parquet(f"{self.root}/counts").collect())

    def page(self, number: int, limit: int = 100) -> DataFrame:
        """Page ``number`` (1 or more) of ``limit`` rows in (date desc, id desc) order; a page beyond the last is empty."""
        if number < 1 or limit < 1:
            raise ValueError("pages and limits start at 1")
        counts = self.counts()
        total = sum(n for _, n in counts)
        # Places in ascending order that the page has: [low, high).
        high = total - (number - 1) * limit
        low, before, wanted, inside = max(0, high - limit), 0, [], F.lit(False)
        for blk, n in counts:
            a, b = max(low, before) - before, min(high, before + n) - before
            if a < b:
                wanted.append(blk)
                inside = inside | ((F.col("blk") == blk) & (F.col("pos") >= a) & (F.col("pos") < b))
            before += n
        rows = self.spark.read.parquet(f"{self.root}/rows") if counts else None
        if rows is None:
            return self.spark.createDataFrame([], "id long, date string, bill_no string, party string, type string, mode string, amount double")
        rows = rows.where(F.col("blk").isin(wanted) & inside) if wanted else rows.where("false")
        return _finish(rows.orderBy(F.col("txn_date").desc(), F.desc("id")))

    def info(self, number: int, limit: int = 100) -> tuple[int, int, int, int]:
        """(page, limit, total, pages) of the list, from the counts alone."""
        total = sum(n for _, n in self.counts())
        return number, limit, total, -(-total // limit)
