"""The cash carry-forward by months (W4, R4): a change recomputes its month and a scan of months.

What a day does to the cash that it opens with is a function: a counted day sets it (a reset), another adds its net. Such functions
compose to one of the same kind, so a month is (reset or not, amount): after its last count the nets since, or all its nets.
``CashMonths`` stores that pair for every month. A changed count or row recomputes the pairs of its own months from their rows
alone; the opening of any month is a scan of the pairs before it, one row a month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import money as M
from ..session import list_folders, path_exists
from .carries import month_number, month_start
from .cash import SUMMARY_COLUMNS, carry_forward, cash_days

PAIRS = "month int, reset boolean, amount decimal(38,2)"


def month_pairs(days: DataFrame) -> DataFrame:
    """(month, reset, amount) of the days (date, cash_in, cash_expense, cash_in_hand) of whole months."""
    d = days.select(month_number(F.col("date")).alias("month"), "date", "cash_in_hand", (F.col("cash_in") - F.col("cash_expense")).cast(M.WIDE).alias("net"))
    counted = F.col("cash_in_hand").isNotNull()
    last = d.groupBy("month").agg(F.max(F.when(counted, F.struct("date", "cash_in_hand"))).alias("last"))
    since = d.join(last, "month").groupBy("month").agg(
        F.first("last").alias("last"), F.sum(F.when(F.col("last").isNull() | (F.col("date") > F.col("last.date")), F.col("net"))).alias("net"))
    amount = F.coalesce("net", F.lit(0)) + F.coalesce("last.cash_in_hand", F.lit(0))
    return since.select("month", F.col("last").isNotNull().alias("reset"), amount.cast(M.WIDE).alias("amount"))


def _of_months(rows: DataFrame, day: str, months: list[int]) -> DataFrame:
    """The rows of whole months, as ranges of days, so that a layout by day is read for these alone."""
    inside = F.lit(False)
    for m in sorted(months):
        inside = inside | ((F.col(day) >= F.to_date(F.lit(month_start(m)))) & (F.col(day) < F.to_date(F.lit(month_start(m + 1)))))
    return rows.where(inside)


class CashMonths:
    """The pairs of all months below ``root``, a small table a version."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _version(self) -> int:
        return max((int(n[8:]) for n in list_folders(self.spark, self.root)
                    if n.startswith("version=") and path_exists(self.spark, f"{self.root}/{n}/_SUCCESS")), default=-1)

    def pairs(self) -> DataFrame:
        version = self._version()
        if version < 0:
            raise FileNotFoundError(f"No cash months at {self.root}")
        return self.spark.read.schema(PAIRS).parquet(f"{self.root}/version={version}")

    def _put(self, pairs: DataFrame) -> None:
        pairs.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/version={self._version() + 1}")

    def create(self, tx: DataFrame, parties: DataFrame, daily_cash: DataFrame) -> None:
        """The pairs of all months, once."""
        self._put(month_pairs(cash_days(tx, parties, daily_cash)))

    def update(self, tx: DataFrame, parties: DataFrame, daily_cash: DataFrame, months: list[int]) -> None:
        """Recompute ``months`` (``month_number``) from the tables as they are now; the others are kept."""
        if not months:
            return
        kept = self.pairs().where(~F.col("month").isin(months))
        fresh = month_pairs(cash_days(_of_months(tx, "txn_date", months), parties, _of_months(daily_cash, "cash_date", months)))
        self._put(kept.unionByName(fresh))

    def opening(self, month: int, seed) -> object:
        """The cash that a month opens with: the last reset before it and the nets since, or the seed and all nets."""
        before = self.pairs().where(F.col("month") < month)
        at = before.agg(F.max(F.when(F.col("reset"), F.col("month")))).first()[0]
        total = before.where(F.col("month") >= at if at is not None else F.lit(True)).agg(F.sum("amount")).first()[0] or 0
        return total if at is not None else total + seed

    def summary(self, tx: DataFrame, parties: DataFrame, daily_cash: DataFrame, month: int, seed) -> DataFrame:
        """R4's rows of one month, from the rows of that month and the pairs before it."""
        days = cash_days(_of_months(tx, "txn_date", [month]), parties, _of_months(daily_cash, "cash_date", [month]))
        d = carry_forward(days, F.lit(str(self.opening(month, seed))).cast(M.WIDE))
        return d.orderBy(F.desc("date")).select(F.date_format("date", "yyyy-MM-dd").alias("date"), *[M.to_double(c).alias(c) for c in SUMMARY_COLUMNS[1:]])
