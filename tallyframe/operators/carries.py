"""Balances brought forward from stored month openings.

A statement for a date range that opens with the balance of everything before it would read the whole history.
``MonthOpenings`` stores, for every key (a party, an account) and month, the balance before that month, a folder a month, so
such a statement reads one folder, and of the rows those from the month's start to the range's end.

Openings are extended and repaired by signed rows, as batches of changes give them (``ChangeResult.delta``): a change in month m
moves the openings of the months after m by its amount, and only those folders are written again. Which folder holds a
month is a small table (month, folder), written last: a repair that fails leaves the old one in force, and one that is
run again replaces its own folders.

Rows without a date come before all others, as in an ascending order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import money as M
from ..functions.dates import iso_text
from ..session import list_folders, materialized, path_exists
from .running import running_total

#: The month number of rows without a date.
UNDATED = 0


def month_number(day: Column) -> Column:
    return F.coalesce(F.year(day) * 12 + F.month(day) - 1, F.lit(UNDATED)).cast("int")


def month_start(number: int) -> str:
    return f"{number // 12:04d}-{number % 12 + 1:02d}-01"


class MonthOpenings:
    """Openings below ``root`` for the non-null columns ``keys`` of rows (txn_date and what ``value`` reads)."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], value: Callable[[], Column]):
        self.spark, self.root, self.keys, self.value = spark, root.rstrip("/"), keys, value

    # ---- what is stored ------------------------------------------------------------------

    def _version(self) -> int:
        done = [int(n[8:]) for n in list_folders(self.spark, self.root) if n.startswith("version=") and path_exists(self.spark, f"{self.root}/{n}/months/_SUCCESS")]
        return max(done, default=-1)

    def months(self) -> dict[int, str]:
        """The folder of every stored month: one row a month."""
        version = self._version()
        if version < 0:
            return {}
        rows = self.spark.read.schema("month int, folder string").parquet(f"{self.root}/version={version}/months").collect()
        return {r.month: r.folder for r in rows}

    def _put(self, openings: DataFrame, kept: dict[int, str], last: int) -> None:
        """Store ``openings`` (month, keys, opening) as the next version, beside the months that are kept."""
        place = f"{self.root}/version={self._version() + 1}"
        openings.where(F.col("opening") != 0).repartition("month", *self.keys).write.mode("overwrite").partitionBy("month").parquet(f"{place}/openings")
        own = {int(n[6:]) for n in list_folders(self.spark, f"{place}/openings") if n.startswith("month=")}
        folders = kept | {m: f"{place}/openings/month={m}" for m in own}
        # The last month is named even where all its openings are zero: it tells how far the openings reach.
        folders.setdefault(last, "")
        self.spark.createDataFrame(sorted(folders.items()), "month int, folder string").coalesce(1).write.mode("overwrite").parquet(f"{place}/months")

    def _read(self, folders: list[tuple[int, str]], like: DataFrame | None = None) -> DataFrame | None:
        parts = None
        for month, folder in folders:
            if folder:
                part = self.spark.read.parquet(folder).withColumn("month", F.lit(month))
                parts = part if parts is None else parts.unionByName(part)
        return parts

    # ---- create, extend, repair -----------------------------------------------------------

    def _totals(self, rows: DataFrame, sign: Column) -> DataFrame:
        v = self.value().cast(M.WIDE) * sign.cast("decimal(3,0)")
        return rows.groupBy(*self.keys, month_number(F.col("txn_date")).alias("m")).agg(F.sum(v).cast(M.WIDE).alias("v")).where("v IS NOT NULL")

    def _openings(self, totals: DataFrame, first: int, last: int) -> DataFrame:
        """(month, keys, opening) for the months first to last from totals (keys, m, v): every month after one with a total."""
        order = Window.partitionBy(*self.keys).orderBy("m")
        sums = totals.withColumn("opening", F.sum("v").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast(M.WIDE))
        until = F.coalesce(F.lead("m").over(order), F.lit(last))
        since = F.greatest(F.col("m") + 1, F.lit(first))
        found = sums.withColumn("until", F.least(until, F.lit(last))).withColumn("since", since).where("since <= until")
        return found.select(F.explode(F.sequence("since", "until")).alias("month"), *self.keys, "opening")

    def _span(self, totals: DataFrame) -> tuple[int, int] | None:
        r = totals.agg(F.min(F.when(F.col("m") != UNDATED, F.col("m"))), F.max("m")).first()
        return None if r[1] is None else (r[0] if r[0] is not None else r[1], r[1])

    def create(self, rows: DataFrame) -> None:
        """Sum up all rows, once: the openings of every month after the first, one further than the last."""
        totals = materialized(self._totals(rows, F.lit(1)), "month-totals")
        span = self._span(totals) or (UNDATED, UNDATED)
        self._put(self._openings(totals, span[0], span[1] + 1), {}, span[1] + 1)

    def apply(self, changes: DataFrame) -> None:
        """Extend and repair by signed rows. Months up to the first changed one are neither read nor written."""
        months = self.months()
        if not months:
            raise FileNotFoundError(f"No openings at {self.root}")
        totals = materialized(self._totals(changes, F.col("sign")), "month-changes")
        lowest, span = totals.agg(F.min("m")).first()[0], self._span(totals)
        if lowest is None:
            return
        old_first, old_last = min(months), max(months)
        last = max(old_last, span[1] + 1)
        first = min(old_first, span[0] + 1) if lowest == UNDATED else lowest + 1
        moved = self._openings(totals, first, last).withColumnRenamed("opening", "more")
        stale = [(m, f) for m, f in months.items() if m >= first and (m != old_last or f)]
        old = self._read(stale)
        if old is not None and last > old_last:  # what was brought forward furthest goes on
            ends = old.where(F.col("month") == old_last).drop("month")
            old = old.unionByName(ends.select(F.explode(F.sequence(F.lit(old_last + 1), F.lit(last))).alias("month"), *self.keys, "opening")
                                  .select(*old.columns))
        if old is None:
            fresh = moved.withColumnRenamed("more", "opening")
        else:
            fresh = old.join(moved, ["month", *self.keys], "full_outer").select(
                "month", *self.keys, (F.coalesce("opening", F.lit(0)) + F.coalesce("more", F.lit(0))).cast(M.WIDE).alias("opening"))
        self._put(fresh, {m: f for m, f in months.items() if m < first}, last)

    # ---- statements ------------------------------------------------------------------------

    def _base(self, day: str) -> tuple[int | None, str]:
        """The month whose stored openings a statement from ``day`` on starts with, and its folder. None: nothing is before it."""
        months = self.months()
        number = int(day[:4]) * 12 + int(day[5:7]) - 1
        found = [m for m in months if m <= number]
        if not found:
            return None, ""
        # Months between the last stored one and the day have no openings of their own: rows since then are added up.
        at = number if number in months else max(months) if number > max(months) else number
        return at, months.get(at, "")

    def brought_forward(self, rows: DataFrame, day: str) -> DataFrame:
        """(keys, opening): balances of everything before ``day``. Of ``rows`` only those since the stored month's start are read."""
        at, folder = self._base(day)
        since = F.to_date(F.lit(month_start(at))) if at is not None else None
        before = rows.where(F.col("txn_date") < F.to_date(F.lit(day)))
        before = before.where(F.col("txn_date") >= since) if since is not None else rows.where(F.col("txn_date").isNull() | (F.col("txn_date") < F.to_date(F.lit(day))))
        found = before.select(*self.keys, self.value().cast(M.WIDE).alias("v"))
        stored = self._read([(at, folder)]) if folder else None
        if stored is not None:
            found = found.unionByName(stored.select(*self.keys, F.col("opening").alias("v")))
        return found.groupBy(*self.keys).agg(F.coalesce(F.sum("v"), F.lit(0)).cast(M.WIDE).alias("opening"))

    def statement(self, rows: DataFrame, start: str, end: str) -> DataFrame:
        """The rows from ``start`` to ``end`` with a running ``balance`` that goes on from what was brought forward, and a line of
        its own for every key that has a balance or rows (``txn_id`` null, ``txn_date`` the start)."""
        opening = self.brought_forward(rows, start)
        inside = rows.where(F.col("txn_date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
        lines = running_total(inside, self.value().cast(M.WIDE), "__sum", self.keys, "txn_date", "txn_id")
        lines = lines.join(opening, self.keys, "left").withColumn(
            "balance", (F.coalesce("opening", F.lit(0)) + F.coalesce("__sum", F.lit(0))).cast(M.WIDE)).drop("__sum", "opening")
        heads = opening.join(inside.select(*self.keys).distinct().withColumn("__has", F.lit(True)), self.keys, "full_outer")
        heads = heads.where(F.col("__has") | (F.col("opening") != 0)).select(
            *self.keys, F.to_date(F.lit(start)).alias("txn_date"), F.lit("Opening").alias("txn_type"), F.coalesce("opening", F.lit(0)).cast(M.WIDE).alias("balance"))
        return lines.unionByName(heads, allowMissingColumns=True)


def party_value() -> Column:
    """W1's sign: an exact ``Sale`` adds, everything else subtracts; a null amount counts 0."""
    amount = M.zero_if_null("amount")
    return F.when(F.col("txn_type") == "Sale", amount).otherwise(-amount)


def account_value() -> Column:
    """W3's sign: an exact ``Sale`` or ``Receipt`` comes in, everything else goes out."""
    amount = M.zero_if_null("amount")
    return F.when(F.coalesce(F.col("txn_type").isin("Sale", "Receipt"), F.lit(False)), amount).otherwise(-amount)


def accounts_of(rows: DataFrame) -> DataFrame:
    """``rows`` with the accounts they stand in: ``Cash``, ``Bank`` (its whole group) and ``UPI``, which is of that group too."""
    from ..functions import text as X

    named = [F.when(X.ci_eq("payment_mode", "Cash"), F.lit("Cash")), F.when(X.is_bank_group("payment_mode"), F.lit("Bank")),
             F.when(X.ci_eq("payment_mode", "UPI"), F.lit("UPI"))]
    return rows.withColumn("account", F.explode(F.filter(F.array(*named), lambda a: a.isNotNull())))


def statement_contract(lines: DataFrame, key: str) -> DataFrame:
    return lines.select(key, F.col("txn_id").alias("id"), iso_text("txn_date").alias("date"), F.col("txn_type").alias("type"),
                        M.to_double("amount").alias("amount"), M.to_double("balance").alias("balance"))
