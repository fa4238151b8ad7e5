"""Running totals, numbering and previous values that stay parallel when one account, day or party is very large.

A plain ``sum(x).over(Window.partitionBy(p).orderBy(date, id))`` sends every row of a partition to one task, and with no
``partitionBy`` the whole table. Here a partition of at most ``hot_rows`` rows takes that window; larger ones are *ranged*:

1. the rows are range-partitioned and sorted by (partition, order) and written once with their place, so every later step
   sees the same ranges; a range is a block, and there are as many as the rows need;
2. totals per (partition, block), one row each, whose window gives the carry of the blocks before;
3. rows join their carry and add a window sum inside (partition, block).

A whole-account balance has days for partitions: day totals (bounded by the calendar) carry from day to day. Numbers need
no window over rows at all: a row's number is the count of the blocks before it and its place in its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialized

HOT_ROWS = 1 << 20
#: Bits of a row's place in ``monotonically_increasing_id``; the number of its partition stands above them.
PLACE_BITS = 33


def ranged(df: DataFrame, keys: list[str], parts: int | None = None, name: str = "ranged") -> DataFrame:
    """``df`` in order of ``keys`` over ``parts`` ranges (Spark's own number, if not given), written once, with ``__blk`` (the
    range) and ``__pos`` (the row's place in it)."""
    x = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
    x = x.sortWithinPartitions(*keys).withColumn("__mid", F.monotonically_increasing_id())
    x = materialized(x, name)
    return x.withColumn("__blk", F.shiftright("__mid", PLACE_BITS)).withColumn(
        "__pos", F.col("__mid").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))).drop("__mid")


def _before(by: list[str], order: list[str]) -> Window:
    w = Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)
    return w.rowsBetween(Window.unboundedPreceding, -1)


def _ranged_total(x: DataFrame, v: str, out: str, keys: list[str], order: list[str], parts: int | None) -> DataFrame:
    """The levels above for the partitions ``keys``."""
    r = ranged(x, [*keys, *order], parts, "running-rows")
    sums = r.groupBy(*keys, "__blk").agg(F.sum(v).alias("__sum"))
    carry = sums.select(*keys, "__blk", F.sum("__sum").over(_before(keys, ["__blk"])).alias("__carry"))
    inside = Window.partitionBy(*keys, "__blk").orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = r.join(carry, [*keys, "__blk"])
    total = F.coalesce(F.col("__carry"), F.lit(0)) + F.sum(v).over(inside)
    return rows.withColumn(out, total.cast(_sum_type(x, v))).drop("__blk", "__pos", "__carry")


def _sum_type(x: DataFrame, v: str):
    return x.select(F.sum(v).alias("s")).schema["s"].dataType


def _total(x: DataFrame, v: str, out: str, keys: list[str], order: list[str], sizes: DataFrame, hot_rows: int,
           parts: int | None) -> DataFrame:
    """Running sums of ``v`` inside the partitions ``keys`` (non-null); ``sizes`` has their rows as ``__n``."""
    # At most rows / hot_rows partitions are hot, so their keys are few: they are broadcast.
    hot = F.broadcast(sizes.where(F.col("__n") > hot_rows).select(*keys))
    found = hot.limit(1).count() > 0
    cold = x.join(hot, keys, "left_anti") if found else x
    plain = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    cold = cold.withColumn(out, F.sum(v).over(plain))
    if not found:
        return cold
    split = _ranged_total(x.join(hot, keys, "left_semi"), v, out, keys, order, parts)
    return cold.unionByName(split.select(*cold.columns))


def _dated(x: DataFrame, date_col: str) -> tuple[DataFrame, list[str]]:
    """``x`` with two non-null columns in the order of ``date_col``, nulls first, and their names."""
    day = F.coalesce(F.col(date_col), F.lit("1970-01-01").cast(x.schema[date_col].dataType))
    return x.withColumn("__dated", F.col(date_col).isNotNull()).withColumn("__day", day), ["__dated", "__day"]


def running_total(df: DataFrame, value: Column, out: str, partition_by: list[str], date_col: str,
                  id_col: str, hot_rows: int = HOT_ROWS, parts: int | None = None) -> DataFrame:
    """Add ``out`` = sum of ``value`` over the rows of the same partition up to this row, ordered by (``date_col``,
    ``id_col``); ``id_col`` must be unique and non-null within a partition, ``partition_by`` columns non-null;
    null dates come first. Without ``partition_by`` the whole table is one account. One aggregate runs when called: it
    finds the hot partitions, and gives a whole account its day totals."""
    v = "__v"
    x, day = _dated(df.withColumn(v, value), date_col)
    if partition_by:
        sizes = x.groupBy(*partition_by).agg(F.count(F.lit(1)).alias("__n"))
        return _total(x, v, out, partition_by, [*day, id_col], sizes, hot_rows, parts).drop(v, *day)
    days = x.groupBy(*day).agg(F.sum(v).alias("__sum"), F.count(F.lit(1)).alias("__n"))
    days = materialized(days, "day-totals")  # one row a day
    carry = days.select(*day, F.coalesce(F.sum("__sum").over(_before([], day)), F.lit(0)).alias("__carry"))
    rows = _total(x, v, "__inside", day, [id_col], days, hot_rows, parts).join(carry, day)
    total = (F.col("__carry") + F.col("__inside")).cast(_sum_type(x, v))
    return rows.withColumn(out, total).drop(v, "__inside", "__carry", *day)


def dense_number(df: DataFrame, order_col: str, out: str, start: Column | int = 0, parts: int | None = None) -> DataFrame:
    """``out`` = start + 1, start + 2, ... in ``order_col`` order (unique, non-null). The rows are written once when called, in
    that order; ``df`` is read twice (once for the cuts of the ranges): hand in a written table when its plan is costly."""
    r = ranged(df, [order_col], parts, "numbered-rows")
    before = r.groupBy("__blk").agg(F.count(F.lit(1)).alias("__n")).select(
        "__blk", F.coalesce(F.sum("__n").over(_before([], ["__blk"])), F.lit(0)).alias("__before"))
    base = start if isinstance(start, Column) else F.lit(start)
    number = (base + F.col("__before") + F.col("__pos") + 1).cast("long")
    return r.join(before, "__blk").withColumn(out, number).drop("__blk", "__pos", "__before")


def number_where(df: DataFrame, cond: Column, order_col: str, out: str, start: Column | int = 0,
                 parts: int | None = None) -> DataFrame:
    """W6 over a mixed batch: rows where ``cond`` holds get start + 1, start + 2, ... in ``order_col`` order; the other
    rows keep ``out`` null. Hand in a written table: it is read for either kind."""
    ok = F.coalesce(cond, F.lit(False))
    rest = df.where(~ok).withColumn(out, F.lit(None).cast("long"))
    return dense_number(df.where(ok), order_col, out, start, parts).unionByName(rest)


def previous_value(df: DataFrame, partition_by: list[str], order_col: str, value_col: str, out: str,
                   hot_rows: int = HOT_ROWS, parts: int | None = None) -> DataFrame:
    """``out`` = ``value_col`` of the previous row (by ``order_col``, unique) of the same partition (non-null columns), null
    for the first. Hot partitions are ranged: a lag inside blocks, and for a block's first row the last value of the
    block before it. ``df`` is read twice; hand in a written table when its plan is costly."""
    hot = F.broadcast(df.groupBy(*partition_by).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot_rows).select(*partition_by))
    found = hot.limit(1).count() > 0
    cold = df.join(hot, partition_by, "left_anti") if found else df
    cold = cold.withColumn(out, F.lag(value_col).over(Window.partitionBy(*partition_by).orderBy(order_col)))
    if not found:
        return cold
    r = ranged(df.join(hot, partition_by, "left_semi"), [*partition_by, order_col], parts, "previous-rows")
    keys = [*partition_by, "__blk"]
    last = r.groupBy(*keys).agg(F.max_by(value_col, "__pos").alias("__last"))
    carry = last.select(*keys, F.lag("__last").over(Window.partitionBy(*partition_by).orderBy("__blk")).alias("__carry"))
    inside = Window.partitionBy(*keys).orderBy("__pos")
    rows = r.join(carry, keys).withColumn(out, F.when(F.row_number().over(inside) == 1, F.col("__carry"))
                                          .otherwise(F.lag(value_col).over(inside)))
    return cold.unionByName(rows.select(*cold.columns))
