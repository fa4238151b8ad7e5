"""Ranged running sums, dense numbering and previous values against plain windows."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyframe.operators.running import dense_number, number_where, previous_value, ranged, running_total


def _data(spark, n=600, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        # one hot party with a third of the rows, a few days, some null dates
        p = 1 if rnd.random() < 0.34 else rnd.randint(2, 9)
        d = None if rnd.random() < 0.03 else f"2024-01-{rnd.randint(1, 5):02d}"
        rows.append((p, d, i * 3 + rnd.randint(0, 2), rnd.randint(-500, 500)))
    return spark.createDataFrame(rows, "p long, d string, id long, v long").withColumn("d", F.to_date("d"))


def test_running_total_matches_window(spark):
    df = _data(spark)
    for parts in (None, 2, 16):
        got = running_total(df, F.col("v"), "bal", ["p"], "d", "id", hot_rows=40, parts=parts)
        w = Window.partitionBy("p").orderBy(F.col("d").asc_nulls_first(), "id").rowsBetween(Window.unboundedPreceding, 0)
        want = df.withColumn("bal", F.sum("v").over(w))
        assert sorted(got.collect(), key=repr) == sorted(want.select(*got.columns).collect(), key=repr)


def test_running_total_whole_account(spark):
    df = _data(spark)
    w = Window.orderBy(F.col("d").asc_nulls_first(), "id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("bal", F.sum("v").over(w))
    for options in ({}, {"hot_rows": 100, "parts": 5}, {"hot_rows": 0, "parts": 40}):  # no day, some days, all days ranged
        got = running_total(df, F.col("v"), "bal", [], "d", "id", **options)
        assert sorted(got.collect(), key=repr) == sorted(want.select(*got.columns).collect(), key=repr)


def test_ranges_grow_with_the_rows(spark):
    """A block is a range of rows as Spark sizes partitions, so more partitions give smaller blocks, none empty-handed."""
    df = spark.range(0, 4000).select((F.col("id") * 7919 % 4001).alias("id"))
    for parts in (4, 40):
        r = ranged(df, ["id"], parts)
        blocks = r.groupBy("__blk").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"),
                                        F.max("__pos").alias("last")).orderBy("__blk").collect()
        assert len(blocks) == parts and all(b.n < 3 * 4000 / parts and b.last == b.n - 1 for b in blocks)
        assert all(a.hi < b.lo for a, b in zip(blocks, blocks[1:]))


def test_empty_tables(spark):
    df = _data(spark).limit(0)
    assert running_total(df, F.col("v"), "bal", [], "d", "id").collect() == []
    assert running_total(df, F.col("v"), "bal", ["p"], "d", "id").collect() == []
    assert dense_number(df, "id", "n").collect() == [] and previous_value(df, ["p"], "id", "v", "prev").collect() == []


def test_number_where(spark):
    df = _data(spark)
    got = {r.id: r.n for r in number_where(df, F.col("v") > 0, "id", "n", start=10, parts=6).collect()}
    ok = sorted(r.id for r in df.where("v > 0").collect())
    assert {i: n for i, n in got.items() if n is not None} == {i: 11 + k for k, i in enumerate(ok)} and len(got) == df.count()


def test_dense_number(spark):
    df = _data(spark)
    got = dense_number(df, "id", "n", start=100, parts=8).select("id", "n").collect()
    ids = sorted(r.id for r in got)
    expect = {i: 101 + k for k, i in enumerate(ids)}
    assert all(r.n == expect[r.id] for r in got)


def test_previous_value(spark):
    df = _data(spark).withColumn("val", F.col("v").cast("string"))
    want = df.select("id", F.lag("val").over(Window.partitionBy("p").orderBy("id")).alias("prev")).collect()
    for options in ({}, {"hot_rows": 60, "parts": 8}, {"hot_rows": 0}):
        got = previous_value(df, ["p"], "id", "val", "prev", **options).select("id", "prev").collect()
        assert sorted(got, key=repr) == sorted(want, key=repr)
