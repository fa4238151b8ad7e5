"""The trigram index against the scanning search, and how much of the list it reads."""

import random
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import lists as R
from tallyframe.operators.search_index import SearchIndex
from tallyframe.sources.schemas import PARTIES, TRANSACTIONS


def _books(spark, n=400):
    import datetime as dt
    from decimal import Decimal

    rng = random.Random(3)
    rows = [(k, None if k % 17 == 0 else dt.date(2026, 1 + k % 9, 1 + k % 27), rng.choice([None, f"INV-{k}", "Ünï-ß", 'a%_"\\']), 1 + k % 4,
             rng.choice(["Sale", "expense", None]), rng.choice(["GPay", "Cash", None]), None if k % 13 == 0 else Decimal(k) / 4) for k in range(1, n)]
    parties = [(1, "Smith & Co", "s", "Customer", True), (2, "Ångström", "a", None, True), (3, None, "n", None, True)]
    return spark.createDataFrame(rows, TRANSACTIONS), spark.createDataFrame(parties, PARTIES)


def test_same_rows_as_the_scan(spark):
    tx, parties = _books(spark)
    index = SearchIndex(spark, tempfile.mkdtemp(prefix="tf search ") + "/s", block_ids=8, blocks_per_part=4)
    with pytest.raises(FileNotFoundError):
        index.search("abc")
    index.build(tx, parties)
    for text in ("gpay", "GPAY", "inv-37", "smith & co", "th &", "ångström", "ünï", "ß", "null", "01-2026", ".25", "7.5", "", "x", "no such text", 'a%_"\\', "payinv", "INV-INV"):
        want, got = R.search(tx, parties, text).collect(), index.search(text).collect()
        assert sorted(map(str, got)) == sorted(map(str, want)), text
    empty = SearchIndex(spark, tempfile.mkdtemp(prefix="tf-search-") + "/s")
    empty.build(tx.limit(0), parties)
    assert empty.search("gpay").collect() == []


def test_a_rare_text_reads_few_folders(spark):
    tx, parties = _books(spark, 2000)
    index = SearchIndex(spark, tempfile.mkdtemp(prefix="tf-search-") + "/s", block_ids=8, blocks_per_part=4)
    index.build(tx, parties)
    bill = tx.where("bill_no LIKE 'INV-1___' AND party_id < 4").orderBy("txn_id").first().bill_no
    found = index.search(bill)
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    scan = next(b for b in plan.split("\n\n") if "/rows]" in b)
    wanted = re.search(r"PartitionFilters: \[(.*)\]", scan).group(1)
    folders = {r.part for r in index._rows().select("part").distinct().collect()}
    read = [p for p in folders if re.search(rf"\b{p}\b", re.sub(r"#\d+", "", wanted))]
    assert len(folders) > 50 and 1 <= len(read) <= len(folders) / 5
    lists = next(b for b in plan.split("\n\n") if "/grams]" in b)
    assert "shard" in lists.split("PartitionFilters: [")[1].split("]")[0] and "gram" in lists.split("PushedFilters: [")[1].split("]")[0]
    assert found.count() == R.search(tx, parties, bill).count() >= 1


def test_a_larger_table_has_more_tasks_of_lists(spark):
    def lists(n, name):
        tx, parties = _books(spark, n)
        index = SearchIndex(spark, tempfile.mkdtemp(prefix="tf-search-") + "/s", block_ids=8, blocks_per_part=4, task_rows=32, blocks_per_run=16)
        index.build(tx, parties)
        for text in ("inv-37", "smith & co"):
            assert sorted(map(str, index.search(text).collect())) == sorted(map(str, R.search(tx, parties, text).collect())), (name, text)
        stored = spark.read.parquet(f"{index.root}/grams")
        assert stored.count() == stored.select("gram", "part", "block").distinct().count()
        assert stored.where("part != block DIV 4").count() == 0
        files = stored.select("shard", "block", F.input_file_name().alias("file"))
        writers = files.select(F.regexp_extract("file", r"/part-(\d+)-", 1)).distinct().count()
        return writers, files.groupBy("shard").agg(F.countDistinct("file").alias("n")).agg(F.max("n")).first()[0]

    (few, one), (many, runs) = lists(120, "small"), lists(1200, "large")
    assert one <= 2 and runs >= 4  # a shard's list is cut into runs of blocks
    assert many >= 3 * few
