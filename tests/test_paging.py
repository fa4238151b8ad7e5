"""Pages by the order-statistics index: equal to the offset form, and what they read."""

import datetime as dt
import re
import tempfile
from decimal import Decimal

import pytest

from tallyframe.operators import lists as R
from tallyframe.operators.paging import PageIndex
from tallyframe.sources.schemas import PARTIES, TRANSACTIONS


def _tx(spark, n):
    rows = [(k * 7919 % 10007, None if k % 41 == 0 else dt.date(2026, 1, 1 + k % 5), None, 1 + k % 3, "Sale", "Cash", Decimal(k)) for k in range(1, n + 1)]
    return spark.createDataFrame(rows, TRANSACTIONS), spark.createDataFrame([(1, "A", "a", "Customer", True), (2, "B", "b", None, True)], PARTIES)


@pytest.mark.parametrize("parts,limit", [(1, 10), (7, 10), (30, 7), (5, 1000)])
def test_pages_equal_the_offset_form(spark, parts, limit):
    tx, parties = _tx(spark, 200)
    index = PageIndex(spark, tempfile.mkdtemp(prefix="tf page ") + "/p")
    index.build(tx, parties, parts)
    total = R.joined_list(tx, parties).count()
    assert index.info(2, limit) == (2, limit, total, -(-total // limit))
    for page in {1, 2, max(1, total // limit // 2), -(-total // limit), -(-total // limit) + 1}:
        assert index.page(page, limit).collect() == R.transactions_page(tx, parties, page, limit).collect()


def test_a_page_reads_its_ranges_only(spark):
    tx, parties = _tx(spark, 400)
    index = PageIndex(spark, tempfile.mkdtemp(prefix="tf-page-") + "/p")
    index.build(tx, parties, 20)
    page = index.page(13, 10)
    plan = spark._jvm.PythonSQLUtils.explainString(page._jdf.queryExecution(), "formatted")
    wanted = re.search(r"PartitionFilters: \[(.*)\]", plan).group(1)
    assert len(set(re.findall(r"blk#\d+\w* (?:=|IN) \(?(\d+)", wanted))) <= 2 and "blk" in wanted
    assert "PushedFilters: [" in plan and "pos" in plan.split("PushedFilters: [")[1].split("]")[0]
    assert page.count() == 10


def test_empty_lists_and_wrong_numbers(spark):
    tx, parties = _tx(spark, 5)
    index = PageIndex(spark, tempfile.mkdtemp(prefix="tf-page-") + "/p")
    with pytest.raises(FileNotFoundError):
        index.page(1)
    index.build(tx.limit(0), parties)
    assert index.page(1).collect() == [] and index.info(1) == (1, 100, 0, 0)
    for bad in ((0, 10), (1, 0)):
        with pytest.raises(ValueError):
            index.page(*bad)
