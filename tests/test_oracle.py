"""Every registered bookkeeping query against its DuckDB oracle on the sf0.001 tables
(the driver runs the same comparison at sf0.01)."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from tallyframe.plans import catalog, oracle

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def _rows(rows):
    return sorted((tuple(_norm(x) for x in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_every_query_has_an_oracle():
    missing = set(catalog.registry()) - set(oracle.oracle_sql())
    assert not missing, missing
    assert set(catalog.registry()) <= set(E.queries()) and set(E.oracle_sql()) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[:2] == ["date", "opening_cash"]


@pytest.mark.parametrize("name", sorted(catalog.registry()))
def test_query_matches_oracle(spark, duck, name):
    sdf = catalog.registry()[name](spark, SF_SMALL)
    cols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    res = duck.execute(oracle.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(ocols)
    idx = [ocols.index(c) for c in cols]
    orows = [tuple(r[i] for i in idx) for r in res.fetchall()]
    assert len(srows) == len(orows)
    assert _rows(srows) == _rows(orows)
