"""The pipeline's mixing stage leaves no document out; its quotas against the query's SQL at the stage's budget."""

from collections import defaultdict

import duckdb

import corpus_pipeline
from tallyframe.llm import mixing

from .common_fixtures import empty_documents

SF = "/root/testdata/sf0.01"


def _budget(leaves: dict[tuple, int]) -> int:
    """By plain Python: the least whole rate of each node that gives all its children what they need."""
    need, cap = dict(leaves), {k: mixing.MAX_EPOCHS * t for k, t in leaves.items()}
    for weights in ({}, mixing.LANGUAGE_WEIGHTS, mixing.DOMAIN_WEIGHTS):
        children, up_need, up_cap = defaultdict(list), {}, {}
        for k in need:
            children[k[:-1]].append(k)
        for parent, of in children.items():
            rate = max(-(-need[k] // weights.get(k[-1], 1)) for k in of)
            up_need[parent] = sum(min(cap[k], rate * weights.get(k[-1], 1)) for k in of)
            up_cap[parent] = sum(cap[k] for k in of)
        need, cap = up_need, up_cap
    return need[()]


def at_whole_budget(con, table: str) -> str:
    """The CTEs of the query's SQL with the stage's budget for ``table``."""
    leaves = con.execute("WITH " + mixing.MIX_CTES.replace("{src}", table) + " SELECT domain, lang, source, tokens FROM mx_leaves").fetchall()
    own = f"(SELECT sum(tokens)::BIGINT * {mixing.BUDGET_SHARE} // 1000 FROM mx_leaves)"
    assert mixing.MIX_CTES.count(own) == 1
    return mixing.MIX_CTES.replace(own, str(_budget({r[:3]: r[3] for r in leaves})))


def test_every_document_stands_at_least_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = defaultdict(int)
    for r in corpus_pipeline.stage_mix(spark, docs, SF).select("doc_id").collect():
        got[r.doc_id] += 1
    con = duckdb.connect()
    con.execute(f"CREATE TABLE documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = dict(con.execute("WITH " + at_whole_budget(con, "documents").replace("{src}", "documents") + " SELECT doc_id, copies FROM mix").fetchall())
    assert got == want and min(want.values()) >= 1 and max(want.values()) <= mixing.MAX_EPOCHS
    assert len(want) == docs.count()


def test_budget_of_an_empty_table_is_nothing(spark):
    assert mixing.mix_documents(empty_documents(spark), whole=True, **mixing.query_weights()).collect() == []
