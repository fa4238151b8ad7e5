"""The pipeline against a brute-force version over the whole documents table of the smallest data set."""

import hashlib
import re
from collections import Counter

import duckdb
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tallyframe.llm import quality_rules
from tallyframe.llm.common import work_path

from .common_fixtures import SF, empty_documents, five_words, odd_documents
from .test_mixing_whole import at_whole_budget


def _brute(con) -> list[tuple]:
    """Rules and mixing as SQL (at the stage's budget), the rest in plain Python: near copies by five words and 0.8."""
    sql = lambda ctes, tail: con.execute("WITH " + ctes.replace("{src}", "docs") + tail).fetchall()
    con.execute(f"CREATE TABLE docs AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    kept = {r[0] for r in sql(quality_rules.VERDICT_CTES, " SELECT doc_id FROM verdict WHERE kept")}
    text = {i: t or "" for i, t in con.execute("SELECT doc_id, text FROM docs").fetchall() if i in kept}
    first = {}
    for i in sorted(text):
        first.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", text[i]), i)
    text = {i: text[i] for i in first.values()}
    text = {i: text[i] for i, (_, c) in five_words(text).items() if c == i}
    con.execute("DELETE FROM docs WHERE NOT list_contains(?, doc_id)", [list(text)])
    copies = dict(con.execute("WITH " + at_whole_budget(con, "docs").replace("{src}", "docs") + " SELECT doc_id, copies FROM mix").fetchall())
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = []
    for i, lang, source in con.execute("SELECT doc_id, lang, source FROM docs").fetchall():
        ids = tokenizer.encode(text[i], add_special_tokens=False).ids
        sha = hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        out += [(i, lang, source, len(ids), tuple(ids), sha)] * copies[i]
    return sorted(out)


def test_run_equals_brute_force(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    got = sorted((r.doc_id, r.lang, r.source, r.n_tokens, tuple(r.ids), r.decoded_sha256) for r in rows)
    assert got == _brute(duckdb.connect())
    assert len({r[0] for r in got}) > 50


def test_stages_keep_columns_and_take_odd_rows(spark):
    """Every stage on odd rows, by its rows: what is rejected, what is a copy, how often what is left stands."""
    docs = odd_documents(spark, repeats=True)
    columns, kept, texts_before = docs.columns, [], None
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = work_path(spark, "test-stage")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        rows = docs.collect()
        kept.append(sorted((r.doc_id is None, r.doc_id or 0) for r in rows))
        if k < 4:
            assert docs.columns == columns and all(r.kept == "mine" for r in rows)
        if k == 3:
            texts_before = Counter((r.doc_id, r.lang, r.source) for r in rows)
    quality, exact, near, mixed, coded = ({i for _, i in k} for k in kept)
    assert not quality & {4, 5, 6, 9, 10, 11, 12, 13}  # too few words, repeated words, symbols
    assert {1, 2, 3, 8, 14} <= quality and 2 not in exact and {1, 3, 8, 14} <= exact
    assert 3 not in near and len(kept[2]) == len(set(kept[2]))  # a near copy goes, repeated rows are one
    assert near == mixed == coded and len(kept[3]) >= len(kept[2])
    assert Counter((r.doc_id, r.lang, r.source) for r in docs.collect()) == texts_before


def test_stages_on_an_empty_table(spark):
    docs = empty_documents(spark)
    for _, stage in corpus_pipeline.STAGES:
        path = work_path(spark, "test-stage")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.count() == 0
