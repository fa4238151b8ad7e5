"""The field is fitted in one task; only its weights come to the driver, and the sample's lines are bounded."""

import random

import numpy as np
from pyspark.sql import functions as F

from tallyframe.llm import line_crf

from .common_fixtures import SCHEMA

WEIGHTS = ("own", "before", "after", "chain")


def _tables(spark):
    rows = [(k, "\n".join(f"{'good words here, of number' if k % 2 else '### $$$ BUY !!!'} {j}" for j in range(3 + k % 5)), "en", "s", 1) for k in range(40)]
    rows.append((50, "\n".join(["one of very many lines"] * 5000), "en", "s", 1))
    return spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame([(r[0], r[0] % 2) for r in rows], "doc_id long, quality int"), rows


def _fitted(rows):
    return line_crf.fit_sample([(r[0] % 2, line_crf.line_features([r[1].encode()])[0].tobytes()) for r in rows], 15)


def test_task_fits_what_the_driver_would(spark, monkeypatch):
    docs, labels, rows = _tables(spark)
    want = _fitted(rows)

    def here(*args, **kwargs):
        raise AssertionError("fitted on the driver")

    monkeypatch.setattr(line_crf, "fit", here)
    got = line_crf.train(docs, labels, rounds=15)
    assert got.prior == want.prior and all(np.allclose(getattr(got, w), getattr(want, w)) for w in WEIGHTS)


def test_sample_is_bounded_by_lines(spark):
    docs, labels, rows = _tables(spark)
    assert np.allclose(line_crf.train(docs, labels, rounds=15, lines=1000).own, _fitted(rows[:-1]).own)
    few = line_crf.train(docs, labels, rounds=15, lines=60)
    order = [r.doc_id for r in labels.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    by, taken, room = {r[0]: r for r in rows}, [], 60
    for i in order:
        n = by[i][1].count("\n") + 1
        if n <= room:
            taken.append(by[i])
            room -= n
    assert 0 < len(taken) < 40 and np.allclose(few.own, _fitted(sorted(taken)).own)
    assert line_crf.score(docs, few).count() == len(rows)


def test_null_ids_and_repeated_ids_of_other_texts(spark, tmp_path):
    rows = [(k, f"Plain words of line {k}.\n" * (1 + k % 4) if k % 2 else "BUY!! NOW!! ***\n### $$$\n", "en", "s", 1) for k in range(60)]
    rows += [(k, "Another text under the same id, of some length.\nAnd more of it.\n", "en", "s", 1) for k in range(0, 60, 3)] + [(None, "no id", "en", "s", 1), (None, None, "en", "s", 1)]
    labels = [(k, k % 2, 0) for k in range(60)] + [(3, 0, 0), (None, 1, 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    found = []
    for seed in (1, 2):
        folder = tmp_path / str(seed)
        docs = spark.createDataFrame(random.Random(seed).sample(rows, len(rows)), schema).repartition(seed + 2)
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        got = line_crf.op2_line_crf(spark, str(folder)).collect()
        assert len(got) == len(rows) and all(isinstance(r.held_out, bool) and 0 <= r.score <= 1 for r in got)
        assert {r.held_out for r in got if r.doc_id is None} == {False}
        found.append(sorted((str(r.doc_id), r.held_out, round(r.score, 9), r.predicted) for r in got))
    assert found[0] == found[1]
