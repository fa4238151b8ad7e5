"""The pipeline's near-dedup stage by its own rule (five words, 0.8) against brute force; the query keeps three words and 85."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyframe.llm import exact_dedup, near_dedup

from .common_fixtures import SCHEMA, five_words

MID = "/root/testdata/sf0.01"


def test_stage_equals_five_word_brute_force(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    want = five_words({r.doc_id: r.text or "" for r in docs.collect()})
    kept = corpus_pipeline.stage_near(spark, docs, MID)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(i for i, (_, c) in want.items() if i == c)


def test_pairs_between_the_two_rules(spark):
    rng = random.Random(2)
    base = [f"w{k}" for k in range(400)]
    texts = [" ".join(base)]
    for k in range(40):  # long ones with a passage changed, and short ones of which each sketch holds the whole set
        words = list(base)
        at, n = rng.randrange(300), rng.randint(20, 60)
        words[at : at + n] = [f"x{k}-{j}" for j in range(n)]
        texts.append(" ".join(words))
    for k in range(40):
        words = [f"v{j}" for j in range(40)]
        words[rng.choice((0, 1, 38, 39))] = f"y{k}"
        texts.append(" ".join(words))
    texts += ["one two three four", "One two three four", "one two three five", ""]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = five_words(dict(enumerate(texts)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_groups(docs, words=5, percent=80).collect()}
    assert got == want


def test_bounds_follow_from_the_rule():
    assert near_dedup.Rule() == near_dedup.Rule(3, 85) and near_dedup.Rule().shared == 36
    assert near_dedup.Rule(5, 80).shared == 31
    for words, percent in ((0, 80), (5, 0), (5, 101), (5, 1)):
        with pytest.raises(ValueError):
            near_dedup.Rule(words, percent).shared


def test_sets_that_share_half_a_digest_stay_apart(spark, monkeypatch):
    """Digests whose first 64 bits are all the same: classes are told apart by the other half."""
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(30)}" for _ in range(rng.randint(1, 40))) for _ in range(60)]
    texts += texts[:20] + [t + " more" for t in texts[20:30]]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], SCHEMA).repartition(4)
    want = five_words(dict(enumerate(texts)))
    real = near_dedup._sketched
    monkeypatch.setattr(near_dedup, "_sketched", lambda d, r: real(d, r).withColumn("cid", F.when(F.col("n") > 0, 7).otherwise(0).cast("long")))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_groups(docs, words=5, percent=80).collect()}
    assert got == want


def test_rows_without_id_keep_their_own_texts(spark):
    rows = [(None, f"only row {k} of its kind with words {k} {k + 1} {k + 2}", "en", "s", 1) for k in range(30)]
    docs = spark.createDataFrame(rows + rows[:3], SCHEMA).repartition(5)
    got = near_dedup.near_groups(docs).collect()
    assert len(got) == 33 and {r.component_id for r in got} == {None}
    assert exact_dedup.drop_copies(docs).count() == 30
