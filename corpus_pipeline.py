"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

1. quality rules (rejected documents go), 2. exact dedup (the smallest id of equal texts stays),
3. MinHash near-dedup (Jaccard of five-word shingles 0.8 or more; one document of each group stays),
4. mixing sources to target weights (documents stand as often as their leaf's epochs take them; the
budget is large enough that each stands at least once),
5. BPE encoding and decoding.

Stages 1 to 4 return the columns of their input; the last returns doc_id, lang, source, n_tokens,
ids, and the digest of the text that the ids decode to. Null ids, empty texts, repeated rows, empty
tables and extra columns are treated as each operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import bpe, exact_dedup, mixing, near_dedup, quality_rules
from tallyframe.llm.common import work_path

#: Near copies of the stage: Jaccard of five-word shingles of 0.8 or more (``op10_near_dedup`` has a contract of its own).
NEAR_WORDS, NEAR_PERCENT = 5, 80


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(docs)


def stage_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def stage_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_copies(docs, words=NEAR_WORDS, percent=NEAR_PERCENT)


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs, whole=True, **mixing.query_weights())


def stage_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = bpe.encode_documents(docs, bpe.default_tokenizer(), ("doc_id", "lang", "source"))
    return found.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", stage_quality),
    ("exact dedup", stage_exact),
    ("near dedup", stage_near),
    ("mixing", stage_mix),
    ("bpe", stage_encode),
]

#: Tokenizer encoding has no SQL form; tests/llm checks run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = work_path(spark, f"stage-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
