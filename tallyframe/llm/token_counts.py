"""Operator 4, token counts with a digest cache.

Counts are stored under (digest of the normalised content, digest of the tokenizer version).
Normalising means null becomes the empty text; nothing else may change, for the counts must be
the library's. A run digests all texts, joins the digests to the stored counts, encodes each
distinct content that has none once, appends those counts to the cache, and joins the
cache to all documents.

Scale: only digests are shuffled. The row to encode of each content is named by its place in the input's files, and the
task that reads the file picks it; copies never reach the encoder. The cache is a Parquet folder with
one subfolder a tokenizer version, so a run reads only its version; appends go through Spark's
committer, so a lost executor or a repeated task leaves no half-written counts, and counts that
two runs both append are read once.

Cases: null and empty text have 0 tokens; repeated rows each get a result row; null ids are
kept; an empty table gives an empty result and an empty append.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PLACE, documents, placed, places_written, rows_at, text_or_empty, work_path, written
from .pieces import BYTE_LEVEL, PieceCache, text_slices

CACHE_SCHEMA = T.StructType([T.StructField("content", T.BinaryType()), T.StructField("n_tokens", T.LongType())])


class Counter:
    """Token counts as the library gives them; distinct pre-tokens are encoded once a task."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        specials = tuple(t.content for t in self.library.get_added_tokens_decoder().values())
        self.cache = PieceCache(BYTE_LEVEL, self._sizes, specials, lower=False)

    def _sizes(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        split = self.cache.pieces(texts)
        known = self.cache.known
        whole = iter(self._sizes([t for t, words in zip(texts, split, strict=True) if words is None]))
        return [next(whole) if words is None else sum(map(known.__getitem__, words)) for words in split]


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file and of the library's version."""
    import tokenizers

    return hashlib.sha256(open(path, "rb").read() + tokenizers.__version__.encode()).hexdigest()


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    """The counts in the cache, one row a content; none where the folder does not exist yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(folder).dropDuplicates(["content"])


def count_tokens(docs: DataFrame, tokenizer: str, cache: str) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row of ``docs``; ``cache`` is the cache's folder."""
    spark = docs.sparkSession
    folder = f"{cache.rstrip('/')}/tokenizer={tokenizer_version(tokenizer)}"
    digest = F.unhex(F.sha2(F.col("_text").cast("binary"), 256))
    rows = placed(docs, "count-rows").select("doc_id", text_or_empty().alias("_text"), *PLACE).withColumn("content", digest)
    digests = written(rows.select("doc_id", "content", F.octet_length("_text").cast("long").alias("n_bytes"), *PLACE), "content-digests")
    # One row to encode for each content without a count; the task that reads its file picks it.
    missing = digests.groupBy("content").agg(F.min(F.struct(*PLACE)).alias("at")).join(_stored(spark, folder), "content", "left_anti")
    chosen = places_written(missing.select("at.*"), "count-misses")

    def encode(batches):
        tokens = counter(tokenizer)
        for batch in batches:
            for part, texts in text_slices(batch, "_text"):
                yield pa.RecordBatch.from_arrays([part.column("content"), pa.array(tokens.count(texts), pa.int64())], ["content", "n_tokens"])

    counted = rows_at(rows.select("content", "_text", *PLACE), chosen, then=encode, schema=CACHE_SCHEMA)
    counted.write.mode("append").parquet(folder)
    counts = written(_stored(spark, folder), "token-counts")  # a table of its own, so that a hot content's rows can be split
    return digests.join(counts, "content", "left").select("doc_id", "n_bytes", "n_tokens")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's count; this query starts from an empty cache of its own."""
    counts = count_tokens(documents(spark, sf_dir), default_tokenizer(), work_path(spark, "token-cache"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)
