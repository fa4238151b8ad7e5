"""Continuous import of CSV files dropped into a folder (Structured Streaming).

The stream reads the ``import_files`` source: names come from each file's own header, large files are ranges over several
tasks, and which files a batch has is logged before it runs. Each micro-batch runs the import pipeline (M11) against the
parties known so far -- the base table plus parties created by earlier batches -- and writes its accepted rows, created
parties, rejects, files and last ids below ``batch_id=<n>`` folders with overwrite. A replayed batch therefore rewrites
exactly its own output (exactly-once at the sink), and reads of "earlier batches" prune to ``batch_id < n``.

A file whose bytes were imported before, under whatever name, is not imported again: ``files`` keeps a digest of each.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.importing import import_transactions
from ..session import materialized, path_exists
from ..sources.import_files import RANGE_BYTES, numbered, register, resolved

STATE = T.StructType([T.StructField("last_party", T.LongType()), T.StructField("last_txn", T.LongType())])
FILES = T.StructType([T.StructField("file", T.StringType()), T.StructField("file_no", T.LongType()), T.StructField("digest", T.StringType()),
                      T.StructField("records", T.LongType()), T.StructField("same_as", T.StringType())])
OUTPUTS = ("accepted", "parties", "rejected", "files", "state")


def _earlier(spark: SparkSession, path: str, batch_id: int, schema: T.StructType) -> DataFrame:
    """The rows of earlier batches; none where nothing has been written yet."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    with_batch = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    return spark.read.schema(with_batch).parquet(path).where(F.col("batch_id") < batch_id).drop("batch_id")


def _put(df: DataFrame, path: str, batch_id: int) -> None:
    (df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id").parquet(path))


def file_digests(raw: DataFrame) -> DataFrame:
    """(file, file_no, digest) of written rows of the source. A file's digest is the sums of two halves of its ranges' digests,
    each taken with its place, so a file of any number of ranges combines map-side."""
    placed = F.sha2(F.concat_ws(":", "part", "digest"), 256)
    half = lambda at: F.sum(F.conv(F.substring(placed, at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    marks = raw.where("ends IS NOT NULL AND state = 0")
    return marks.groupBy("file", "file_no").agg(F.concat_ws(":", half(1), half(16), F.count(F.lit(1)).cast("string")).alias("digest"))


def told_apart(files: DataFrame, before: DataFrame) -> DataFrame:
    """``files`` with ``same_as``: the file of the same bytes in ``before`` or earlier in the batch, null for the first."""
    first = files.groupBy("digest").agg(F.min(F.struct("file_no", "file")).alias("__first"))
    known = before.groupBy("digest").agg(F.min(F.struct("file_no", "file")).alias("__known"))
    j = files.join(first, "digest").join(known, "digest", "left")
    same = F.when(F.col("__known").isNotNull(), F.col("__known.file")).when(F.col("__first.file_no") != F.col("file_no"), F.col("__first.file"))
    return j.select("file", "file_no", "digest", same.alias("same_as"))


def start_stream_import(spark: SparkSession, drop_dir: str, parties: DataFrame, transactions: DataFrame, out_dir: str,
                        checkpoint_dir: str, pivot_year: int | None = None, files_per_batch: int = 1000,
                        available_now: bool = True, range_bytes: int = RANGE_BYTES) -> StreamingQuery:
    """Start the import stream over ``drop_dir`` (CSV files, each with its own header). With ``available_now`` the files that are
    there are imported, at most ``files_per_batch`` a batch, and the query returned has ended.

    Outputs below ``out_dir``, each partitioned by ``batch_id``: ``accepted``, ``parties`` (created ones), ``rejected``,
    ``files`` (every file seen, with its digest, its records and the file it repeats, if any) and ``state`` (the last ids
    given, one row a batch).
    """
    register(spark)
    stream = (spark.readStream.format("import_files").option("paths", json.dumps([drop_dir])).option("range_bytes", range_bytes)
              .option("log", f"{checkpoint_dir}/import-files").option("files_per_batch", files_per_batch).load())
    accepted_path, parties_path, rejected_path, files_path, state_path = (f"{out_dir}/{x}" for x in OUTPUTS)

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        raw = materialized(batch, "stream-raw")
        files = told_apart(file_digests(raw), _earlier(spark, files_path, batch_id, FILES))
        files = materialized(files, "stream-files")
        records = resolved(raw).join(files.where("same_as IS NULL").select("file_no"), "file_no", "left_semi")
        known = parties.unionByName(_earlier(spark, parties_path, batch_id, parties.schema))
        res = import_transactions(numbered(records), known, pivot_year=pivot_year, materialize=True)
        # The ids given last, one row a batch; the base tables are asked only before the first.
        last = _earlier(spark, state_path, batch_id, STATE).agg(F.max("last_party"), F.max("last_txn")).first()
        if last[0] is None:
            last = (parties.agg(F.max("party_id")).first()[0] or 0, transactions.agg(F.max("txn_id")).first()[0] or 0)
        new_parties, accepted = res.with_ids(*last)
        counts = res.accepted.select("file").unionByName(res.rejected.select("file")).groupBy("file").agg(F.count(F.lit(1)).alias("records"))
        _put(accepted, accepted_path, batch_id)
        _put(new_parties, parties_path, batch_id)
        _put(res.rejected, rejected_path, batch_id)
        _put(files.join(counts, "file", "left").select("file", "file_no", "digest", F.coalesce("records", F.lit(0)).alias("records"),
                                                        "same_as"), files_path, batch_id)
        state = [(last[0] + new_parties.count(), last[1] + accepted.count())]
        _put(spark.createDataFrame(state, STATE), state_path, batch_id)

    writer = stream.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint_dir)
    if not available_now:
        return writer.trigger(processingTime="10 seconds").start()
    query = writer.start()  # Python sources have no available-now trigger
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return query


def read_accepted(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.parquet(f"{out_dir}/accepted").drop("batch_id")
