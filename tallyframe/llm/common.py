"""What the operators of this package share: input tables, work folders, written steps."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of words in every contract of this package.
SPACE_CLASS = r"[ \t\n\x0B\f\r]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Only a local master may go without the setting (tests): it then gets a private
    folder. Elsewhere a machine-local folder would lose data, so this raises.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tallyframe-llm-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as parquet below the shared folder and read back.

    It cuts the lineage (a lost executor costs a re-read, not a re-computation), fixes
    the outcome of steps that are read more than once, and gives the optimizer the
    real size of the table.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a bucket of the bitmaps that name places (Spark's own size).
BUCKET_ROWS = 32768
PLACE = ("__file", "__row")


def placed(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with the place of every row: a hash of its Parquet file's name and its number in the file. Places do not depend on
    how a job splits the files, so a later job can name rows of ``docs`` by them. Rows that are not read straight from
    Parquet are written first."""

    def with_place(df):
        return df.select("*", F.xxhash64(F.col("_metadata.file_path")).alias(PLACE[0]), F.col("_metadata.row_index").alias(PLACE[1]))

    try:
        return with_place(docs)
    except AnalysisException:  # no file's rows, or a column of its own named _metadata
        return with_place(written(docs, name))


def places_written(places: DataFrame, name: str) -> str:
    """The rows that ``places`` names, as bitmaps of 32768 rows below the shared folder; the folder."""
    bits = places.groupBy(PLACE[0], F.expr(f"{PLACE[1]} DIV {BUCKET_ROWS}").alias("bucket")).agg(
        F.bitmap_construct_agg(F.col(PLACE[1]) % BUCKET_ROWS).alias("bits"))
    path = work_path(places.sparkSession, name)
    share = F.pmod(F.col(PLACE[0]), F.lit(_SHARES)).alias("share")
    bits.select("*", share).repartition("share").write.partitionBy("share").parquet(path)
    return path


#: Subfolders over which the bitmaps of files are spread.
_SHARES = 256


class _Places:
    """The bitmaps of one folder, as a task needs them: those of one file at a time."""

    def __init__(self, path: str):
        self.store, self.path = shared_store(path)
        self.file, self.bits = None, {}

    def has(self, file: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Whether each (file, row) is named."""
        out = np.zeros(len(file), bool)
        edges = np.flatnonzero(np.r_[True, file[1:] != file[:-1]]) if len(file) else []
        for a, b in zip(edges, [*edges[1:], len(file)], strict=True):
            self._load(int(file[a]))
            bucket, at = np.divmod(row[a:b], BUCKET_ROWS)
            for k in np.unique(bucket):
                if (bits := self.bits.get(int(k))) is not None:
                    here = bucket == k
                    out[a:b][here] = (bits[at[here] >> 3] >> (at[here] & 7)) & 1 > 0
        return out

    def _load(self, file: int) -> None:
        if file == self.file:
            return
        self.file, self.bits = file, {}
        folder = f"{self.path}/share={file % _SHARES}"
        if self.store.get_file_info(folder).type == pa.fs.FileType.Directory:
            found = pq.read_table(folder, filesystem=self.store, filters=[(PLACE[0], "=", file)], columns=["bucket", "bits"], partitioning=None)
            for bucket, bits in zip(found.column("bucket").to_pylist(), found.column("bits").to_pylist(), strict=True):
                self.bits[bucket] = np.frombuffer(bits, np.uint8)


def rows_at(docs: DataFrame, path: str, named: bool = True, then=None, schema=None) -> DataFrame:
    """The rows of ``docs`` (as ``placed`` gives them) that the bitmaps of ``path`` name, or (``named`` false) all others, without
    the place. The task that reads a file asks the file's bitmaps, so no row is shuffled.

    With ``then`` (batches to batches of ``schema``) the rows, place included, go through it in the same worker.
    """

    def kept(batches):
        places = _Places(path)
        for batch in batches:
            hit = places.has(batch.column(PLACE[0]).to_numpy(), batch.column(PLACE[1]).to_numpy())
            yield batch.filter(pa.array(hit if named else ~hit))

    def run(batches):
        yield from then(kept(batches)) if then else (b.drop_columns(list(PLACE)) for b in kept(batches))

    return map_arrow(docs, run, schema if then else docs.drop(*PLACE).schema)


def shared_store(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and path of a folder that all executors share."""
    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        return pa.fs.LocalFileSystem(), uri
    if scheme == "file":
        return pa.fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pa.fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{rest}")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once an application (they need not have it installed)."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parents[1]
        if root.is_dir():
            target = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
            with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
                for f in sorted(root.rglob("*.py")):
                    out.write(f, f.relative_to(root.parent))
            sc.addPyFile(str(target))
        _SHIPPED.add(sc.applicationId)


#: Bytes of a batch handed to Python: texts are long, and a batch stands in the executor and in the worker at once.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: What empties the caches of this package's modules, called where a task ends.
_TASK_CACHES: list = []


def task_cache(clear):
    """Have ``clear`` called at the end of every task: workers live on, and the next task may be of another step."""
    _TASK_CACHES.append(clear)
    return clear


def give_back() -> None:
    """Return what a task has used: caches, Arrow's pool, and the free memory that the allocator holds."""
    for clear in _TASK_CACHES:
        clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` with this package at hand on the executors, batches bounded by bytes (unless the session sets a bound of
    its own), and memory given back at the end of a task."""
    spark = df.sparkSession
    ship(spark)
    if spark.conf.get(_BATCH_SETTING, "67108864b") in ("67108864b", "64MB", "64m"):  # Spark's default
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(whole, schema)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished steps, whose frames are no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
