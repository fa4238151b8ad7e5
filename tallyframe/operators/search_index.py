"""Search by a trigram index.

A search scans every row. ``SearchIndex`` writes the list in blocks of consecutive ids, many blocks a folder, and an inverted index:
for every three characters in a row that a cell shows (upper case), the blocks that have them, sorted, in shards by a hash of the
three. A text is in a cell only if all its trigrams are, so the blocks to look at are those in all its lists; their rows are
read and compared as ``lists.search`` does, which settles what the blocks only make possible. The lists are a block's distinct
trigrams and so far smaller than the rows' own.

A task collects the trigrams of whole blocks, and the lists are dealt out by shard and run of consecutive blocks, for a fixed number
of rows a task: a larger table has more tasks and files, not larger ones.

A text of fewer than three characters has no trigram and scans. The index belongs to the table version that it was built from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import path_exists
from .lists import LIST_COLUMNS, _finish, joined_list, matches, shown_cells

#: Ids of a block, and blocks of a folder of rows.
BLOCK_IDS, BLOCKS_PER_PART = 256, 64
SHARDS = 64
#: Rows of the list for each task that makes or writes trigrams, and blocks of a run of the lists.
TASK_ROWS, BLOCKS_PER_RUN = 1 << 16, 1 << 13
GRAM = 3
ROWS = ("id long, date string, bill_no string, party string, type string, mode string, amount decimal(18,2), txn_date date, "
        "block long, part long")
LISTS = "gram string, part long, block long, shard int"


class SearchIndex:
    """The list below ``root``: ``rows/part=<p>`` and ``grams/shard=<s>`` (gram, part, block)."""

    def __init__(self, spark: SparkSession, root: str, block_ids: int = BLOCK_IDS, blocks_per_part: int = BLOCKS_PER_PART,
                 task_rows: int = TASK_ROWS, blocks_per_run: int = BLOCKS_PER_RUN):
        self.spark, self.root, self.block_ids, self.per_part = spark, root.rstrip("/"), block_ids, blocks_per_part
        self.task_rows, self.per_run = task_rows, blocks_per_run

    def build(self, tx: DataFrame, parties: DataFrame) -> None:
        """Write rows and lists. A block's rows meet in one task, which drops its repeated cells and trigrams before the next shuffle."""
        rows = joined_list(tx, parties).select(*dict.fromkeys([*LIST_COLUMNS, "txn_date", "amount"]),
                                               F.expr(f"id DIV {self.block_ids}").alias("block"))
        rows = rows.withColumn("part", F.expr(f"block DIV {self.per_part}"))
        rows.repartitionByRange("part", "id").sortWithinPartitions("part", "id").write.mode("overwrite").partitionBy("part").parquet(f"{self.root}/rows")
        rows = self.spark.read.schema(ROWS).parquet(f"{self.root}/rows")
        tasks = max(self.spark.sparkContext.defaultParallelism, -(-rows.count() // self.task_rows))  # the count is in the files' footers
        cell = F.explode(F.array(*[F.upper(c) for c in shown_cells()])).alias("cell")
        cells = rows.repartition(tasks, "part", "block").select("part", "block", cell)
        cells = cells.where(F.char_length("cell") >= GRAM).distinct()  # types and modes repeat in a block
        grams = F.transform(F.sequence(F.lit(1), F.char_length("cell") - (GRAM - 1)), lambda k: F.substring(F.col("cell"), k, F.lit(GRAM)))
        lists = cells.select("part", "block", F.explode(F.array_distinct(grams)).alias("gram")).distinct()
        lists = lists.withColumn("shard", self._shard("gram"))
        lists = lists.repartition(tasks, "shard", F.expr(f"block DIV {self.per_run}")).sortWithinPartitions("shard", "gram", "block")
        lists.write.mode("overwrite").partitionBy("shard").parquet(f"{self.root}/grams")

    @staticmethod
    def _shard(column: str):
        return F.pmod(F.xxhash64(column), F.lit(SHARDS)).cast("int")

    def _rows(self) -> DataFrame:
        if not path_exists(self.spark, f"{self.root}/grams/_SUCCESS"):
            raise FileNotFoundError(f"No search index at {self.root}")
        return self.spark.read.schema(ROWS).parquet(f"{self.root}/rows")

    def blocks(self, text: str) -> DataFrame:
        """(part, block) of the blocks that have all trigrams of ``text`` (three characters or more)."""
        up = text.upper()
        grams = sorted({up[k : k + GRAM] for k in range(len(up) - GRAM + 1)})
        hashed = self.spark.createDataFrame([(g,) for g in grams], "gram string").select(self._shard("gram").alias("s")).distinct()
        shards = sorted(r.s for r in hashed.collect())
        lists = self.spark.read.schema(LISTS).parquet(f"{self.root}/grams").where(F.col("shard").isin(shards) & F.col("gram").isin(grams))
        return lists.groupBy("part", "block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams)).select("part", "block")

    def search(self, text: str) -> DataFrame:
        """The rows of ``lists.search`` on the table that was indexed."""
        rows = self._rows()
        if len(text.upper()) >= GRAM:
            found = self.blocks(text)
            parts = sorted(r.part for r in found.select("part").distinct().collect())  # at most as many as there are folders
            rows = rows.where(F.col("part").isin(parts)) if parts else rows.where("false")
            rows = rows.join(found, ["part", "block"], "left_semi")
        return _finish(rows.where(matches(text)) if text else rows)
