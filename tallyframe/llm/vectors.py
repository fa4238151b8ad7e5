"""Integer vectors of the ``embeddings`` table, shared by operators 11 and 12."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed point of the contracts: an entry c becomes floor(256 * c).
SCALE = 256
#: Entries stay below this in absolute value, so that products and scores are exact longs.
LIMIT = 1 << 28


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, x) of the rows whose vector is whole: x is floor(scale * c) of its entries as longs.

    Vectors that are null or hold null or non-finite entries are left out. So are those of another length than most
    (ties: the shorter), for which no product with the others is defined.
    """
    c = F.col("e")
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("e"))
    rows = rows.where(c.isNotNull() & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    sizes = rows.groupBy(F.size("e").alias("dims")).count().orderBy(F.desc("count"), "dims").limit(1).collect()
    dims = sizes[0]["dims"] if sizes else 0
    return rows.where(F.size("e") == dims).select("vec_id", F.transform(c, lambda v: F.floor(v * scale).cast("long")).alias("x"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The list column as rows x entries; entries of ``LIMIT`` or more are refused."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = np.asarray(column.flatten())
    x = x.reshape(len(column), len(x) // max(1, len(column)))
    if x.size and max(int(x.max()), -int(x.min())) >= LIMIT:
        raise ValueError(f"entries of {LIMIT} or more in absolute value: their products would pass a long")
    return x
