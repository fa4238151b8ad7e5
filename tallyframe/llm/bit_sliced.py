"""Operator 12, exact top-k by inner product over a bit-sliced index.

Index: rows stand in blocks of at most ``BLOCK`` as they are read. An attribute of a block is its entries less the block's
smallest one, w bits wide; of these the ``SLICES`` most significant are kept, each as a bitmap over the block's rows.

Query: the score is a weighted sum of attributes. Every set bit a of a weight adds the slices of its attribute, shifted by a
(complemented where the weight is negative, which only moves the sum by a constant). Carry-save adders over bitmaps
turn these into the slices of the sum. From the most significant slice downward the k-th largest sum is found and then the rows
whose sum may still reach it: what the dropped slices can add is known exactly from the weights. Only these rows are
resolved on the stored vectors, so results are exact whatever ``SLICES`` is.

Scale: queries against all rows is the task, so work is queries x rows; a (block, group of queries) pair is one unit of it, of
bounded size, dealt by its key. Blocks are never replicated to more units than there are groups of queries, and each
unit returns at most k rows a query.

Cases: vectors left out are those of ``vectors.integer_vectors``; an empty table gives an empty result. Rows
that repeat an id each stand as candidates, but none of them for a query of that id; of query rows that repeat an id
the smallest vector is asked. A null id is never a query and comes after all ids in ties. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_arrow, ship, written
from .vectors import SCALE, embeddings, integer_vectors, matrix

K = 5
QUERY_STEP = 50
BLOCK = 16384
GROUP = 2048
SLICES = 7
#: Blocks that a task gives a group's queries to, on average at most.
SHARE = 8
#: 64-bit words of a batch of bitmaps of as many queries as fit.
WORDS = 512

INDEX = "part int, block int, n int, dims int, drop int, ids binary, known binary, low binary, slices binary, vectors binary"
FOUND = "query_id long, vec_id long, score long"


def _words(bits: np.ndarray) -> np.ndarray:
    """Booleans along the last axis as 64-bit words."""
    pad = -bits.shape[-1] % 64
    bits = np.pad(bits, [(0, 0)] * (bits.ndim - 1) + [(0, pad)])
    return np.ascontiguousarray(np.packbits(bits, axis=-1, bitorder="little")).view(np.uint64)


def make_block(x: np.ndarray, slices: int = SLICES) -> tuple[np.ndarray, int, np.ndarray]:
    """(low, drop, bitmaps) of the vectors ``x``: bitmaps[j, b] has bit drop + b of attribute j."""
    low = x.min(axis=0)
    u = x - low
    width = max(1, int(u.max()).bit_length()) if u.size else 1
    drop = max(0, width - slices)
    kept = (u >> drop).T
    bits = [_words((kept >> b) & 1 > 0) for b in range(width - drop)]
    return low, drop, np.stack(bits, axis=1)


def index_blocks(vectors: DataFrame, block: int = BLOCK, slices: int = SLICES) -> DataFrame:
    """The index of (vec_id, x): a row a block."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made, held, rows = TaskContext.get().partitionId(), 0, [], 0
        schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("n", pa.int32()), ("dims", pa.int32()), ("drop", pa.int32()),
                            *[(c, pa.binary()) for c in ("ids", "known", "low", "slices", "vectors")]])

        def flush():
            x = np.concatenate([h[2] for h in held])
            ids, known = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            low, drop, bits = make_block(x, slices)
            cells = [part, made, len(x), x.shape[1], drop, ids.tobytes(), known.tobytes(), low.tobytes(), bits.tobytes(), x.astype(np.int32).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, schema)], schema=schema)

        for batch in batches:
            ids = batch.column("vec_id")
            x, known = matrix(batch.column("x")), ~np.asarray(ids.is_null())
            ids = np.asarray(ids.fill_null(0))
            while len(x):
                take = block - rows
                held.append((ids[:take], known[:take], x[:take]))
                rows += len(held[-1][0])
                ids, known, x = ids[take:], known[take:], x[take:]
                if rows == block:
                    yield flush()
                    made, held, rows = made + 1, [], 0
        if rows:
            yield flush()

    return map_arrow(vectors, build, INDEX)


def add_slices(bitmaps: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    """The slices of sum_j weights[q, j] * attribute j, least significant first, each (queries, words).

    ``bitmaps`` is (attributes, slices, words); ``weights`` is not negative.
    """
    dims, depth, words = bitmaps.shape
    flat = np.concatenate([bitmaps.reshape(dims * depth, words), np.zeros((1, words), np.uint64)])
    nothing, asked = dims * depth, len(weights)
    top = int(weights.max()).bit_length() if weights.size else 0
    out, carried = [], []
    for p in range(top + depth + dims.bit_length() + 1):
        parts = []
        for b in range(depth):
            if 0 <= p - b < top:
                has = (weights >> (p - b)) & 1 > 0
                most = int(has.sum(axis=1).max())
                if most:  # each query's attributes first, then the empty bitmap
                    order = np.argsort(~has, axis=1, kind="stable")[:, :most]
                    rows = np.where(np.take_along_axis(has, order, axis=1), order * depth + b, nothing)
                    parts.append(flat[rows])
        stack = np.concatenate(parts + carried, axis=1) if parts or carried else np.zeros((asked, 0, words), np.uint64)
        carried = []
        if not stack.shape[1]:
            if p >= top + depth:
                break
            out.append(np.zeros((asked, words), np.uint64))
            continue
        while stack.shape[1] > 2:
            third = stack.shape[1] // 3
            a, b, c = stack[:, :third], stack[:, third : 2 * third], stack[:, 2 * third : 3 * third]
            either = a ^ b
            carried.append((a & b) | (either & c))
            stack = np.concatenate([either ^ c, stack[:, 3 * third :]], axis=1)
        if stack.shape[1] == 2:
            carried.append(stack[:, :1] & stack[:, 1:])
            stack = stack[:, :1] ^ stack[:, 1:]
        out.append(stack[:, 0])
    return out


def rows_from_top(sums: list[np.ndarray], alive: np.ndarray, k: int, slack: int) -> np.ndarray:
    """The rows (as words) among ``alive`` whose sum is at most ``slack`` below the k-th largest."""
    need, level, tied = k, 0, alive
    if int(np.bitwise_count(alive).sum()) <= k:
        return alive
    for p in range(len(sums) - 1, -1, -1):
        ones = tied & sums[p]
        n = int(np.bitwise_count(ones).sum())
        if n >= need:
            tied, level = ones, level | 1 << p
        else:
            need, tied = need - n, tied & ~sums[p]
    level -= slack
    if level <= 0:
        return alive
    above, equal = np.zeros_like(alive), alive
    for p in range(len(sums) - 1, -1, -1):
        if level >> p & 1:
            equal = equal & sums[p]
        else:
            above, equal = above | (equal & sums[p]), equal & ~sums[p]
    return above | equal


def search_block(x: np.ndarray, drop: int, bitmaps: np.ndarray, ids: np.ndarray, known: np.ndarray,
                 queries: np.ndarray, query_ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(position of the query, rows, scores) of each query's k best rows of the block."""
    dims, _, words = bitmaps.shape
    both = np.concatenate([bitmaps, ~bitmaps])  # attributes, then what they lack to all ones
    alive = _words(np.ones(len(x), bool))
    step = max(1, WORDS // words)
    for at in range(0, len(queries), step):
        q = queries[at : at + step]
        sums = add_slices(both, np.concatenate([np.maximum(q, 0), np.maximum(-q, 0)], axis=1))
        for i, weights in enumerate(q):
            own = _words(known & (ids == query_ids[at + i]))
            slack = -(-((1 << drop) - 1) * int(np.abs(weights).sum()) >> drop)
            found = rows_from_top([s[i] for s in sums], alive & ~own, k, slack)
            rows = np.flatnonzero(np.unpackbits(found.view(np.uint8), bitorder="little"))
            scores = x[rows].astype(np.int64) @ weights
            best = np.lexsort((ids[rows], ~known[rows], -scores))[:k]
            yield at + i, rows[best], scores[best]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK, group: int = GROUP, slices: int = SLICES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of ``vectors`` (vec_id, x) of largest inner product with each row of
    ``queries`` (query_id, x), ties to the smaller id, rows of the query's own id left out."""
    spark = vectors.sparkSession
    queries = written(queries.where("query_id IS NOT NULL").groupBy("query_id").agg(F.min("x").alias("x")), "bit-queries")
    index = written(index_blocks(vectors, block, slices), "bit-index")
    groups, shares = max(1, -(-queries.count() // group)), index.count() // SHARE + 1
    lanes = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("lane")
    units = index.select("*", lanes)
    # A group's queries go to every block; shares of the blocks keep that join from being one task a group.
    asked = queries.select("*", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("lane"),
                           F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
    to = index.select(F.col("part").alias("to_part"), F.col("block").alias("to_block"), lanes,
                      F.pmod(F.xxhash64("part", "block"), F.lit(shares)).cast("int").alias("share"))
    asked = to.join(asked, ["lane", "share"])
    ship(spark)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = ([], [], [])
        if left.num_rows and right.num_rows:
            b = {c: left.column(c)[0].as_py() for c in left.column_names}
            n, dims = b["n"], b["dims"]
            x = np.frombuffer(b["vectors"], np.int32).reshape(n, dims)
            bitmaps = np.frombuffer(b["slices"], np.uint64).reshape(dims, -1, -(-n // 64))
            ids, known = np.frombuffer(b["ids"], np.int64), np.frombuffer(b["known"], bool)
            weights, query_ids = matrix(right.column("x")), np.asarray(right.column("query_id"))
            for i, rows, scores in search_block(x, b["drop"], bitmaps, ids, known, weights, query_ids, k):
                out[0].append(np.full(len(rows), query_ids[i]))
                out[1].append(pa.array(ids[rows], mask=~known[rows]))
                out[2].append(scores)
        join = lambda parts: pa.concat_arrays([pa.array(p, pa.int64()) for p in parts]) if parts else pa.array([], pa.int64())
        return pa.table({"query_id": join(out[0]), "vec_id": join(out[1]), "score": join(out[2])})

    units, asked = units.groupBy("part", "block", "lane"), asked.groupBy("to_part", "to_block", "lane")
    found = units.cogroup(asked).applyInArrow(search, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12_bit_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = written(integer_vectors(embeddings(spark, sf_dir)), "bit-vectors")
    return top_k(vectors, vectors.where(F.col("vec_id") % QUERY_STEP == 0).withColumnRenamed("vec_id", "query_id"))


#: DuckDB: every query against every row. The products are whole numbers below 2^53, so sums in doubles are exact.
OP12_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % {QUERY_STEP} = 0 AND c.vec_id IS DISTINCT FROM q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}"""
