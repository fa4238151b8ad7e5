"""Operator 3, suffix-array dedup: bytes covered by a repeated 100-byte string.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in a document of
smaller id, or earlier in the same one. The work is cut into independent blocks as follows.

1. Every start belongs to an anchor: the 16-byte piece of lowest hash in its 100 bytes. Equal strings
   have equal anchors, so all starts of a string lie in the bucket of one anchor. The starts of
   one anchor place are a range; their bytes (100 to 184) are its context. Ranges are shuffled by
   anchor and sorted; equal contexts become one, with its first place; a bucket of a single range is done.
2. Buckets with several contexts go to blocks. A block is one text of all its contexts; its
   suffixes are sorted by their first 128 bytes, which gives the Burrows-Wheeler transform, and
   breadth-first backward extension of intervals derives the common prefixes of neighbouring suffixes
   by increasing value (``prefix_boundaries``), stopping at 100: what has no boundary by then are
   the starts of equal strings. Each class's first place goes to all starts in it.
3. A bucket of more than ``BUCKET`` contexts (a common line between ever different neighbours) is split
   by the strings themselves: every start by the 128-bit hash of its 100 bytes. That way is as exact.
   So are the anchors split that would fill a task by their number of ranges (``hot_anchors``), before any shuffle.
4. All places of the contexts learn which of their starts are not the first, and each document drops the union.

Contexts are told apart by two 64-bit hashes (anchor and whole context).

Scale: anchors are one in 43 bytes, rows of five numbers; they are shuffled, not the bytes at every position.
Texts are shuffled twice, by document. A periodic text (a word over and over) gives one row a
period, not one a place. No step holds more than a document, a block or a bucket of bounded size.

Cases: null and short texts lose nothing; rows that repeat an id, or have none, are numbered
in the order of (id, content), ids first, and count as documents of their own; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_arrow, release, shared_store, text_or_empty, work_path, written

LENGTH = 100
ANCHOR = 16
BUCKET = 4096
#: Bytes of contexts sorted together.
BLOCK = 1 << 19
#: Starts handled at once; longer texts are read in pieces.
CHUNK = 1 << 18
#: Rows taken from an Arrow batch at once.
ROWS = 256
#: An anchor is hot if by one document in HOT_SAMPLE it has more than HOT_ROWS ranges.
HOT_SAMPLE = 64
HOT_ROWS = 1 << 17

_WINDOW = LENGTH - ANCHOR + 1
_U = np.uint64
_rng = np.random.default_rng(1234567)
_BYTE = _rng.integers(0, 2**63, 256).astype(_U) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << int(n).bit_length()
        steps = np.full(size, base, _U)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps)
    return have[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Prefix:
    """Hashes of any range of a buffer, from a running polynomial sum."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        self.sums = np.zeros(n + 1, _U)
        np.cumsum(_BYTE[buf] * _power(_BASE, n), out=self.sums[1:])
        self.back = _power(_INVERSE, n + 1)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(_U))

    def each(self, size: int) -> np.ndarray:
        """Of every place, the hash of the ``size`` bytes from there."""
        d = self.sums[size:] - self.sums[:-size]
        d *= self.back[: len(d)]
        return _mix(d)


def anchors(buf: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges of starts in texts that stand one after another in ``buf``.

    Returns text number, first start (in its text), number of starts, repetitions, anchor hash and context hash. A row
    with r repetitions stands for r ranges one after another with the same context.
    """
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, _U, _U))
    if len(buf) < LENGTH:
        return none
    prefix = _Prefix(buf)
    grams = prefix.each(ANCHOR)
    low = (grams & ~_U(0xFFFFFF)) | np.arange(len(grams), dtype=_U)  # the place breaks ties: leftmost
    width = 1
    while 2 * width <= _WINDOW:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(low) - (_WINDOW - width)], low[_WINDOW - width :])
    place = (low & _U(0xFFFFFF)).astype(np.int64)
    begin = np.r_[0, np.cumsum(sizes)[:-1]]
    room = np.maximum(sizes - LENGTH + 1, 0)  # starts of each text
    text = np.repeat(np.arange(len(sizes)), room)
    if not len(text):
        return none
    start = np.arange(len(text)) - np.repeat(np.cumsum(room) - room, room)
    at = start + begin[text]
    place = place[at]
    first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])])
    count = np.diff(np.r_[first, len(text)])
    text, start, at, h = text[first], start[first], at[first], grams[place[first]]
    g = prefix.ranges(at, at + count + LENGTH - 1)
    again = np.r_[False, (text[1:] == text[:-1]) & (h[1:] == h[:-1]) & (g[1:] == g[:-1]) & (count[1:] == count[:-1])]
    head = np.flatnonzero(~again)
    return text[head], start[head], count[head], np.diff(np.r_[head, len(again)]), h[head], g[head]


def _slices(batches):
    """The batches in runs of at most ROWS rows, so that a task holds few texts as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _pieces(batch, column: str):
    """(rows, offsets in their texts, bytes, sizes) of runs of texts; a long text comes in overlapping pieces."""
    run, offs, parts, size = [], [], [], 0
    for k, raw in enumerate(batch.column(column).to_pylist()):
        for at in range(0, max(1, len(raw) - LENGTH + 1), CHUNK):
            piece = raw[at : at + CHUNK + LENGTH - 1]
            if run and size + len(piece) > CHUNK:
                yield run, offs, b"".join(parts), np.array([len(p) for p in parts])
                run, offs, parts, size = [], [], [], 0
            run.append(k)
            offs.append(at)
            parts.append(piece)
            size += len(piece)
    if run:
        yield run, offs, b"".join(parts), np.array([len(p) for p in parts])


class _Hot:
    """The hot anchors, a written table that a task reads when it first asks: 8 bytes each, at most one for ``HOT_ROWS`` ranges."""

    def __init__(self, path: str):
        self.path, self.found = path, None

    def has(self, h: np.ndarray) -> np.ndarray:
        if self.found is None:
            store, path = shared_store(self.path)
            self.found = np.sort(pq.read_table(path, filesystem=store, columns=["h"]).column("h").to_numpy())
        at = np.searchsorted(self.found, h)
        at[at == len(self.found)] = 0
        return self.found[at] == h if len(self.found) else np.zeros(len(h), bool)


def _anchor_rows(docs: DataFrame, hot: _Hot | None) -> DataFrame:
    """h, g, uid, s (first start), n (starts) and reps of every anchor range of (uid, raw), those of hot anchors left out."""

    def run(batches):
        for batch in _slices(batches):
            uid = batch.column("uid").to_numpy()
            for rows, offs, raw, sizes in _pieces(batch, "raw"):
                text, start, n, reps, h, g = anchors(np.frombuffer(raw, np.uint8), sizes)
                if hot is not None:
                    cold = ~hot.has(h.view(np.int64))
                    text, start, n, reps, h, g = text[cold], start[cold], n[cold], reps[cold], h[cold], g[cold]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), pa.array(uid[np.array(rows)[text]]),
                     pa.array(start + np.array(offs)[text]), pa.array(n.astype(np.int32)), pa.array(reps.astype(np.int32))],
                    ["h", "g", "uid", "s", "n", "reps"])

    return map_arrow(docs, run, "h long, g long, uid long, s long, n int, reps int")


def hot_anchors(docs: DataFrame, share: int = HOT_SAMPLE, least: int = HOT_ROWS) -> _Hot | None:
    """Anchors that would fill a task of their own, judged by one document in ``share``; None if there are none. They only take
    another way to the same result, so the estimate decides where work is done, never what comes out. At
    most anchors / ``least`` of them are hot; they stay in a table of the shared folder."""
    sample = docs.filter(F.pmod(F.xxhash64("uid"), F.lit(share)) == 0)
    counts = _anchor_rows(sample, None).groupBy("h").agg(F.sum("reps").alias("n"))
    path = work_path(docs.sparkSession, "suffix-hot-anchors")
    counts.filter(F.col("n") * share > least).select("h").write.parquet(path)
    return _Hot(path) if docs.sparkSession.read.schema("h long").parquet(path).limit(1).count() else None


def _hot_starts(docs: DataFrame, hot: _Hot) -> DataFrame:
    """a, b (two hashes of the 100 bytes), uid and s of every start of a hot anchor."""

    def run(batches):
        for batch in _slices(batches):
            uid = batch.column("uid").to_numpy()
            for rows, offs, raw, sizes in _pieces(batch, "raw"):
                buf = np.frombuffer(raw, np.uint8)
                text, start, n, reps, h, _ = anchors(buf, sizes)
                k = np.flatnonzero(hot.has(h.view(np.int64)))
                size = n[k] * reps[k]
                begin = np.r_[0, np.cumsum(sizes)[:-1]]
                s = np.arange(int(size.sum())) + np.repeat(start[k] - (np.cumsum(size) - size), size)
                at, who = s + np.repeat(begin[text[k]], size), np.repeat(text[k], size)
                one = _Prefix(buf).ranges(at, at + LENGTH)
                other = np.array([xxhash.xxh64_intdigest(raw[x : x + LENGTH]) for x in at.tolist()], _U)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one.view(np.int64)), pa.array(other.view(np.int64)), pa.array(uid[np.array(rows)[who]]),
                     pa.array(s + np.array(offs)[who])], ["a", "b", "uid", "s"])

    return map_arrow(docs, run, "a long, b long, uid long, s long")


def _repeated(rows: DataFrame) -> DataFrame:
    """The ranges whose bucket holds more than one, with what the bucket tells: the first place (uid0, s0) and the
    number (total) of their context, whether they are that place (first), and how many contexts there are.

    Rows come sorted, so a bucket is a run; only the bucket at the end of a batch is carried on.
    """
    names = ["h", "g", "uid", "s", "n", "reps"]

    def solve(cols: list[np.ndarray]):
        h, g, uid, s, n, reps = cols
        new_h = np.r_[True, h[1:] != h[:-1]]
        new_g = new_h | np.r_[True, g[1:] != g[:-1]]
        bucket, context = np.flatnonzero(new_h), np.flatnonzero(new_g)
        size, width = np.diff(np.r_[bucket, len(h)]), np.diff(np.r_[context, len(h)])
        alive = np.repeat(np.add.reduceat(reps, bucket) > 1, size)
        many = np.repeat(np.add.reduceat(new_g.astype(np.int64), bucket), size)
        total = np.repeat(np.add.reduceat(reps.astype(np.int64), context), width)
        uid0, s0 = np.repeat(uid[context], width), np.repeat(s[context], width)
        out = [*cols, uid0, s0, total, many, new_g]
        return pa.RecordBatch.from_arrays([pa.array(c[alive]) for c in out], [*names, "uid0", "s0", "total", "contexts", "first"])

    def run(batches):
        held: list[list[np.ndarray]] = []
        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in names]
            if not len(cols[0]):
                continue
            last = int(np.searchsorted(cols[0], cols[0][-1]))  # where the last bucket begins
            if last or (held and held[0][0][0] != cols[0][0]):
                whole = [np.concatenate([*[x[k] for x in held], cols[k][:last]]) for k in range(len(names))]
                if len(whole[0]):
                    yield solve(whole)
                held = [[c[last:] for c in cols]]
            else:
                held.append(cols)
        if held:
            yield solve([np.concatenate([x[k] for x in held]) for k in range(len(names))])

    sorted_rows = rows.repartition("h").sortWithinPartitions("h", "g", "uid", "s")
    return map_arrow(sorted_rows, run, "h long, g long, uid long, s long, n int, reps int, uid0 long, s0 long, total long, contexts long, first boolean")


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of ``text`` in order of their first ``depth`` bytes or more."""
    n = len(text)
    key = text.astype(_U)
    for step in (1, 2, 4):
        key = (key << _U(8 * step)) | np.r_[key[step:], np.zeros(step, _U)]
    order = np.argsort(key)
    sorted_key = key[order]
    new = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
    rank = np.empty(n, np.int64)
    step = 8
    while True:
        head = np.flatnonzero(new)
        size = np.diff(np.r_[head, n])
        rank[order] = np.repeat(head, size)  # a group's rank is its first place
        if step >= depth or len(head) == n:
            return order
        open_ = np.flatnonzero(np.repeat(size > 1, size))
        member = order[open_]
        follow = np.where(member + step < n, rank[np.minimum(member + step, n - 1)] + 1, 0)
        both = rank[member] * (n + 1) + follow
        inner = np.argsort(both, kind="stable")
        order[open_] = member[inner]
        both = both[inner]
        new[open_] = np.r_[True, both[1:] != both[:-1]]
        step *= 2


def prefix_boundaries(text: np.ndarray, order: np.ndarray, stop: int) -> np.ndarray:
    """Common prefix of each suffix in ``order`` with the one before it, where below ``stop``; else -1.

    Intervals of suffixes that begin with some string are extended by one byte to the left, by counting
    in the Burrows-Wheeler transform; an extension whose right end has no value yet gets the present
    length and is extended in the next round, any other is dropped. Values come in
    increasing order, so rounds end at ``stop``.
    """
    n = len(text) + 1  # an end mark below all bytes makes the transform whole
    order = np.r_[n - 1, order]
    out = np.full(n + 1, -1, np.int16)
    out[0] = out[n] = 0
    before = np.where(order > 0, text[order - 1].astype(np.int16), -1)  # the transform
    column = np.argsort(before, kind="stable")
    to = np.empty(n, np.int64)  # place of the suffix one byte longer
    to[column] = np.arange(n)
    same = before[column[1:]] == before[column[:-1]]
    follower, former = np.full(n, n, np.int64), np.full(n, -1, np.int64)  # next and last place of the same byte
    follower[column[:-1][same]] = column[1:][same]
    former[column[1:][same]] = column[:-1][same]
    left, right = np.array([0]), np.array([n - 1])
    for length in range(stop):
        if not len(left):
            break
        size = right - left + 1
        place = np.arange(int(size.sum())) + np.repeat(left - (np.cumsum(size) - size), size)
        lowest, highest = np.repeat(left, size), np.repeat(right, size)
        starts = np.sort(to[place[former[place] < lowest]])
        ends = np.sort(to[place[follower[place] > highest]])
        fresh = out[ends + 1] < 0
        left, right = starts[fresh], ends[fresh]
        out[right + 1] = length
    return out[1:n]


def first_places(contexts: list[bytes], uid: np.ndarray, start: np.ndarray):
    """For all contexts of whole buckets: which place each start's string has first.

    Returns (context, first offset, end offset, uid, start): offsets first..end of the context have
    their string first in document uid from ``start`` on.
    """
    rank = np.lexsort((start, uid))  # contexts in order of their places
    turn = np.empty(len(rank), np.int64)
    turn[rank] = np.arange(len(rank))
    sizes = np.array([len(c) for c in contexts])
    text = np.frombuffer(b"\xff".join(contexts) + b"\xff", np.uint8)  # 0xFF is no byte of UTF-8
    begin = np.r_[0, np.cumsum(sizes + 1)[:-1]]
    n = sizes - LENGTH + 1
    order = suffix_order(text, LENGTH)
    cuts = prefix_boundaries(text, order, LENGTH) >= 0
    owner = np.repeat(np.arange(len(n)), n)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    shift = 1 + int(np.max(n)).bit_length()
    place = np.full(len(text), np.iinfo(np.int64).max)
    place[begin[owner] + offset] = (turn[owner] << shift) | offset
    in_order = place[order]
    group = np.flatnonzero(np.r_[True, cuts[1:]])
    lowest = np.repeat(np.minimum.reduceat(in_order, group), np.diff(np.r_[group, len(order)]))
    first = np.empty(len(text), np.int64)
    first[order] = lowest
    first = first[begin[owner] + offset]
    whose, where = rank[first >> shift], first & ((1 << shift) - 1)
    new = np.r_[True, (owner[1:] != owner[:-1]) | (whose[1:] != whose[:-1]) | (where[1:] - where[:-1] != 1)]
    head = np.flatnonzero(new)
    length = np.diff(np.r_[head, len(new)])
    return owner[head], offset[head], offset[head] + length, uid[whose[head]], (start[whose] + where)[head]


def _cut_contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (h, g, uid, s, n, ...) with the context's bytes."""
    places = wanted.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("s", "n", "h", "g", "total", "contexts"))).alias("p"))
    rows = docs.join(places, "uid").select("uid", "raw", "p")

    def run(batches):
        for batch in _slices(batches):
            for k in range(batch.num_rows):
                raw, p = batch.column("raw")[k].as_py(), batch.column("p")[k].values
                s, n = p.field("s").to_numpy(), p.field("n").to_numpy()
                cut = pa.array([raw[a : a + b + LENGTH - 1] for a, b in zip(s.tolist(), n.tolist(), strict=True)], pa.binary())
                uid = pa.array(np.full(len(s), batch.column("uid")[k].as_py(), np.int64))
                yield pa.RecordBatch.from_arrays([p.field("h"), p.field("g"), uid, p.field("s"), p.field("total"), p.field("contexts"), cut],
                                                 ["h", "g", "uid", "s", "total", "contexts", "context"])

    return map_arrow(rows, run, "h long, g long, uid long, s long, total long, contexts long, context binary")


_FIRST = "h long, g long, lo int, hi int, uid0 long, s0 long"


def _by_blocks(rows: DataFrame) -> DataFrame:
    """First places of the starts of whole buckets, by suffix order in blocks of buckets."""

    def solve(table: pa.Table):
        h, g, uid, s, total = (table.column(c).to_numpy() for c in ("h", "g", "uid", "s", "total"))
        contexts = table.column("context").to_pylist()
        who, lo, hi, uid0, s0 = first_places(contexts, uid, s)
        # A context that is there once and whose strings are all first has nothing to tell.
        news = (total[who] > 1) | (uid0 != uid[who]) | (s0 != s[who] + lo)
        who = who[news]
        return pa.RecordBatch.from_arrays(
            [pa.array(h[who]), pa.array(g[who]), pa.array(lo[news].astype(np.int32)), pa.array(hi[news].astype(np.int32)),
             pa.array(uid0[news]), pa.array(s0[news])], ["h", "g", "lo", "hi", "uid0", "s0"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            # The last bucket may go on in the next batch.
            held.append(batch)
            size += batch.get_total_buffer_size()
            if size >= BLOCK:
                table = pa.Table.from_batches(held).combine_chunks()
                h = table.column("h").to_numpy()
                edges = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
                at, weight = 0, np.cumsum(np.asarray(pa.compute.binary_length(table.column("context"))))
                for k in range(1, len(edges)):
                    if weight[edges[k] - 1] - (weight[at - 1] if at else 0) >= BLOCK:
                        yield solve(table.slice(at, edges[k] - at))
                        at = edges[k]
                held = table.slice(at).to_batches()
                size = int(weight[-1] - (weight[at - 1] if at else 0))
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            if table.num_rows:
                yield solve(table)

    parts = rows.select("h", "g", "uid", "s", "total", "context").repartition("h").sortWithinPartitions("h")
    return map_arrow(parts, run, _FIRST)


def _by_strings(rows: DataFrame) -> DataFrame:
    """First places of the starts of large buckets, by the strings' hashes."""

    def run(batches):
        for batch in _slices(batches):
            h, g, uid, s = (batch.column(c).to_numpy() for c in ("h", "g", "uid", "s"))
            contexts = batch.column("context").to_pylist()
            n = np.array([len(c) - LENGTH + 1 for c in contexts])
            off = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            key = [hashlib.blake2b(c[a : a + LENGTH], digest_size=16).digest() for c in contexts for a in range(len(c) - LENGTH + 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(h, n)), pa.array(np.repeat(g, n)), pa.array(off.astype(np.int32)), pa.array(np.repeat(uid, n)),
                 pa.array(np.repeat(s, n) + off), pa.array(key, pa.binary())], ["h", "g", "lo", "uid", "s", "key"])

    starts = written(map_arrow(rows.select("h", "g", "uid", "s", "context"), run, "h long, g long, lo int, uid long, s long, key binary"), "suffix-strings")
    first = written(starts.groupBy("key").agg(F.min(F.struct("uid", "s")).alias("f")), "suffix-firsts")
    return starts.join(first, "key").select("h", "g", "lo", (F.col("lo") + 1).alias("hi"), F.col("f.uid").alias("uid0"), F.col("f.s").alias("s0"))


def _numbered(docs: DataFrame) -> DataFrame:
    """doc_id, uid and raw of every row; uid grows with doc_id."""
    rows = docs.select("doc_id", text_or_empty().cast("binary").alias("raw"))
    ids = rows.select("doc_id")
    plain = ids.schema["doc_id"].dataType.typeName() in ("long", "integer")
    odd = not plain or ids.filter("doc_id IS NULL").union(ids.groupBy("doc_id").count().filter("count > 1").select("doc_id")).limit(1).count()
    if not odd:
        return rows.withColumn("uid", F.col("doc_id").cast("long"))
    order = [F.col("doc_id").asc_nulls_last(), F.sha2("raw", 256)]
    return written(rows.orderBy(*order).withColumn("uid", F.monotonically_increasing_id()), "suffix-numbered")


def repeated_spans(docs: DataFrame, bucket: int = BUCKET, hot_sample: int = HOT_SAMPLE, hot_rows: int = HOT_ROWS) -> DataFrame:
    """uid, lo, hi: ranges of starts (hi not among them) in (uid, raw) whose string also starts earlier."""
    spark = docs.sparkSession
    docs = docs.select("uid", "raw")
    hot = hot_anchors(docs, hot_sample, hot_rows)
    found = written(_repeated(_anchor_rows(docs, hot)), "suffix-ranges")
    release(spark)
    start, end, stop = F.col("s"), F.col("s") + F.col("n"), F.col("s") + F.col("n") * F.col("reps")
    # Where the bucket is one context, all but its first place repeat it; of a row of repeated ranges all but the first do.
    spans = found.filter("contexts = 1 AND (NOT first OR reps > 1)").select(
        "uid", F.when(F.col("first"), end).otherwise(start).alias("lo"), stop.alias("hi"))

    several = found.filter("contexts > 1")
    cut = written(_cut_contexts(docs, several.filter("first")), "suffix-cut")
    release(spark)
    first = written(_by_blocks(cut.filter(F.col("contexts") <= bucket)), "suffix-first")
    large = cut.filter(F.col("contexts") > bucket)
    if large.limit(1).count():
        first = first.union(_by_strings(large))
    here = several.select("h", "g", "uid", "s", "n", "reps").join(first, ["h", "g"])
    # The starts of a range whose string is first elsewhere, and the repetitions of a range.
    lo, hi = F.col("s") + F.col("lo"), F.col("s") + F.col("hi")
    parts = F.array(
        F.when((F.col("uid") != F.col("uid0")) | (lo != F.col("s0")), F.struct(lo.alias("lo"), hi.alias("hi"))),
        F.when((F.col("reps") > 1) & (F.col("lo") == 0), F.struct(end.alias("lo"), stop.alias("hi"))))
    spans = spans.union(here.select("uid", F.explode(F.filter(parts, lambda x: x.isNotNull())).alias("x")).select("uid", "x.lo", "x.hi"))
    if hot is not None:
        starts = written(_hot_starts(docs, hot), "suffix-hot")
        firsts = starts.groupBy("a", "b").agg(F.min(F.struct("uid", "s")).alias("f"))
        firsts = written(firsts.select("a", "b", F.col("f.uid").alias("uid0"), F.col("f.s").alias("s0")), "suffix-hot-first")
        again = starts.join(firsts, ["a", "b"]).filter((F.col("uid") != F.col("uid0")) | (F.col("s") != F.col("s0")))
        spans = spans.union(again.select("uid", F.col("s").alias("lo"), (F.col("s") + 1).alias("hi")))
    return spans


def strip_repeats(docs: DataFrame, bucket: int = BUCKET, with_text: bool = False, **hot) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes) of every row."""
    spark, rows = docs.sparkSession, _numbered(docs)
    spans = written(repeated_spans(rows, bucket, **hot), "suffix-spans")
    release(spark)
    drop = spans.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("drop"))
    whole = rows.join(drop, "uid", "left").select("doc_id", "raw", "drop")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text

    def run(batches):
        for batch in _slices(batches):
            out = []
            for raw, drop in zip(batch.column("raw").to_pylist(), batch.column("drop"), strict=True):
                removed, spans, at, parts = 0, 0, 0, []
                if drop.is_valid:
                    lo, hi = (drop.values.field(k).to_numpy() for k in ("lo", "hi"))
                    hi = np.maximum.accumulate(hi) + LENGTH - 1  # bytes covered
                    new = np.flatnonzero(np.r_[True, lo[1:] > hi[:-1]])
                    lo, hi = lo[new], hi[np.r_[new[1:] - 1, len(hi) - 1]]
                    removed, spans = int((hi - lo).sum()), len(lo)
                    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
                        parts.append(raw[at:a])
                        at = b
                kept = b"".join([*parts, raw[at:]])
                out.append((len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)][: len(names) - 1]], names)

    kind = dict(whole.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return map_arrow(whole, run, schema)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strip_repeats(documents(spark, sf_dir))
