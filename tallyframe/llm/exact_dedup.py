"""Operator 6, exact dedup with counting quotient filters.

Texts are equal when their bytes are, after each run of ASCII white space became one blank.
Each partition of the digests builds counting quotient filters of its 64-bit fingerprints, one
a shard (the fingerprints' leading bits). The filters of a shard merge losslessly: their
entries come out in order of (quotient, remainder), which is the order of the fingerprints, so
merging is a merge of sorted lists that adds up counts. Fingerprints with a count above one
route their documents to byte verification: grouping by the whole normalised text, with a
partial aggregate before the shuffle, so a group of copies is one row a task however large it is.

Scale: the filters hold about 8 bytes a distinct fingerprint of the partition; a shard is kept near ``SHARD``
rows by the number of shards. Only the texts of candidates are shuffled: rows are named by their places in the input's
files, and the tasks that read the files pick them by bitmaps.

Cases: null text is empty and empty texts are equal; of rows with one text the smallest doc_id
stays, null ids come last; rows that repeat both id and text all name that id (and
``drop_copies`` keeps one of them); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PLACE, documents, map_arrow, placed, places_written, rows_at, ship, text_or_empty, written
from .pieces import text_slices

SHARD = 500_000
_SPACE = frozenset(b" \t\n\x0b\x0c\r")


def normalised(raw: bytes) -> bytes:
    """Each run of ASCII white space as one blank."""
    core = b" ".join(raw.split())
    if not raw or raw[0] not in _SPACE and raw[-1] not in _SPACE:
        return core
    return (b" " if raw[0] in _SPACE else b"") + core + (b" " if core and raw[-1] in _SPACE else b"")


class QuotientFilter:
    """Counting quotient filter of 64-bit fingerprints.

    A fingerprint is a quotient (its leading ``q`` bits) and a remainder. Bit k of ``occupied``
    says that quotient k has a run; runs follow each other in quotient order, their remainders sorted,
    and ``run_ends`` marks the last slot of each. A slot marked in ``counted`` is followed by
    its counter; other remainders count one. The run of a quotient is found by rank over
    ``occupied`` and select over ``run_ends``.
    """

    def __init__(self, q: int, occupied: np.ndarray, run_ends: np.ndarray, counted: np.ndarray, slots: np.ndarray):
        self.q, self.occupied, self.run_ends, self.counted, self.slots = q, occupied, run_ends, counted, slots

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None) -> QuotientFilter:
        """From fingerprints in any order, or from sorted distinct ones with their counts."""
        if counts is None:
            fingerprints, counts = np.unique(fingerprints.astype(np.uint64), return_counts=True)
        q = max(1, int(len(fingerprints)).bit_length())
        quotient = (fingerprints >> np.uint64(64 - q)).astype(np.int64)
        remainder = fingerprints & np.uint64((1 << (64 - q)) - 1)
        occupied = np.zeros(1 << q, bool)
        occupied[quotient] = True
        many = counts > 1
        place = np.arange(len(fingerprints)) + np.cumsum(many) - many  # counters take slots too
        size = len(fingerprints) + int(many.sum())
        slots, counted, ends = np.zeros(size, np.uint64), np.zeros(size, bool), np.zeros(size, bool)
        slots[place] = remainder
        counted[place[many]] = True
        slots[place[many] + 1] = counts[many].astype(np.uint64)
        if len(quotient):
            ends[place[np.r_[quotient[1:] != quotient[:-1], True]]] = True
        return cls(q, occupied, ends, counted, slots)

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints in ascending order and their counts."""
        is_counter = np.r_[False, self.counted[:-1]] if len(self.slots) else np.zeros(0, bool)
        place = np.flatnonzero(~is_counter)
        run = np.cumsum(self.run_ends[place]) - self.run_ends[place]
        quotient = np.flatnonzero(self.occupied)[run].astype(np.uint64)
        counts = np.ones(len(place), np.int64)
        many = self.counted[place]
        counts[many] = self.slots[place[many] + 1].astype(np.int64)
        return (quotient << np.uint64(64 - self.q)) | self.slots[place], counts

    def count(self, fingerprint: int) -> int:
        """How often a fingerprint was added."""
        quotient = fingerprint >> (64 - self.q)
        if not self.occupied[quotient]:
            return 0
        ends = np.flatnonzero(self.run_ends)
        rank = int(np.count_nonzero(self.occupied[:quotient]))
        at = 0 if rank == 0 else int(ends[rank - 1]) + 1 + bool(self.counted[ends[rank - 1]])
        while at <= ends[rank]:
            if int(self.slots[at]) == fingerprint & ((1 << (64 - self.q)) - 1):
                return int(self.slots[at + 1]) if self.counted[at] else 1
            at += 1 + bool(self.counted[at])
        return 0

    def merged(self, other: QuotientFilter) -> QuotientFilter:
        """Both filters' entries in sorted order, counts of equal fingerprints added."""
        (a, m), (b, n) = self.entries(), other.entries()
        place = np.argsort(np.r_[a, b], kind="stable")
        prints, counts = np.r_[a, b][place], np.r_[m, n][place]
        if not len(prints):
            return self
        first = np.flatnonzero(np.r_[True, prints[1:] != prints[:-1]])
        return QuotientFilter.of(prints[first], np.add.reduceat(counts, first))

    def to_bytes(self) -> bytes:
        size = np.array([self.q, len(self.slots)], "<u8").tobytes()
        return size + b"".join(np.packbits(x).tobytes() for x in (self.occupied, self.run_ends, self.counted)) + self.slots.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> QuotientFilter:
        q, n = (int(x) for x in np.frombuffer(raw, "<u8", 2))
        at, bits = 16, []
        for size in (1 << q, n, n):
            width = -(-size // 8)
            bits.append(np.unpackbits(np.frombuffer(raw, np.uint8, width, at), count=size).astype(bool))
            at += width
        return cls(q, *bits, np.frombuffer(raw, np.uint64, n, at).copy())


def _digested(rows: DataFrame) -> DataFrame:
    """doc_id, the row's place, fp (64 bits of the digest) and sha (of the normalised text)."""
    kept = ["doc_id", *PLACE]

    def run(batches):
        for batch in batches:
            for part, raw in text_slices(batch, "_raw"):
                sha = [hashlib.sha256(normalised(t)).digest() for t in raw]
                fp = np.frombuffer(b"".join(s[:8] for s in sha), ">i8").astype(np.int64)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(fp, pa.int64()), pa.array(sha, pa.binary())],
                                                 [*kept, "fp", "sha"])

    kind = dict(rows.dtypes)["doc_id"]
    return map_arrow(rows.select("_raw", *kept), run, f"doc_id {kind}, {PLACE[0]} long, {PLACE[1]} long, fp long, sha binary")


def repeated_fingerprints(digests: DataFrame, shard_rows: int = SHARD) -> DataFrame:
    """fp and n of every fingerprint that counts more than one over all partitions."""
    shards = -(-digests.count() // shard_rows)
    bits = max(1, int(max(0, shards - 1)).bit_length())

    def build(batches):
        seen = [b.column("fp").to_numpy() for b in batches]
        if not seen:
            return
        prints = np.sort(np.concatenate(seen).view(np.uint64))
        edges = np.searchsorted(prints, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
        for k, p in enumerate(np.split(prints, edges)):
            if len(p):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([QuotientFilter.of(p).to_bytes()], pa.binary())], ["shard", "filter"])

    def merge(table: pa.Table) -> pa.Table:
        whole = [QuotientFilter.from_bytes(x.as_py()) for x in table.column("filter")]
        while len(whole) > 1:  # pairwise, so each entry is copied log times
            whole = [a.merged(b) for a, b in zip(whole[::2], whole[1::2], strict=False)] + whole[len(whole) & ~1 :]
        prints, counts = whole[0].entries()
        many = counts > 1
        return pa.table({"fp": prints[many].view(np.int64), "n": counts[many]})

    ship(digests.sparkSession)
    built = digests.select("fp").mapInArrow(build, "shard int, filter binary")
    return built.groupBy("shard").applyInArrow(merge, "fp long, n long")


def _grouped(rows: DataFrame, shard_rows: int) -> DataFrame:
    """Every row's doc_id, place and sha, with keep_id, group_size and the place of the row that stays of its group (null where
    the group is the row alone). ``rows``: doc_id, _raw and places."""
    digests = written(_digested(rows), "dedup-digests")
    repeated = written(repeated_fingerprints(digests, shard_rows), "dedup-repeated")
    flagged = digests.join(repeated, "fp", "left_semi")
    kept = ["doc_id", *PLACE]

    def normalise(batches):
        for batch in batches:
            for part, raw in text_slices(batch, "_raw"):
                text = pa.array([normalised(t) for t in raw], pa.binary())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], text], [*kept, "text"])

    kind = dict(rows.dtypes)["doc_id"]
    candidates = rows_at(rows.select("_raw", *kept), places_written(flagged, "dedup-candidates"), then=normalise,
                         schema=f"doc_id {kind}, {PLACE[0]} long, {PLACE[1]} long, text binary")
    # Null ids come last, rows of one id in order of their places.
    stays = F.min(F.struct(F.col("doc_id").isNull().alias("none"), *[F.col(c) for c in kept])).alias("stays")
    classes = (
        candidates
        .groupBy("text").agg(stays, F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
        .select(F.unhex(F.sha2("text", 256)).alias("sha"), "stays", "group_size")
    )
    classes = written(classes, "dedup-classes")
    return digests.join(classes, "sha", "left").select(
        "doc_id", *PLACE, "sha", "stays",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("stays.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"))


def _raw_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_or_empty().cast("binary").alias("_raw"), *PLACE)


def groups(docs: DataFrame, shard_rows: int = SHARD) -> DataFrame:
    """Every row's doc_id and sha, with keep_id and group_size of its group."""
    return _grouped(_raw_rows(placed(docs, "dedup-rows")), shard_rows).select("doc_id", "sha", "keep_id", "group_size")


def drop_copies(docs: DataFrame, shard_rows: int = SHARD) -> DataFrame:
    """The documents that stay, one row a group, with their columns as they came."""
    docs = placed(docs, "dedup-rows")
    found = _grouped(_raw_rows(docs), shard_rows)
    here = F.struct(*PLACE) == F.struct(*[F.col(f"stays.{c}") for c in PLACE])
    return rows_at(docs, places_written(found.filter(F.col("stays").isNotNull() & ~here), "dedup-dropped"), named=False)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(documents(spark, sf_dir)).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


OP6_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
    doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n"""
