"""Operator 10, near-dedup with bottom-k sketches of one hash function.

A document is the set of its distinct shingles of ``words`` words; two are linked at
100 |A & B| >= ``percent`` |A | B|. A ``Rule`` holds both and the bounds that follow from them: the
query's is 3 words and 85 (its contract), the pipeline's stage takes 5 words and 80.

1. One pass hashes each set and keeps its ``K`` smallest values (all of them in small sets).
   Documents with equal sets (128 bits of a digest) become one class and go on as one.
2. Inverted lists of retained values generate overlaps. Sketches of linked sets share at least
   ``Rule.shared`` values (small sets: ``percent`` % of them), so they share one of the few rarest in either
   (prefix filtering); only those are listed, and values of one class never are. The classes of
   lists that still are large are listed anew by the same rule on their full sets, where the place of a
   shared value in the two orders of rarity also bounds the overlap.
3. A list's pairs are not all formed. In each of ``STAR_ROUNDS`` rounds a list pairs its members with one
   of them; links merge classes into components, and members of the centre's component need
   no further pair. At the end the pairs that are left, of different components, are formed.
   So a group of near copies costs rows in proportion to its size.
   Only pairs are formed whose sizes and parity bits (256 a set) allow a link, an exact bound.
4. The estimate from the union sketch (its K smallest values, the share in both) drops pairs that
   cannot be linked; the exact Jaccard on the full sets decides.

The one probabilistic step: a pair at exactly the threshold keeps fewer than ``Rule.shared`` of K
values in common, and so may be missed, with probability below 1e-8 (binomial bound; less above
the threshold, 0 for sets of up to percent % of K). Shingles are compared by 64-bit hashes.

Cases: text without words (null, empty) has an empty set, is linked with nothing and is its own
component; fewer words than a shingle has are one shingle; rows with equal ids are separate members with
one id; rows without id can be members, the component's id is its smallest id; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PLACE, documents, map_arrow, placed, places_written, release, rows_at, task_cache, text_or_empty, written
from .pieces import text_slices

K = 64
#: Probability bound of missing a pair at exactly the threshold.
MISS = 1e-8
STAR_ROUNDS = 3
#: Distinct words a worker remembers the hashes of (about 150 bytes each; workers live on between stages).
WORDS_KEPT = 100_000
#: Lists of more members are made anew from full sets.
CROWD = 32
#: Columns of the parity bits.
BITS = ("p0", "p1", "p2", "p3")


@dataclass(frozen=True)
class Rule:
    """Words of a shingle and the percentage of the union that linked sets share."""

    words: int = 3
    percent: int = 85

    def __post_init__(self):
        if self.words < 1 or not 1 <= self.percent <= 100:
            raise ValueError(f"no rule for near copies: {self}")

    @property
    def shared(self) -> int:
        """How many of the union's K smallest values linked sets share: the most that fails with probability below ``MISS``."""
        p, below, m = self.percent / 100, 0.0, 0
        while m < K:
            below += math.comb(K, m) * p**m * (1 - p) ** (K - m)
            if below >= MISS:
                break
            m += 1
        if not m:  # no shared value is sure, so sketches generate nothing
            raise ValueError(f"{K} values a sketch are too few for {self.percent} %")
        return m


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_words = _WordHashes()
task_cache(_words.clear)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(raw: bytes, length: int = Rule.words) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles of ``length`` words."""
    words = raw.lower().split()  # both of bytes: ASCII letters, ASCII white space
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    if len(h) < length:
        out = np.full(1, len(h), np.uint64)
        for x in h:
            out = _mix(out * np.uint64(3) + x)
        return out
    n = len(h) - length + 1
    out = _mix(h[:n])
    for k in range(1, length):
        out = _mix(out * np.uint64(3) + h[k : k + n])
    return np.unique(out)


def parity(shingles: np.ndarray) -> bytes:
    """256 bits: of the shingles that fall on a bit, whether their number is odd. Two sets' bits differ in no more places than
    the sets differ in shingles."""
    return np.packbits((np.bincount((shingles & np.uint64(255)).astype(np.int64), minlength=256) & 1).astype(np.uint8)).tobytes()


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a set's digest as two longs."""
    return struct.unpack("<qq", hashlib.sha256(shingles.tobytes()).digest()[:16])


def _sketched(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, place, n, cid and low (digest of the set, 0 if empty), sketch and parity bits (four longs) of every row."""
    length, kept = rule.words, ["doc_id", *PLACE]

    def run(batches):
        for batch in batches:
            for part, raw in text_slices(batch, "_raw"):
                sets = [shingle_set(t, length) for t in raw]
                both = [_digest(s) if len(s) else (0, 0) for s in sets]
                low = [s[:K].view(np.int64) for s in sets]
                offsets = np.r_[0, np.cumsum([len(x) for x in low])].astype(np.int32)
                sketch = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*low, np.zeros(0, np.int64)])))
                bits = np.frombuffer(b"".join(map(parity, sets)), np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in kept], pa.array([len(s) for s in sets], pa.int64()),
                     *[pa.array([b[k] for b in both], pa.int64()) for k in (0, 1)], sketch, *[pa.array(np.ascontiguousarray(bits[:, k])) for k in range(4)]],
                    [*kept, "n", "cid", "low", "sketch", *BITS])

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select(text_or_empty().cast("binary").alias("_raw"), *kept)
    return map_arrow(rows, run, f"doc_id {kind}, {PLACE[0]} long, {PLACE[1]} long, n long, cid long, low long, sketch array<long>, "
                     + ", ".join(f"{b} long" for b in BITS))


def _told_apart(digests: DataFrame) -> DataFrame:
    """``digests`` with one ``cid`` for each digest of 128 bits: where two share the first 64, all but the least of them
    take a hash of the whole."""
    clash = digests.groupBy("cid").agg(F.min("low").alias("_least"), F.max("low").alias("_most")).filter("_least != _most")
    clash = written(clash.select("cid", "_least"), "near-clashes")  # hardly any, so the join below is broadcast
    own = F.when(F.col("_least").isNull() | (F.col("low") == F.col("_least")), F.col("cid")).otherwise(F.xxhash64("cid", "low"))
    return digests.join(clash, "cid", "left").withColumn("cid", own).drop("_least")


def _prefix_lists(values: DataFrame, held, needed, name: str) -> DataFrame:
    """value, cid, n, rest, members: of each class its rarest values, as far as others list them too. ``values``: (cid, n, value), ``held``
    of them a class; of linked classes each shares at least ``needed`` of its own with the other, so they
    meet in one of the first held - needed + 1 in the order of rarity. ``rest`` counts a class's values from
    this one on in that order, ``members`` the classes of the list."""
    common = values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    mine = values.join(common, "value").groupBy("cid", "n").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("v"))
    # Values that no other class has come first in the order, so they use up the prefix.
    room = held - needed + 1 - (held - F.size("v"))
    prefix = mine.filter(room > 0).select("cid", "n", F.size("v").alias("common"), F.posexplode(F.slice("v", F.lit(1), room.cast("int"))).alias("at", "v"))
    rows = written(prefix.select(F.col("v.value").alias("value"), "cid", "n", (F.col("common") - F.col("at")).alias("rest")), name)
    counts = rows.groupBy("value").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    return rows.join(counts, "value")


def _lists(classes: DataFrame, rule: Rule) -> DataFrame:
    """Inverted lists of the sketches' rarest values."""
    # percent % of the smaller sets, whose partners' sketches are whole sets too; rule.shared of the others.
    needed = F.when(F.col("n") <= K * rule.percent // 100, F.ceil(F.col("n") * rule.percent / 100)).otherwise(F.lit(rule.shared))
    values = classes.select("cid", "n", F.explode("sketch").alias("value"))
    return _prefix_lists(values, F.least(F.col("n"), F.lit(K)), needed, "near-prefixes")


def _refined(lists: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The lists with those of more than ``CROWD`` members replaced. All pairs of a large list have both ends
    among the classes in large lists; for these the same rule on their full sets, whose prefix
    is 100 - percent % of a set and needs no margin for chance, gives lists of fewer and closer classes."""
    large = lists.filter(F.col("members") > CROWD).select("cid").distinct()
    crowd = sets.join(written(large, "near-crowd"), "cid", "left_semi")
    values = crowd.select("cid", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("value"))
    exact = _prefix_lists(values, F.col("n"), F.ceil(F.col("n") * rule.percent / 100), "near-exact-prefixes")
    return lists.filter(F.col("members") <= CROWD).withColumn("exact", F.lit(False)).unionByName(
        exact.withColumn("exact", F.lit(True))).drop("members")


def _near(rule: Rule) -> Column:
    """Whether sizes and parity bits allow a link: linked sets differ in at most (100 - percent) / (100 + percent) of the sum of
    their sizes."""
    differ = sum((F.bit_count(F.col(f"{b}_a").bitwiseXOR(F.col(f"{b}_b"))) for b in BITS[1:]),
                 F.bit_count(F.col(f"{BITS[0]}_a").bitwiseXOR(F.col(f"{BITS[0]}_b"))))
    sizes = 100 * F.least("n_a", "n_b") >= rule.percent * F.greatest("n_a", "n_b")
    return sizes & ((100 + rule.percent) * differ <= (100 - rule.percent) * (F.col("n_a") + F.col("n_b")))


def _side(lists: DataFrame, side: str) -> DataFrame:
    own = ("n", "label", "rest", *BITS)
    return lists.select("value", "exact", F.col("cid").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in own])


def _compatible(rule: Rule) -> Column:
    """Whether two classes that share a value may be linked: their sizes allow it, and, where lists come from
    full sets, so do the values that are left from this one on (if it is the rarest that they share, they share no
    more than these; a linked pair passes at its rarest shared value)."""
    chance = ~F.col("exact") & (F.greatest("n_a", "n_b") > K)
    left = (100 + rule.percent) * F.least("rest_a", "rest_b") >= rule.percent * (F.col("n_a") + F.col("n_b"))
    return _near(rule) & (chance | left)


def _star_pairs(lists: DataFrame, turn: int, rule: Rule) -> DataFrame:
    """Each list's members with one of them, where components differ."""
    order = F.xxhash64("cid", F.lit(turn), F.col("value") % 3)
    own = ["cid", "n", "label", *BITS]
    centre = lists.groupBy("value", "exact").agg(F.min(F.struct(order, *own)).alias("c"))
    centre = centre.select("value", "exact", F.col("c.cid").alias("a"), *[F.col(f"c.{c}").alias(f"{c}_a") for c in own[1:]])
    rows = _side(lists, "b").join(centre, ["value", "exact"])
    return rows.filter((F.col("label_a") != F.col("label_b")) & _near(rule)).select("a", "b").distinct()


def _remaining_pairs(lists: DataFrame, rule: Rule) -> DataFrame:
    """All pairs of a list whose components differ."""
    left, right = _side(lists, "a"), _side(lists, "b")
    return left.join(right, ["value", "exact"]).filter((F.col("label_a") < F.col("label_b")) & _compatible(rule)).select("a", "b").distinct()


def _estimated(pairs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """Pairs whose union sketch leaves a link possible."""
    least = rule.shared
    sketches = classes.select("cid", "sketch")
    rows = (pairs.join(sketches.withColumnsRenamed({"cid": "a", "sketch": "x"}), "a")
            .join(sketches.withColumnsRenamed({"cid": "b", "sketch": "y"}), "b"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            both = np.full((batch.num_rows, 2 * K), np.iinfo(np.uint64).max, np.uint64)
            for name, shift in (("x", 0), ("y", K)):
                col = batch.column(name)
                ends = col.offsets.to_numpy()
                size = np.diff(ends)
                flat = col.flatten().to_numpy().view(np.uint64)
                line = np.repeat(np.arange(batch.num_rows), size)
                both[line, shift + np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], size)] = flat
            size = np.sum(both != np.iinfo(np.uint64).max, axis=1)
            both.sort(axis=1)
            twin = np.zeros(both.shape, bool)
            twin[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != np.iinfo(np.uint64).max)
            rank = np.cumsum(~twin, axis=1)  # place among the distinct values
            union = np.minimum(K, size - twin.sum(axis=1))
            shared = (twin & (rank <= K)).sum(axis=1)
            ok = pa.array(shared * K >= least * union)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(ok)

    return map_arrow(rows.select("a", "b", "x", "y"), run, "a long, b long")


def _links(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Pairs whose full sets meet the threshold."""
    percent = rule.percent
    rows = (pairs.join(sets.withColumnsRenamed({"cid": "a", "shingles": "x"}), "a")
            .join(sets.withColumnsRenamed({"cid": "b", "shingles": "y"}), "b"))

    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                a, b = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(a, b, assume_unique=True))
                ok.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return map_arrow(rows.select("a", "b", "x", "y"), run, "a long, b long")


def _sets_of(docs: DataFrame, wanted: DataFrame, digests: DataFrame, rule: Rule) -> DataFrame:
    """cid and the whole set of the classes in ``wanted`` (cid), from the text of one row of each, which the task that reads its
    file picks."""
    length = rule.words
    one = digests.join(wanted, "cid", "left_semi").groupBy("cid").agg(F.min(F.struct(*PLACE)).alias("at"))
    one = written(one.select("cid", *[F.col(f"at.{c}").alias(c) for c in PLACE]), "near-chosen")
    def run(batches):
        for batch in batches:
            for part, raw in text_slices(batch, "_raw"):
                sets = [shingle_set(t, length).view(np.int64) for t in raw]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in PLACE], pa.array(sets, pa.list_(pa.int64()))], [*PLACE, "shingles"])

    rows = docs.select(text_or_empty().cast("binary").alias("_raw"), *PLACE)
    found = rows_at(rows, places_written(one, "near-places"), then=run, schema=f"{PLACE[0]} long, {PLACE[1]} long, shingles array<long>")
    return found.join(one, list(PLACE)).select("cid", "shingles")


def components(edges: DataFrame) -> DataFrame:
    """v, label (the smallest vertex of its component) of every vertex of ``edges`` (a, b), by min labels and pointer jumping."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near-edges")
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("label")), "near-labels")
    while True:
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("m"))
        low = labels.join(near, "v").select("v", F.least("label", "m").alias("label"), F.col("label").alias("old"))
        # Jump: a label is a vertex, whose own label may be lower.
        jump = labels.select(F.col("v").alias("label"), F.col("label").alias("further"))
        new = written(low.join(jump, "label").select("v", F.least("label", "further").alias("label"), "old"), "near-labels")
        changed = new.filter("label != old").limit(1).count()
        labels = new.select("v", "label")
        if not changed:
            return labels


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (cid, label) after the components that ``links`` connect became one."""
    a, b = (labels.withColumnsRenamed({"cid": c, "label": f"label_{c}"}) for c in "ab")
    edges = links.join(a, "a").join(b, "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))
    found = components(edges.filter("a != b").distinct())
    found = found.select(F.col("v").alias("label"), F.col("label").alias("to"))
    return written(labels.join(found, "label", "left").select("cid", F.coalesce("to", "label").alias("label")), "near-components")


def near_groups(docs: DataFrame, star_rounds: int = STAR_ROUNDS, words: int = Rule.words, percent: int = Rule.percent) -> DataFrame:
    """doc_id, n_shingles, component_id of every row, by shingles of ``words`` words and a Jaccard of ``percent`` % or more."""
    return _grouped(placed(docs, "near-rows"), star_rounds, Rule(words, percent)).drop(*PLACE)


def _grouped(docs: DataFrame, star_rounds: int, rule: Rule) -> DataFrame:
    """As ``near_groups``, with the rows' places."""
    spark = docs.sparkSession
    digests = _told_apart(written(_sketched(docs, rule), "near-sketches"))
    # One row a class: its copies (equal sets have equal sketches) meet in a partial aggregate.
    classes = written(digests.filter("n > 0").groupBy("cid").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"),
                                                                  *[F.first(b).alias(b) for b in BITS]), "near-classes")
    lists = written(_lists(classes, rule), "near-sketch-lists")
    release(spark)
    wanted = written(lists.select("cid").distinct(), "near-wanted")
    sets = written(_sets_of(docs, wanted, digests, rule), "near-sets")
    lists = written(_refined(lists, sets, rule), "near-lists")
    release(spark)
    bits = written(classes.select("cid", *BITS).join(wanted, "cid", "left_semi"), "near-bits")
    labels, tested = wanted.withColumn("label", F.col("cid")), None
    for turn in range(star_rounds + 1):
        members = lists.join(labels, "cid").join(bits, "cid")
        pairs = _star_pairs(members, turn, rule) if turn < star_rounds else _remaining_pairs(members, rule)
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = written(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "near-pairs")
        links = written(_links(_estimated(pairs, classes, rule), sets, rule), "near-links")
        labels = _merged(labels, links)
        tested = pairs if tested is None else tested.union(pairs)
    rows = digests.select("doc_id", *PLACE, "n", "cid").join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    smallest = written(rows.filter("n > 0").groupBy("label").agg(F.min("doc_id").alias("_first")), "near-smallest")
    out = rows.join(smallest, "label", "left")
    return out.select("doc_id", *PLACE, F.col("n").alias("n_shingles"),
                      F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("_first")).alias("component_id"))


def drop_near_copies(docs: DataFrame, words: int = Rule.words, percent: int = Rule.percent) -> DataFrame:
    """The documents whose id is their component's, with their columns as they came."""
    docs = placed(docs, "near-rows")
    found = _grouped(docs, STAR_ROUNDS, Rule(words, percent)).filter(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    return rows_at(docs, places_written(found, "near-dropped"), named=False)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(documents(spark, sf_dir))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
