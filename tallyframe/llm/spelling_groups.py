"""Operator 13, spelling variants by PartEnum signatures.

Words are counted over all texts. Two words are near if one inserted, deleted or replaced code
point turns one into the other. Seen as binary vectors over (letter, k-th occurrence), their letter multisets then
have Hamming distance 1 (lengths differ by one) or at most 2 (equal lengths). PartEnum makes
that an equi-join: the letters fall into ``PARTS`` classes, so at most d classes hold a difference, and some choice of
PARTS - d classes holds none. Every word emits its projection on each such choice; near words share one.

A signature also carries a half of the word: of near words either the first halves are equal or the
rest is. That keeps the projections of a large vocabulary apart. A signature that still has more than
``crowd`` words is emitted again for each place of the other half, with the word that is left without that
place: those who share one are near, so no pair is formed in vain. Candidates are verified by edit distance.

Scale: one pass counts words (map-side combine, so a word may hold any share of the corpus); the join
works on the vocabulary and its rows have bounded size. Skewed keys are left to AQE. Forms are followed by pointer
doubling: the count grows at least by ``growth`` a step, which bounds the rounds by the largest count.

Cases: null or empty texts have no words; a null id hashes as empty text; repeated rows count as often as they stand; an
empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, text_or_empty, written

RUN = r"([A-Za-zÀ-ÿ]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs whose hash is divisible by this lose a code point.
NOISE = 199
MIN_LENGTH, MIN_COUNT, GROWTH = 6, 5, 5
PARTS = 4
CROWD = 64


def lower_ascii(word: Column) -> Column:
    """``word`` with only A-Z lower-cased; words that ``lower`` leaves alone are not translated."""
    return F.when(F.lower(word) == word, word).otherwise(F.translate(word, UPPER, LOWER))


def count_words(docs: DataFrame, noise: int = NOISE, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words of at least ``min_length`` code points and ``min_count`` occurrences."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(text_or_empty(), F.lit(RUN), F.lit(1))).alias("run"))
    runs = runs.where(F.char_length("run") >= min_length).select("id", lower_ascii(F.col("run")).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    words = runs.select(F.when(F.col("h") % noise == 0, cut).otherwise(F.col("run")).alias("word"))
    found = words.where(F.char_length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return found.where(F.col("n") >= min_count)


def letter_classes(words: DataFrame, parts: int = PARTS) -> list[str]:
    """The letters of ``words`` in ``parts`` classes of about equal weight (the alphabet is at most 90 letters)."""
    letters = words.select(F.explode(F.split("word", "")).alias("c")).groupBy("c").count()
    classes, load = [""] * parts, [0] * parts
    for r in sorted(letters.collect(), key=lambda r: (-r["count"], r["c"])):
        k = load.index(min(load))
        classes[k] += r["c"]
        load[k] += r["count"]
    return classes


def _projections(classes: list[str]) -> list[Column]:
    """The letters of each class in the word, sorted: the projection of its multiset."""
    out = []
    for k in range(len(classes)):
        others = "".join(c for i, c in enumerate(classes) if i != k)
        out.append(F.array_join(F.array_sort(F.split(F.translate("word", others, "") if others else F.col("word"), "")), ""))
    return out


def _part(start: Column | int, length: Column) -> Column:
    return F.substring(F.col("word"), F.lit(start) if isinstance(start, int) else start, length)


def signatures(words: DataFrame, classes: list[str]) -> DataFrame:
    """(key, role, side, word, n): near words share the key of one role 0 row, or the key of a role 1 and a role 2 row.

    Roles: 0 for equal lengths (distance 2), 1 as the shorter and 2 as the longer of two (distance 1). Side 0 carries
    the first half, side 1 the rest. A collision of the 64-bit key only adds a candidate.
    """
    p, size = [F.col(f"p{k}") for k in range(len(classes))], F.char_length("word")
    half = F.floor(size / 2).cast("int")  # of the shorter word, if lengths differ
    less = F.floor((size - 1) / 2).cast("int")
    sides = {0: (_part(1, half), _part(half + 1, size)), 1: (_part(1, half), _part(half + 1, size)), 2: (_part(1, less), _part(less + 2, size))}
    rows = []
    for role, (first, rest) in sides.items():
        length = size - 1 if role == 2 else size
        for kept in combinations(range(len(classes)), len(classes) - (2 if role == 0 else 1)):
            for side, text in ((0, first), (1, rest)):
                key = F.xxhash64(F.lit(min(role, 1)), F.lit(side), length, text, F.lit(str(kept)), *[p[k] for k in kept])
                rows.append(F.struct(key.alias("key"), F.lit(role).cast("byte").alias("role"), F.lit(side).cast("byte").alias("side")))
    projected = words.select("word", "n", *[x.alias(f"p{k}") for k, x in enumerate(_projections(classes))])
    return projected.select("word", "n", F.inline(F.array(*rows)))


def _uncrowded(rows: DataFrame, crowd: int) -> DataFrame:
    """``rows`` with every key of more than ``crowd`` words replaced by one key for each place of the other half."""
    counts = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("of")).where(F.col("of") > crowd), "spelling-crowds")
    rows = rows.join(counts, "key", "left")
    size = F.char_length("word")
    half = F.floor((size - (F.col("role") == 2).cast("int")) / 2).cast("int")  # of the shorter word
    low = F.when(F.col("side") == 0, half + 1).otherwise(1)
    high = F.when(F.col("side") == 0, size).when(F.col("role") == 2, half + 1).otherwise(half)
    without = lambda i: F.concat(_part(1, i - 1), _part(i + 1, size))
    spread = lambda i: F.when(F.col("role") == 0, F.xxhash64("key", i, without(i))).when(
        F.col("role") == 2, F.xxhash64("key", without(i))).otherwise(F.xxhash64("key", "word"))
    # The shorter word is what the longer one becomes: one row, not one a place.
    places = F.when(F.col("role") == 1, F.array(F.lit(1))).otherwise(F.sequence(low, high))
    keys = F.when(F.col("of").isNull(), F.array("key")).otherwise(F.array_distinct(F.transform(places, spread)))
    return rows.select(F.explode(keys).alias("key"), "role", "word", "n")


def near_pairs(words: DataFrame, parts: int = PARTS, crowd: int = CROWD) -> DataFrame:
    """(word, n, near, near_n) for every two words of ``words`` (word, n) that are near, both ways round."""
    rows = _uncrowded(written(signatures(words, letter_classes(words, parts)), "spelling-signatures"), crowd)
    rows = written(rows, "spelling-keys")
    b = rows.select("key", F.col("role").alias("b_role"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    equal = rows.where("role = 0").join(b.where("b_role = 0"), "key").where(F.col("word") < F.col("near"))
    other = rows.where("role = 1").join(b.where("b_role = 2"), "key")
    names = ["word", "n", "near", "near_n"]
    found = equal.select(*names).unionByName(other.select(*names)).where(F.levenshtein("word", "near", 1) == 1)
    found = written(found.distinct(), "spelling-pairs")
    return found.unionByName(found.select(F.col("near").alias("word"), F.col("near_n").alias("n"),
                                          F.col("word").alias("near"), F.col("n").alias("near_n")))


def _roots(forms: DataFrame, rounds: int) -> DataFrame:
    """(word, root) from (word, form): after k rounds 2^k forms are followed."""
    found = forms.select("word", F.col("form").alias("root"))
    for _ in range(rounds):
        ahead = found.select(F.col("word").alias("_at"), F.col("root").alias("_on"))
        found = written(found.join(ahead, F.col("root") == F.col("_at"), "left").select(
            "word", F.coalesce("_on", "root").alias("root")), "spelling-roots")
    return found


def group_variants(words: DataFrame, growth: int = GROWTH, parts: int = PARTS, crowd: int = CROWD) -> DataFrame:
    """Every word of ``words`` (word, n) with its form, the root of its forms and its near words.

    The form is the near word of largest n, ties to the smaller word, if it has at least ``growth`` times the word's n.
    """
    if growth < 2:
        raise ValueError("growth must be 2 or more, so that forms have no cycles")
    pairs = near_pairs(words, parts, crowd)
    best = pairs.groupBy(F.col("word").alias("_word")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    has = F.col("_word").isNotNull() & (-F.col("best.less") >= growth * F.col("n"))
    rows = words.join(best, F.col("word") == F.col("_word"), "left").select(
        "word", F.when(has, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has, -F.col("best.less")).alias("form_n"))
    rows = written(rows, "spelling-forms")
    most = rows.agg(F.max("n"), F.min("n")).first()
    steps = math.floor(math.log(most[0] / most[1], growth)) + 1 if most[0] else 0  # counts along a chain of forms
    roots = _roots(rows.where(F.col("form").isNotNull()), math.ceil(math.log2(steps)) if steps > 1 else 0)
    roots = roots.select(F.col("word").alias("_word"), "root")
    return rows.join(roots, F.col("word") == F.col("_word"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(written(count_words(documents(spark, sf_dir)), "spelling-words"))


def _crc_sql(text: str) -> str:
    """DuckDB: unsigned crc32 of the UTF-8 bytes of ``text`` (code points below U+0800) by the table ``t``."""
    octets = (f"flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] "
              "ELSE [192 + (ord(c) >> 6)::BIGINT, 128 + (ord(c) & 63)::BIGINT] END))")
    return f"xor(list_reduce({octets}, lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)"


#: DuckDB, by neighbourhoods in place of signatures: what is left of a word without one place.
OP13_SQL = f"""
WITH RECURSIVE crc_table AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda a, b:
    CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i::BIGINT) AS v FROM range(256) r(i))),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')),
    '{UPPER}', '{LOWER}') AS run FROM documents),
told AS (SELECT id, run, count(*) AS k FROM runs WHERE length(run) >= {MIN_LENGTH} GROUP BY ALL),
hashed AS (SELECT run, k, {_crc_sql("id || ':' || run")} AS h FROM told, crc_table),
made AS (SELECT CASE WHEN h % {NOISE} = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM hashed),
words AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM made WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(k) >= {MIN_COUNT}),
places AS (SELECT word, n, i, left(word, i::INT) || substr(word, i::INT + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS MATERIALIZED (
    SELECT DISTINCT a.word, b.word AS other, b.n FROM places a JOIN places b ON a.i = b.i AND a.rest = b.rest AND length(a.word) = length(b.word) AND a.word <> b.word
    UNION SELECT DISTINCT a.word, b.word, b.n FROM places a JOIN words b ON a.rest = b.word
    UNION SELECT DISTINCT b.word, a.word, a.n FROM places a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, min({{'less': -n, 'word': encode(other)}}) AS b FROM near GROUP BY word),
forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -b.less >= {GROWTH} * w.n THEN decode(b.word) END AS form,
    CASE WHEN -b.less >= {GROWTH} * w.n THEN -b.less END AS form_n FROM words w LEFT JOIN best ON w.word = best.word),
chain AS (SELECT word, form AS at FROM forms WHERE form IS NOT NULL
    UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON c.at = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.at FROM chain c JOIN forms f ON c.at = f.word WHERE f.form IS NULL)
SELECT f.word, f.form, coalesce(e.at, f.word) AS root, f.n, f.n_near, f.form_n FROM forms f LEFT JOIN ends e ON f.word = e.word"""
