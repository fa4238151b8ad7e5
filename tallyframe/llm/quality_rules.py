"""Operator 7, quality rules: adaptive thresholds from mergeable quantile sketches.

Every document gets five measures (see ``with_measures``). Per (language, source) one
KLL sketch a measure is built map-side and merged; sketches of all sources of a language,
and of all languages, are merged from those without reading documents again. A group's
upper fence is q75 + 3 (q75 - q25) + a fixed margin (and a lower fence for word length),
from the most specific level that holds at least ``min_rows`` documents. The fences are
joined to the measures and documents outside of one are rejected, besides those that fail
the base rule (fewer than 10 words, or over 20 % of the words in repeated 5-word windows).

Everything is DataFrame functions: no Python runs on the executors.

Cases: null or empty text has no words (all counts 0, base rule fails, not kept); null
language or source is a group of its own; repeated rows are judged one by one; an empty
table gives an empty result; extra columns pass through ``apply_rules`` untouched,
whatever their names. A sketch of up to ``k`` values is exact; beyond, thresholds carry the
rank error of KLL (about 0.1 % at the default ``k``) and are fixed once per run by writing
them down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, written

SKETCH_K = 4096
MIN_ROWS = 50
#: Measure -> margin added beyond the fence, in the measure's unit (thousandths).
MARGINS = {"symbols": 100, "dup_lines": 400, "repeats": 200, "word_len": 2500}

_WORDS = r"filter(split(_text, '[ \\t\\n\\x0B\\f\\r]+'), x -> x <> '')"
_SPACES = r"concat(' ', char(9), char(10), char(11), char(12), char(13))"
# Words covered by 5-word windows that occur twice: hash the windows, sort (hash, place),
# keep the places with an equal neighbour, sum the union of the windows. transform(array(x))
# binds x once; a plain reference would be computed again for each element.
_REPEATS = """
CASE WHEN size(_words) < 6 THEN 0L ELSE
transform(array(sort_array(transform(sequence(0, size(_words) - 5),
    i -> named_struct('h', xxhash64(_words[i], _words[i+1], _words[i+2], _words[i+3], _words[i+4]), 'i', i)))),
  s -> aggregate(
         sort_array(transform(
           filter(s, (x, k) -> (k > 0 AND s[greatest(k - 1, 0)].h = x.h)
                            OR (k + 1 < size(s) AND s[least(k + 1, size(s) - 1)].h = x.h)),
           x -> x.i)),
         named_struct('n', 0L, 'last', -5),
         (a, i) -> named_struct('n', a.n + least(5, i - a.last), 'last', i)).n)[0] END
"""


def with_measures(docs: DataFrame) -> DataFrame:
    """``_row`` (the whole input row) with the counts of the contract and the measures."""
    rows = docs.select(F.struct("*").alias("_row"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("_text"),
                       docs["lang"].cast("string").alias("_lang"), docs["source"].cast("string").alias("_source"))
    # The array of words is bound once by the inner transform (see _REPEATS).
    counts = F.expr(f"""transform(array({_WORDS}), _words -> named_struct(
        'n_words', CAST(size(_words) AS BIGINT), 'n_repeat_words', CAST({_REPEATS} AS BIGINT)))[0]""")
    lines = F.expr(r"filter(split(_text, '\n'), x -> x rlike '[^ \\t\\x0B\\f\\r]')")
    return (
        rows.withColumn("_c", counts)
        .withColumn("_l", F.transform(F.array(lines), lambda a: F.struct(
            F.size(a).cast("long").alias("n"), (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("dup")))[0])
        .select(
            "_row", "_lang", "_source",
            F.col("_c.n_words").alias("n_words"),
            F.expr(f"CAST(length(translate(_text, {_SPACES}, '')) AS BIGINT)").alias("word_chars"),
            F.expr("CAST(length(_text) - length(translate(_text, '#*$%&|<>', '')) AS BIGINT)").alias("n_symbols"),
            F.col("_l.dup").alias("n_dup_lines"),
            F.col("_c.n_repeat_words").alias("n_repeat_words"),
            F.col("_l.n").alias("_n_lines"),
        )
        .withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
        .withColumn("_m_symbols", _thousandths("n_symbols", "n_words"))
        .withColumn("_m_dup_lines", _thousandths("n_dup_lines", "_n_lines"))
        .withColumn("_m_repeats", _thousandths("n_repeat_words", "n_words"))
        .withColumn("_m_word_len", _thousandths("word_chars", "n_words"))
    )


def _thousandths(part: str, whole: str) -> Column:
    return F.expr(f"CASE WHEN {whole} > 0 THEN (1000 * {part}) DIV {whole} ELSE 0L END")


def thresholds(measured: DataFrame, k: int = SKETCH_K, min_rows: int = MIN_ROWS) -> DataFrame:
    """One row per (_lang, _source): the fences of the most specific level with ``min_rows`` documents."""
    names = list(MARGINS)
    leaf = measured.groupBy("_lang", "_source").agg(
        F.count(F.lit(1)).alias("_n"), *[F.kll_sketch_agg_bigint(f"_m_{m}", F.lit(k)).alias(m) for m in names])
    leaf = written(leaf, "quality-sketches")

    def merged(by: list[str], tag: str) -> DataFrame:
        return leaf.groupBy(*by).agg(
            F.sum("_n").alias(f"_n_{tag}"), *[F.kll_merge_agg_bigint(m, F.lit(k)).alias(f"{m}_{tag}") for m in names])

    lang, everything = merged(["_lang"], "lang"), merged([], "all")
    wide = (
        leaf.join(lang.withColumnRenamed("_lang", "_lang_of"), F.col("_lang").eqNullSafe(F.col("_lang_of")))
        .join(F.broadcast(everything))  # one row of four sketches of bounded size
    )
    out = ["_lang", "_source"]
    for m, margin in MARGINS.items():
        sketch = (F.when(F.col("_n") >= min_rows, F.col(m)).when(F.col("_n_lang") >= min_rows, F.col(f"{m}_lang"))
                  .otherwise(F.col(f"{m}_all")))
        q1, q3 = (F.kll_sketch_get_quantile_bigint(sketch, F.lit(p)) for p in (0.25, 0.75))
        out.append((q3 + 3 * (q3 - q1) + margin).alias(f"_max_{m}"))
        if m == "word_len":
            out.append((q1 - 3 * (q3 - q1) - margin).alias(f"_min_{m}"))
    return wide.select(*out)


def judged(docs: DataFrame, keep_row: bool = False, k: int = SKETCH_K, min_rows: int = MIN_ROWS) -> DataFrame:
    """Every document with its counts and verdict; ``keep_row`` carries the input row as ``_row``."""
    measured = with_measures(docs)
    measured = measured.withColumn("doc_id", F.col("_row.doc_id"))
    measured = written(measured if keep_row else measured.drop("_row"), "quality-measures")
    limits = written(thresholds(measured, k, min_rows), "quality-thresholds")
    limits = limits.withColumnRenamed("_lang", "_l").withColumnRenamed("_source", "_s")
    inside = F.col("_m_word_len") >= F.col("_min_word_len")
    for m in MARGINS:
        inside = inside & (F.col(f"_m_{m}") <= F.col(f"_max_{m}"))
    # The thresholds are read from a written table: the optimizer knows their size and
    # broadcasts them only below its limit.
    return measured.join(
        limits, F.col("_lang").eqNullSafe(F.col("_l")) & F.col("_source").eqNullSafe(F.col("_s")), "left"
    ).withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True)))


def apply_rules(docs: DataFrame, k: int = SKETCH_K, min_rows: int = MIN_ROWS) -> DataFrame:
    """The documents that pass, with their columns as they came."""
    return judged(docs, True, k, min_rows).filter("kept").select("_row.*")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      "kept")


_FENCES = ", ".join(
    f"quantile_disc({m}, 0.25) AS q1_{m}, quantile_disc({m}, 0.75) AS q3_{m}" for m in MARGINS)
_PICK = ", ".join(
    f"CASE WHEN g.n >= {MIN_ROWS} THEN g.{q}_{m} WHEN l.n >= {MIN_ROWS} THEN l.{q}_{m} ELSE a.{q}_{m} END AS {q}_{m}"
    for m in MARGINS for q in ("q1", "q3"))
_INSIDE = " AND ".join(
    [f"{m} <= q3_{m} + 3 * (q3_{m} - q1_{m}) + {margin}" for m, margin in MARGINS.items()]
    + [f"word_len >= q1_word_len - 3 * (q3_word_len - q1_word_len) - {MARGINS['word_len']}"])

#: DuckDB: the verdicts as CTEs ending in table ``verdict`` over a table expression ``{src}``.
#: The quantiles are exact, as are sketches of up to SKETCH_K values.
VERDICT_CTES = r"""
qr_base AS (SELECT doc_id, lang, source, coalesce(text, '') AS t,
                regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM {src}),
qr_windows AS (SELECT doc_id, i, w[i:i+4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM qr_base
                WHERE len(w) >= 5)),
qr_twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM qr_windows) WHERE c > 1),
qr_repeat AS (SELECT doc_id, sum(least(5, i - coalesce(last, i - 5))) AS n FROM
               (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS last FROM qr_twice) GROUP BY doc_id),
qr_lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM qr_base),
qr_counts AS (SELECT b.doc_id, lang, source, len(w)::BIGINT AS n_words,
        length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
        len(l)::BIGINT AS n_lines
    FROM qr_base b JOIN qr_lines USING (doc_id) LEFT JOIN qr_repeat r ON r.doc_id = b.doc_id),
qr_m AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
        CASE WHEN n_words > 0 THEN 1000 * n_symbols // n_words ELSE 0 END AS symbols,
        CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END AS dup_lines,
        CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END AS repeats,
        CASE WHEN n_words > 0 THEN 1000 * word_chars // n_words ELSE 0 END AS word_len FROM qr_counts),
qr_g AS (SELECT lang, source, count(*) AS n, FENCES FROM qr_m GROUP BY lang, source),
qr_l AS (SELECT lang, count(*) AS n, FENCES FROM qr_m GROUP BY lang),
qr_a AS (SELECT FENCES FROM qr_m),
qr_t AS (SELECT g.lang, g.source, PICK FROM qr_g g JOIN qr_l l ON g.lang IS NOT DISTINCT FROM l.lang, qr_a a),
verdict AS (SELECT m.*, NOT base_failed AND INSIDE AS kept
    FROM qr_m m JOIN qr_t t ON m.lang IS NOT DISTINCT FROM t.lang AND m.source IS NOT DISTINCT FROM t.source)
""".replace("FENCES", _FENCES).replace("PICK", _PICK).replace("INSIDE", _INSIDE)

OP7_SQL = "WITH " + VERDICT_CTES.replace("{src}", "documents") + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM verdict"""
