"""Operator 1, mixing sources to target weights by hierarchical budgets.

Leaves are (domain, language, source). The token budget goes down the tree by weight. A node
whose subtree holds less than its share gives the shortage to its siblings by weight, and what
the siblings cannot take stays with the parent, whose own siblings take it: every level is filled with
each child's capacity known (the tokens of its subtree times ``max_epochs``). A leaf's quota
of q tokens over T is q // T whole epochs and a prefix of the next: its documents in the order
of md5(seed, epoch, doc_id), up to the document that reaches the rest.

Integer arithmetic throughout, so the result does not depend on the order of sums.

Scale: documents are read for their sizes; a leaf's epochs and the order key at which its quota ends then are one row a
leaf, which documents are joined to. The order of a leaf is never one task's work: the end of the quota is narrowed by
buckets of the order key, whose totals are summed map-side first.

Cases: null or empty text has no tokens and comes with every epoch of its leaf; null language,
source or domain is a node of its own; rows of equal
id stand side by side, shorter first; an empty table gives
an empty result; a leaf without weight gets nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE_CLASS, documents, text_or_empty, written

SEED = 17
MAX_EPOCHS = 4
#: Hex digits of the order key by which the end of a quota is narrowed at a time.
DIGITS = 3
LEAF = ["domain", "lang", "source"]
#: Token budget in thousandths of all tokens, used by the query; the pipeline stage takes ``whole_budget``.
BUDGET_SHARE = 800
#: Target weights; a node that is not named weighs 1.
DOMAIN_WEIGHTS = {"web": 5, "books": 3, "forum": 2}
LANGUAGE_WEIGHTS = {"en": 4, "de": 2, "fr": 2, "es": 2}
#: Domains of the sources: by the last digit of the source's name.
DOMAIN_OF_DIGIT = {"web": "0123", "books": "456"}


def domain_of(source: Column) -> Column:
    """The domain of a source: a rule of the test corpus, whose sources are only numbered."""
    digit = F.substring(source, -1, 1)
    out = F.when(digit.isin(*DOMAIN_OF_DIGIT["web"]), "web").when(digit.isin(*DOMAIN_OF_DIGIT["books"]), "books")
    return out.otherwise("forum")


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, SPACE_CLASS), lambda w: w != "")).cast("long")


def _weight(node: Column, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for name, w in weights.items():
        out = F.when(node == name, w).otherwise(out)
    return out.cast("long")


def _fill(children: DataFrame, parent: list[str], node: str) -> DataFrame:
    """``quota`` of every child from its parent's ``budget``: shares by weight, never above ``cap``.

    In order of cap / weight the children that fill up come first; a child is full exactly when
    the budget left for it and those after it, shared by weight, reaches its cap.
    """
    order = [(F.col("cap") / F.col("w")).asc(), F.col(node).asc_nulls_first()]
    before = Window.partitionBy(*parent).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.partitionBy(*parent).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    rows = (
        children.filter("w > 0")
        .withColumn("_left", F.greatest(F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)), F.lit(0)))
        .withColumn("_w", F.sum("w").over(onward))
        .withColumn("_full", F.expr("CAST(_left AS DECIMAL(38,0)) * w >= CAST(cap AS DECIMAL(38,0)) * _w"))
    )
    # The first child that is not full fixes the rate for all after it.
    rest = Window.partitionBy(*parent).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_rate", F.first(F.when(~F.col("_full"), F.struct("_left", "_w")), True).over(rest))
    share = F.expr("CAST((CAST(_rate._left AS DECIMAL(38,0)) * w) DIV _rate._w AS BIGINT)")
    return rows.withColumn("quota", F.when(F.col("_rate").isNull(), F.col("cap")).otherwise(share)).drop("_left", "_w", "_full", "_rate")


def leaf_quotas(leaves: DataFrame, budget: int, max_epochs: int = MAX_EPOCHS, domain_weights: dict[str, int] | None = None,
                language_weights: dict[str, int] | None = None, source_weights: dict[str, int] | None = None) -> DataFrame:
    """``quota`` of every leaf (domain, lang, source, tokens)."""
    leaves = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    top = leaves.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumn(
        "w", _weight(F.col("domain"), domain_weights or {})).withColumn("budget", F.lit(budget).cast("long"))
    top = _fill(top.withColumn("_root", F.lit(0)), ["_root"], "domain").select(F.col("domain").alias("_d"), F.col("quota").alias("budget"))
    middle = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).withColumn("w", _weight(F.col("lang"), language_weights or {}))
    middle = middle.join(top, F.col("domain").eqNullSafe(F.col("_d"))).drop("_d")
    middle = _fill(middle, ["domain"], "lang").select(F.col("domain").alias("_d"), F.col("lang").alias("_l"), F.col("quota").alias("budget"))
    low = leaves.withColumn("w", _weight(F.col("source"), source_weights or {})).join(
        middle, F.col("domain").eqNullSafe(F.col("_d")) & F.col("lang").eqNullSafe(F.col("_l"))).drop("_d", "_l")
    return _fill(low, ["domain", "lang"], "source").select("domain", "lang", "source", "tokens", "quota")


def whole_budget(leaves: DataFrame, max_epochs: int = MAX_EPOCHS, domain_weights: dict[str, int] | None = None,
                 language_weights: dict[str, int] | None = None, source_weights: dict[str, int] | None = None) -> int:
    """A budget at which the quota of every leaf (domain, lang, source, tokens) with a weight is its tokens or more, so no
    document is left out: at every node the least whole tokens a unit of weight that give each child what it needs."""
    rows = leaves.withColumn("need", F.col("tokens")).withColumn("cap", F.col("tokens") * max_epochs)
    levels = (("source", ["domain", "lang"], source_weights), ("lang", ["domain"], language_weights), ("domain", [], domain_weights))
    for node, parent, weights in levels:
        rows = rows.withColumn("w", _weight(F.col(node), weights or {})).filter("w > 0")
        rate = rows.groupBy(*parent).agg(F.max(F.expr("(need + w - 1) DIV w")).alias("rate"), F.collect_list(F.struct("cap", "w")).alias("of"),
                                         F.sum("cap").alias("cap"))
        rows = rate.select(*parent, "cap", F.expr("aggregate(of, 0L, (a, x) -> a + least(x.cap, rate * x.w))").alias("need"))
    return rows.first()["need"] or 0


def order_key(seed: int, epochs: Column) -> Column:
    """Where a document stands in the epoch after ``epochs`` whole ones: md5 of seed, epoch and id."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epochs.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def _to_leaf(rows: DataFrame, leaves: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined to a table of one row a leaf, whose other columns they take."""
    own = leaves.withColumnsRenamed({n: f"_{n}" for n in LEAF})
    same = [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in LEAF]
    return rows.join(own, same[0] & same[1] & same[2], how).drop(*[f"_{n}" for n in LEAF])


def _ending(rows: DataFrame, digits: int, name: str) -> DataFrame:
    """Of every leaf the bucket (leading ``digits`` of the key) of ``rows`` in which its rest is reached, and the tokens before it.
    At most 16^3 rows a leaf go through the window: ``rows`` share all but the last three digits."""
    totals = rows.groupBy(*LEAF, F.substring("_key", 1, digits).alias("_last")).agg(
        F.sum("n_tokens").alias("_n"), F.min("rest").alias("rest"), F.min("_start").alias("_from"))
    before = Window.partitionBy(*LEAF).orderBy("_last").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_start", F.col("_from") + F.coalesce(F.sum("_n").over(before), F.lit(0)))
    found = totals.filter((F.col("_start") < F.col("rest")) & (F.col("_start") + F.col("_n") >= F.col("rest")))
    return written(found.select(*LEAF, "_last", "_start"), name)


def leaf_copies(sizes: DataFrame, budget: int | None = None, seed: int = SEED, max_epochs: int = MAX_EPOCHS,
                whole: bool = False, **weights) -> DataFrame:
    """One row a leaf: quota, whole epochs, and the cut (order key and tokens of the document with which the quota ends;
    null where it ends with an epoch). ``whole`` takes ``whole_budget`` for the budget.

    A document comes once more than the whole epochs if it is not after the cut, so this table is all that the
    documents themselves need to be joined to. The cut is found by narrowing the order key three hex digits at a time: 4096
    bucket totals a leaf, then 4096 of the bucket in which the quota ends, then the documents of 1 in 16 million.
    """
    leaves = written(sizes.groupBy(*LEAF).agg(F.sum("n_tokens").cast("long").alias("tokens")), "mix-leaves")
    if whole:
        budget = whole_budget(leaves, max_epochs, **weights)
    elif budget is None:
        budget = (leaves.agg(F.sum("tokens")).first()[0] or 0) * BUDGET_SHARE // 1000
    quotas = leaf_quotas(leaves, budget, max_epochs, **weights)
    part = F.when(F.col("tokens") > 0, F.expr("quota DIV tokens")).otherwise(F.lit(max_epochs)).cast("long")
    quotas = quotas.withColumn("epochs", part).withColumn("rest", F.col("quota") - F.col("epochs") * F.col("tokens"))
    quotas = written(quotas.select(*LEAF, "quota", "epochs", "rest"), "mix-quotas")
    rows = _to_leaf(sizes, quotas.filter("rest > 0")).withColumn("_key", order_key(seed, F.col("epochs"))).withColumn("_start", F.lit(0).cast("long"))
    rows = rows.select(*LEAF, "_key", "n_tokens", "rest", "_start")
    for level in (1, 2):
        digits = DIGITS * level
        found = _ending(rows, digits, f"mix-ending-{level}")
        rows = _to_leaf(rows.drop("_start"), found).filter(F.substring("_key", 1, digits) == F.col("_last")).drop("_last")
    before = Window.partitionBy(*LEAF).orderBy("_key", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.col("_start") + F.coalesce(F.sum("n_tokens").over(before), F.lit(0)) < F.col("rest")
    cuts = rows.withColumn("_in", taken).filter("_in").groupBy(*LEAF).agg(F.max(F.struct("_key", "n_tokens")).alias("cut"))
    return written(_to_leaf(quotas, cuts, "left").select(*LEAF, "quota", "epochs", "cut"), "mix-copies")


def _with_copies(rows: DataFrame, leaves: DataFrame, seed: int) -> DataFrame:
    """``rows`` (doc_id, leaf, n_tokens, any more) with quota and copies of a leaf table."""
    rows = _to_leaf(rows, leaves)
    more = F.struct(order_key(seed, F.col("epochs")).alias("_key"), F.col("n_tokens")) <= F.col("cut")
    return rows.withColumn("copies", F.col("epochs") + F.coalesce(more, F.lit(False)).cast("long")).drop("epochs", "cut")


def mixed(sizes: DataFrame, budget: int | None = None, seed: int = SEED, max_epochs: int = MAX_EPOCHS,
          whole: bool = False, **weights) -> DataFrame:
    """Every row of ``sizes`` (doc_id, domain, lang, source, n_tokens) with its leaf's quota and its copies."""
    leaves = leaf_copies(sizes, budget, seed, max_epochs, whole, **weights)
    return _with_copies(sizes, leaves, seed).select("doc_id", *LEAF, "n_tokens", "quota", "copies")


def _leaf_columns() -> list[Column]:
    return [domain_of(F.col("source").cast("string")).alias("domain"), F.col("lang").cast("string").alias("lang"),
            F.col("source").cast("string").alias("source"), n_words(text_or_empty()).alias("n_tokens")]


def sizes_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", *_leaf_columns())


def mix_documents(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """The documents as they are to be read: each as often as its leaf's epochs take it, columns as they came. Texts are read
    for their sizes and again for the result, and only a table of one row a leaf is joined to them."""
    leaves = leaf_copies(written(sizes_of(docs), "mix-sizes"), seed=seed, **options)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), "doc_id", *_leaf_columns())
    found = _with_copies(rows, leaves, seed).filter("copies > 0")
    return found.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).select("_row.*")


def query_weights() -> dict:
    return {"domain_weights": DOMAIN_WEIGHTS, "language_weights": LANGUAGE_WEIGHTS}


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(written(sizes_of(documents(spark, sf_dir)), "mix-sizes"), **query_weights())


def _fill_sql(name: str, source: str, parent: str, node: str) -> str:
    """CTEs that end in ``name``: the rows of ``source`` (with cap, w, budget) and their quota."""
    by = f"PARTITION BY {parent} ORDER BY cap / w, {node} NULLS FIRST"
    return f"""
{name}_a AS (SELECT *, greatest(budget - coalesce(sum(cap) OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS l,
    sum(w) OVER ({by} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM {source} WHERE w > 0),
{name}_b AS (SELECT *, l::HUGEINT * w >= cap::HUGEINT * ws AS is_full FROM {name}_a),
{name}_c AS (SELECT *, first_value(CASE WHEN NOT is_full THEN l END IGNORE NULLS) OVER ({by} ROWS UNBOUNDED PRECEDING) AS rl,
    first_value(CASE WHEN NOT is_full THEN ws END IGNORE NULLS) OVER ({by} ROWS UNBOUNDED PRECEDING) AS rw FROM {name}_b),
{name} AS (SELECT *, (CASE WHEN rl IS NULL THEN cap ELSE (rl::HUGEINT * w) // rw END)::BIGINT AS quota FROM {name}_c)"""


def _case_sql(column: str, weights: dict[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END"


def _domain_sql() -> str:
    web, books = (", ".join(f"'{d}'" for d in DOMAIN_OF_DIGIT[k]) for k in ("web", "books"))
    return f"CASE WHEN right(source, 1) IN ({web}) THEN 'web' WHEN right(source, 1) IN ({books}) THEN 'books' ELSE 'forum' END"


#: DuckDB: CTEs ending in table ``mix`` over a table expression {src}.
MIX_CTES = f"""
mx_sizes AS (SELECT doc_id, {_domain_sql()} AS domain, lang, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM {{src}}),
mx_leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, {MAX_EPOCHS} * sum(n_tokens)::BIGINT AS cap
    FROM mx_sizes GROUP BY ALL),
mx_top AS (SELECT 0 AS root, domain, sum(cap)::BIGINT AS cap, {_case_sql("domain", DOMAIN_WEIGHTS)} AS w,
    (SELECT sum(tokens)::BIGINT * {BUDGET_SHARE} // 1000 FROM mx_leaves) AS budget FROM mx_leaves GROUP BY domain),
{_fill_sql("mx_d", "mx_top", "root", "domain")},
mx_mid AS (SELECT l.domain, lang, sum(l.cap)::BIGINT AS cap, {_case_sql("lang", LANGUAGE_WEIGHTS)} AS w, any_value(d.quota) AS budget
    FROM mx_leaves l JOIN mx_d d ON l.domain IS NOT DISTINCT FROM d.domain GROUP BY l.domain, lang),
{_fill_sql("mx_l", "mx_mid", "domain", "lang")},
mx_low AS (SELECT l.*, 1 AS w, m.quota AS budget FROM mx_leaves l JOIN mx_l m
    ON l.domain IS NOT DISTINCT FROM m.domain AND l.lang IS NOT DISTINCT FROM m.lang),
{_fill_sql("mx_s", "mx_low", "domain, lang", "source")},
mx_q AS (SELECT domain, lang, source, quota, CASE WHEN tokens > 0 THEN quota // tokens ELSE {MAX_EPOCHS} END AS epochs, tokens FROM mx_s),
mx_rows AS (SELECT z.*, q.quota, q.epochs, q.quota - q.epochs * q.tokens AS rest,
    md5('{SEED}:' || q.epochs || ':' || coalesce(z.doc_id::VARCHAR, '')) AS k FROM mx_sizes z JOIN mx_q q
    ON z.domain = q.domain AND z.lang IS NOT DISTINCT FROM q.lang AND z.source IS NOT DISTINCT FROM q.source),
mix AS (SELECT doc_id, domain, lang, source, n_tokens, quota, (epochs + CASE WHEN
    coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    < rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM mx_rows)"""

OP1_SQL = "WITH " + MIX_CTES.replace("{src}", "documents") + " SELECT * FROM mix"
