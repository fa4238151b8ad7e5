"""Operators over all documents: suffix dedup, exact dedup, near dedup, quality rules, mixing; against brute force or SQL."""

import hashlib
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import exact_dedup, mixing, near_dedup, quality_rules, queries, suffix_dedup

from .common_fixtures import SF, empty_documents, odd_documents, odd_rows, texts


# ---- 3: repeated 100-byte strings ------------------------------------------------------

def _strip(raw: dict[int, bytes]) -> dict[int, tuple]:
    seen, out = set(), {}
    for i in sorted(raw):
        text, runs = raw[i], []
        for s in range(len(text) - 99):
            if text[s : s + 100] in seen:
                if runs and s <= runs[-1][1]:
                    runs[-1][1] = s + 100
                else:
                    runs.append([s, s + 100])
            else:
                seen.add(text[s : s + 100])
        kept, at = b"", 0
        for a, b in runs:
            kept, at = kept + text[at:a], b
        kept += text[at:]
        out[i] = (len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("n,letters", [(300, 2), (2000, 3), (4000, 20)])
def test_intervals_give_the_common_prefixes(n, letters):
    rng = np.random.default_rng(n)
    text = rng.integers(97, 97 + letters, n).astype(np.uint8)
    text[n // 2 : n // 2 + n // 4] = text[: n // 4]
    order = suffix_dedup.suffix_order(text, 100)
    found, raw = suffix_dedup.prefix_boundaries(text, order, 100), text.tobytes()
    for k in range(1, n):
        x, y = raw[order[k - 1] :], raw[order[k] :]
        assert x[:100] <= y[:100]
        common = next((c for c in range(min(len(x), len(y), 100)) if x[c] != y[c]), min(len(x), len(y), 100))
        assert found[k] == (common if common < 100 else -1)


@pytest.mark.parametrize("options", [{}, {"bucket": 1}, {"hot_sample": 1, "hot_rows": 1}, {"hot_sample": 1, "hot_rows": 3}])
def test_repeats_are_stripped_on_every_way(spark, options):
    rng = np.random.default_rng(4)
    line = bytes(rng.integers(97, 110, 150).astype(np.uint8)).decode()
    rows = odd_rows() + [(100 + k, f"{k} start " + line + f" end {k} " * (k % 4), "en", "s", 1) for k in range(30)]
    rows += [(200, (line + " ") * 9, "en", "s", 1), (201, "ab" * 400, "en", "s", 1), (202, "x" + "ab" * 90, "en", "s", 1), (203, line[:99], "en", "s", 1),
             (204, line[20:130] + "é" * 80, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).withColumn("uid", F.lit("mine"))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.strip_repeats(docs, **options).collect()}
    assert got == _strip({r[0]: (r[1] or "").encode() for r in rows})


def test_repeated_and_missing_ids_are_documents_of_their_own(spark):
    got = suffix_dedup.strip_repeats(odd_documents(spark, repeats=True), with_text=True).collect()
    assert len(got) == len(odd_rows()) + 4
    twice = sorted(r.n_removed for r in got if r.doc_id == 1)
    assert twice[0] == 0 and twice[1] == len(odd_rows()[0][1].encode())  # the second row repeats the first
    assert sorted(r.n_removed for r in got if r.doc_id is None)[1] == len(odd_rows()[0][1].encode())
    assert suffix_dedup.strip_repeats(empty_documents(spark)).collect() == []


# ---- 6: exact dedup ---------------------------------------------------------------------

def test_filters_merge_losslessly():
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 3000):
        x = rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2)
        x = np.r_[x, x[: n // 3], x[: n // 5]]
        one = exact_dedup.QuotientFilter.from_bytes(exact_dedup.QuotientFilter.of(x).to_bytes())
        both = one.merged(exact_dedup.QuotientFilter.of(x[: n // 2]))
        for f, values in ((one, x), (both, np.r_[x, x[: n // 2]])):
            prints, counts = f.entries()
            want, n_want = np.unique(values, return_counts=True)
            assert (prints == want).all() and (counts == n_want).all()
            assert all(f.count(int(p)) == c for p, c in list(zip(prints, counts, strict=True))[:20])
        assert both.count(12345) == 0


def test_normalising_equals_the_pattern():
    for raw in (b"", b" ", b"\n\t ", b" a", b"a ", b" a  b\n", b"a\x0bb\x1cc\x85", b"ab"):
        assert exact_dedup.normalised(raw) == re.sub(rb"[\x20\x09-\x0d]+", b" ", raw)


def test_groups_of_equal_texts(spark):
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.groups(odd_documents(spark), shard_rows=5).collect()}
    groups = defaultdict(list)
    for i, t in texts().items():
        groups[re.sub(r"[\x20\x09-\x0d]+", " ", t)].append(i)
    assert got == {i: (min(g), len(g)) for g in groups.values() for i in g}
    kept = exact_dedup.drop_copies(odd_documents(spark))
    assert kept.columns == odd_documents(spark).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(min(g) for g in groups.values())


def test_rows_that_repeat_an_id_are_kept_once(spark):
    docs = odd_documents(spark, repeats=True)
    kept = [r.doc_id for r in exact_dedup.drop_copies(docs).collect()]
    assert kept.count(1) == 1 and kept.count(4) == 1 and kept.count(None) == 1
    assert exact_dedup.drop_copies(empty_documents(spark)).collect() == []


# ---- 10: near dedup ---------------------------------------------------------------------

def _components(raw: dict[int, str]) -> dict[int, tuple[int, int]]:
    sets, lower = {}, str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t in raw.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(lower))
        sets[i] = {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()
    parent = {i: i for i in raw}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(raw):
        for j in sorted(raw):
            if j < i and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both) and top(i) != top(j):
                    a, b = sorted((top(i), top(j)))
                    parent[b] = a
    return {i: (len(sets[i]), top(i)) for i in raw}


def test_components_of_near_copies(spark):
    import random

    rng = random.Random(9)
    rows = odd_rows()
    base = [f"w{k}" for k in range(150)]
    for k in range(60):  # a group of near copies, some of them near only to some others
        words = list(base)
        for _ in range(rng.randint(1, 9)):
            words[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((500 + k, " ".join(words), "en", "s", 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).withColumn("cid", F.lit("mine"))
    want = _components({r[0]: r[1] or "" for r in rows})
    for rounds in (0, 2):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_groups(docs, rounds).collect()}
        assert got == want
    kept = near_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if i == c)


def test_near_dedup_of_odd_rows(spark):
    got = near_dedup.near_groups(odd_documents(spark, repeats=True)).collect()
    assert len(got) == len(odd_rows()) + 4
    assert [r.component_id for r in got if r.doc_id == 1] == [1, 1]
    assert sorted(str(r.component_id) for r in got if r.doc_id is None) == ["1", "None"]
    assert near_dedup.near_groups(empty_documents(spark)).collect() == []


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    got = {r.v: r.label for r in near_dedup.components(edges).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


# ---- 7 and 1: against SQL, and odd rows ---------------------------------------------------

@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    res = con.execute(queries.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    got = queries.registry()[name](spark, SF)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(map(repr, map(tuple, got.select(*cols).collect()))) == sorted(map(repr, res.fetchall()))


def test_quality_rules_on_odd_rows(spark):
    docs = odd_documents(spark, repeats=True)
    got = quality_rules.judged(docs).collect()
    assert len(got) == len(odd_rows()) + 4
    by = {r.doc_id: r for r in got}
    assert (by[4].n_words, by[4].word_chars, by[4].base_failed, by[4].kept) == (0, 0, True, False)
    assert by[9].n_repeat_words == 400 and by[9].base_failed
    assert by[7].n_dup_lines == 1 and by[7].n_repeat_words == 60
    kept = quality_rules.apply_rules(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.kept)
    assert quality_rules.apply_rules(empty_documents(spark)).collect() == []


def test_quotas_give_shortages_to_siblings_first(spark):
    leaves = spark.createDataFrame(
        [("a", "x", "s1", 10), ("a", "x", "s2", 1000), ("a", "y", "s3", 20), ("b", "x", "s4", 5000), ("b", None, "s5", 100)],
        "domain string, lang string, source string, tokens long")
    got = {r.source: r.quota for r in mixing.leaf_quotas(leaves, 1000, 1).collect()}
    # a and b get 500 each; y can take 20 of its 250, so x gets 480; s1 can take 10, so s2 gets 470.
    assert got == {"s3": 20, "s1": 10, "s2": 470, "s5": 100, "s4": 400}
    # What a cannot take at all goes to b.
    got = {r.source: r.quota for r in mixing.leaf_quotas(leaves, 4000, 1).collect()}
    assert got == {"s3": 20, "s1": 10, "s2": 1000, "s5": 100, "s4": 2870}


def test_mixing_takes_prefixes_of_seeded_epochs(spark):
    docs = odd_documents(spark)
    sizes = mixing.sizes_of(docs)
    rows = mixing.mixed(sizes, budget=60_000, **mixing.query_weights()).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts())
    leaves = defaultdict(list)
    for r in rows:
        leaves[(r.domain, r.lang, r.source)].append(r)
    for leaf in leaves.values():
        tokens, quota = sum(r.n_tokens for r in leaf), leaf[0].quota
        epochs, rest = divmod(quota, tokens) if tokens else (mixing.MAX_EPOCHS, 0)
        before = 0
        for r in sorted(leaf, key=lambda r: hashlib.md5(f"{mixing.SEED}:{epochs}:{r.doc_id}".encode()).hexdigest()):
            assert r.copies == epochs + (before < rest)
            before += r.n_tokens
    out = mixing.mix_documents(docs, budget=60_000, **mixing.query_weights())
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in rows)
    assert mixing.mix_documents(empty_documents(spark)).collect() == []
