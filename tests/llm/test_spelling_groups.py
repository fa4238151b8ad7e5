"""Spelling variants: signatures against all pairs by edit distance, the query against SQL, odd tables."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import spelling_groups as sg

from .common_fixtures import SF, SCHEMA, empty_documents, odd_documents

LOW = str.maketrans(sg.UPPER, sg.LOWER)


def _near(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _brute(n: dict[str, int], growth=5) -> dict[str, tuple]:
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and v != w and _near(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= growth * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def _counted(rows) -> Counter:
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            found[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    return found


def _got(df) -> dict[str, tuple]:
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("options", [{}, {"crowd": 1}, {"crowd": 0, "parts": 3}, {"parts": 6}])
@pytest.mark.parametrize("letters", ["ab", "abcdeé", "eéèêëç"])
def test_variants_equal_all_pairs(spark, letters, options):
    rng = random.Random(len(letters))
    words = {"".join(rng.choice(letters) for _ in range(rng.choice((6, 6, 7, 7, 8, 13)))) for _ in range(150)}
    for w in list(words)[:60]:
        i = rng.randrange(len(w))
        words |= {w[:i] + w[i + 1 :], w[:i] + rng.choice(letters + "zÿ") + w[i + 1 :], w[:i] + "z" + w[i:], w + "a", "a" + w}
    n = {w: rng.choice((5, 6, 25, 30, 130, 700, 4000)) for w in words if len(w) >= 6}
    df = spark.createDataFrame(list(n.items()), "word string, n long").repartition(3)
    assert _got(sg.group_variants(df, **options)) == _brute(n)


def test_chain_of_forms_has_one_root(spark):
    n = {"abcdef": 5**8, "abcdeg": 5**7, "abcdgg": 5**6, "abcggg": 5**5, "abgggg": 5**4, "aggggg": 5**3, "gggggg": 25, "gggggh": 5}
    got = _got(sg.group_variants(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert {v[1] for v in got.values()} == {"abcdef"} and got == _brute(n)


def test_words_of_odd_documents(spark):
    docs = odd_documents(spark, repeats=True)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {w: n for w, n in _counted(rows).items() if len(w) >= 6 and n >= 5}
    words = sg.count_words(docs)
    assert {r.word: r.n for r in words.collect()} == want and want
    assert _got(sg.group_variants(words)) == _brute(want)


def test_only_ascii_is_lowered_and_noise_deletes(spark):
    words = [f"Wörter{c}" for c in "abcdefgh"] + ["ÀÉÎÕÜß", "àéîõüß", "MAẞSTAB", "a×÷bcd", "straße"]
    rows = [(k, " ".join(words) + "\n" + ",".join(words), "de", "s", 1) for k in range(300)]
    got = {r.word: r.n for r in sg.count_words(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert got == {w: n for w, n in _counted([r[:2] for r in rows]).items() if len(w) >= 6 and n >= 5}
    assert got["ÀÉÎÕÜß"] != 0 and "àéîõüß" in got


def test_empty_tables_and_columns(spark):
    for docs in (empty_documents(spark), spark.createDataFrame([(1, None), (None, ""), (2, "!!")], "doc_id long, text string")):
        assert sg.group_variants(sg.count_words(docs)).collect() == []
    found = sg.group_variants(sg.count_words(odd_documents(spark).withColumn("word", F.lit("mine"))))
    assert found.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]


def test_op13_equals_sql_and_brute_force(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = {r[0]: r[1:] for r in con.execute(sg.OP13_SQL).fetchall()}
    assert _got(sg.op13_spelling_groups(spark, SF)) == want
    rows = con.execute("SELECT doc_id, text FROM documents").fetchall()
    assert want == _brute({w: n for w, n in _counted(rows).items() if len(w) >= 6 and n >= 5})
