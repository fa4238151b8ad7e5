"""Whitening and exact top-k: against numpy, exact arithmetic and SQL, on odd vectors and whole small tables."""

import math
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import bit_sliced, vectors, whitening

from .common_fixtures import SF

SCHEMA = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")


def _odd_vectors(spark, dims=6, n=90, extra=True):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 0.4, (n, dims)) * np.linspace(0.2, 2, dims)
    x[10] = x[11] = x[12] = x[0]  # one vector under four ids: ties
    x[20] = 0
    rows = [(k, [float(v) for v in r], 1) for k, r in enumerate(x)]
    rows += [(900, None, 1), (901, [NAN] * dims, 1), (902, [1.0] * (dims - 1) + [INF], 1), (903, [1.0, None] + [0.0] * (dims - 2), 1),
             (904, [1.0], 1), (905, [], 1), (None, [0.5] * dims, 1), (0, rows[0][1], 1), (7, rows[9][1], 1), (50, rows[3][1], 2), (906, [-0.0] * dims, 1)]
    out = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for name in ("x", "e", "rank", "score", "n", "part", "lane", "query_id", "component") if extra else ():
        out = out.withColumn(name, F.lit("mine"))
    return out


def _plain(spark_rows, dims):
    """(id, integers) of the whole vectors, by plain Python."""
    out = []
    for r in spark_rows:
        e = r.embedding
        if e is not None and len(e) == dims and all(v is not None and math.isfinite(v) for v in e):
            out.append((r.vec_id, [math.floor(256 * v) for v in e]))
    return out


# ---- 12: exact top-k ---------------------------------------------------------------------

@pytest.mark.parametrize("n,dims,slices", [(100, 5, 3), (700, 64, 7), (2000, 64, 4), (64, 1, 9), (1, 3, 7), (130, 7, 1)])
def test_slices_add_up_and_find_the_best(n, dims, slices):
    rng = np.random.default_rng(n)
    x = np.floor(rng.normal(0, 32, (n, dims))).astype(np.int64)
    x[n // 2 :] = x[: n - n // 2]  # ties
    low, drop, bits = bit_sliced.make_block(x, slices)
    q = np.concatenate([x[rng.integers(0, n, 12)], np.zeros((1, dims), np.int64)])
    both = np.concatenate([bits, ~bits])
    sums = bit_sliced.add_slices(both, np.concatenate([np.maximum(q, 0), np.maximum(-q, 0)], axis=1))
    u, full = (x - low) >> drop, (1 << bits.shape[1]) - 1
    value = sum(np.unpackbits(s.view(np.uint8).reshape(len(q), -1), axis=1, bitorder="little")[:, :n].astype(np.int64) << p for p, s in enumerate(sums))
    assert (value == np.maximum(q, 0) @ u.T + np.maximum(-q, 0) @ (full - u).T).all()
    ids, known = rng.permutation(n).astype(np.int64), rng.random(n) < 0.95
    own = np.arange(len(q))
    for i, rows, scores in bit_sliced.search_block(x, drop, bits, ids, known, q, own, 5):
        s = x @ q[i]
        want = sorted((j for j in range(n) if not (known[j] and ids[j] == own[i])), key=lambda j: (-s[j], not known[j], ids[j]))[:5]
        assert [(s[j], known[j], ids[j] if known[j] else 0) for j in want] == [(s[j], known[j], ids[j] if known[j] else 0) for j in rows.tolist()]
        assert scores.tolist() == [s[j] for j in rows]


@pytest.mark.parametrize("options", [{}, {"block": 8, "group": 1}, {"block": 64, "slices": 2}, {"slices": 40}])
def test_top_k_equals_brute_force(spark, options):
    table = _odd_vectors(spark)
    plain = _plain(table.collect(), 6)
    rows = vectors.integer_vectors(table)
    asked = rows.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in bit_sliced.top_k(rows, asked, **options).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    queries = {}
    for i, x in plain:
        if i is not None and i % 10 == 0:
            queries[i] = min(x, queries.get(i, x))
    assert set(got) == set(queries)
    for i, q in queries.items():
        scored = sorted(((-sum(a * b for a, b in zip(q, x)), j is None, j or 0) for j, x in plain if j != i))[:5]
        assert [got[i][k + 1] for k in range(5)] == [(None if none else j, -s) for s, none, j in scored]


def test_fewer_rows_than_k_and_empty_tables(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (50, [0.5, -1.0], 1)], SCHEMA)
    rows = vectors.integer_vectors(few)
    got = bit_sliced.top_k(rows, rows.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(0, 1, 1), (0, 2, 50), (50, 1, 0), (50, 2, 1)]
    for table in (few.limit(0), few.select("vec_id", F.lit(None).cast("array<float>").alias("embedding"))):
        rows = vectors.integer_vectors(table)
        assert bit_sliced.top_k(rows, rows.withColumnRenamed("vec_id", "query_id")).collect() == []
        assert whitening.whiten(rows).collect() == []


def test_op12_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    got = bit_sliced.op12_bit_sliced(spark, SF)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(tuple(r) for r in got.collect()) == sorted(con.execute(bit_sliced.OP12_SQL).fetchall())


def test_entries_too_large_are_refused(spark):
    rows = vectors.integer_vectors(spark.createDataFrame([(0, [1e9], 1), (1, [1.0], 1)], SCHEMA))
    with pytest.raises(Exception, match="pass a long"):
        bit_sliced.top_k(rows, rows.withColumnRenamed("vec_id", "query_id")).collect()


# ---- 11: whitening -----------------------------------------------------------------------

def _symmetric(d, seed, size=1000, rank=None):
    x = np.random.default_rng(seed).integers(-size, size, (rank or d + 3, d))
    return (x.T @ x).astype(object)


def _exact_polynomial(a):
    """Coefficients by the Faddeev-LeVerrier recurrence in whole numbers."""
    d = len(a)
    m, out = np.zeros((d, d), object), [1]
    one = np.array([[int(i == j) for j in range(d)] for i in range(d)], object)
    for k in range(1, d + 1):
        m = a.dot(m) + out[-1] * one
        out.append(-int(a.dot(m).trace()) // k)
    return out[::-1]


@pytest.mark.parametrize("d,rank", [(1, None), (2, None), (3, 1), (7, None), (12, 5)])
def test_characteristic_polynomial_is_exact(spark, d, rank):
    a = _symmetric(d, d, rank=rank)
    assert whitening.characteristic_polynomial(spark, a) == _exact_polynomial(a)
    a[:] = 0
    assert whitening.characteristic_polynomial(spark, a) == [0] * d + [1]


def test_primes():
    found = whitening.primes_below(1 << 31, 200)
    assert found[:3] == [2147483647, 2147483629, 2147483587] and math.prod(found).bit_length() > 200


def test_roots_are_counted_and_isolated():
    poly = [1]
    roots = [Fraction(0), Fraction(3), Fraction(3), Fraction(1, 1), Fraction(10**9), Fraction(10**9 + 1), Fraction(10**9 + 1)]
    for r in roots:  # times (x - r)
        poly = [(poly[i - 1] if i else 0) - (int(r) * poly[i] if i < len(poly) else 0) for i in range(len(poly) + 1)]
    for at in (0, 1, 2, 3, 4, 10**9 - 1, 10**9, 10**9 + 1):
        assert whitening.roots_above(poly, at) == sum(r > at for r in roots)
    found = whitening.largest_roots(poly, 2 * 10**9, 9)
    assert [m for _, m in found] == [2, 1, 2, 1]
    for (r, _), want in zip(found, (10**9 + 1, 10**9, 3, 1)):
        assert abs(r / want - 1) < Fraction(1, 1 << 120)


def test_components_of_repeated_and_missing_roots(spark):
    a = np.array([[4, 0, 0, 0], [0, 9, 0, 0], [0, 0, 9, 0], [0, 0, 0, 0]], object)
    found = whitening.components(spark, a)
    assert [f[0] for f in found] == [3.0, 3.0, 2.0]
    v = np.array([f[2] for f in found])
    assert np.abs(v @ v.T - np.eye(3)).max() < 1e-15 and abs(abs(v[2, 0]) - 1) < 1e-15 and np.abs(v[:, 3]).max() < 1e-15


def test_close_roots_keep_their_vectors(spark):
    q, _ = np.linalg.qr(np.random.default_rng(1).normal(size=(5, 5)))
    a = np.round(q @ np.diag([1e12, 1e12 + 40, 5e11, 3, 1]) @ q.T * 1.0)
    a = ((a + a.T) / 2).astype(np.int64).astype(object)
    found = whitening.components(spark, a)
    for size, _, v in found:  # the residual in whole numbers
        w = [Fraction(x) for x in v]
        r = [sum(int(a[i, j]) * w[j] for j in range(5)) - Fraction(size) ** 2 * w[i] for i in range(5)]
        assert max(abs(float(x)) for x in r) < 1e12 * 1e-15


def _whitened(x, k=4):
    fit = np.unique(x, axis=0)
    c = fit - fit.mean(axis=0)
    v = c.T @ c / len(fit)
    e, vectors_ = np.linalg.eigh(v)
    e, vectors_ = e[::-1][:k], vectors_[:, ::-1][:, :k]
    return len(fit), fit.sum(axis=0).astype(int), (x - fit.mean(axis=0)) @ vectors_ / np.sqrt(e), e / np.trace(v)


def _compare(rows, plain):
    x = np.array([p[1] for p in plain], float)
    n, s, want, explained = _whitened(x)
    seen, got = Counter(), []
    for r in rows:  # rows that are alike are told apart by how often they were seen
        key = (r.vec_id is None, r.vec_id or 0, r.deviation)
        got.append((*key, seen[key, r.component], r.component, r.whitened, r.explained, r.n, r.identity_error, r.deviation_exact))
        seen[key, r.component] += 1
    got.sort()
    dev = [sum((n * a - b) ** 2 for a, b in zip(p[1], s.tolist())) for p in plain]
    order = sorted(range(len(plain)), key=lambda k: (plain[k][0] is None, plain[k][0] or 0, dev[k]))
    assert len(got) == 4 * len(plain)
    table = np.array([[g[5] for g in got[4 * k : 4 * k + 4]] for k in range(len(plain))])
    signs = np.sign((table * want[order]).sum(axis=0))
    assert np.abs(table * signs - want[order]).max() < 1e-9
    for at, k in enumerate(order):
        for c in range(4):
            g = got[4 * at + c]
            assert g[2] == dev[k] == int(g[9]) and g[4] == c + 1 and g[7] == n and g[8] < 1e-10
            assert abs(g[6] / explained[c] - 1) < 1e-9


def test_whitening_equals_numpy_on_odd_rows(spark):
    table = _odd_vectors(spark)
    _compare(whitening.whiten(vectors.integer_vectors(table)).collect(), [p for p in _plain(table.collect(), 6)])


def test_op11_equals_numpy(spark):
    rows = pq.read_table(f"{SF}/embeddings.parquet").to_pylist()
    plain = [(r["vec_id"], [math.floor(256 * v) for v in r["embedding"]]) for r in rows]
    _compare(whitening.op11_whitening(spark, SF).collect(), plain)


def test_one_distinct_vector_has_no_component(spark):
    rows = spark.createDataFrame([(k, [1.0, 2.0], 1) for k in range(5)], SCHEMA)
    found = whitening.whiten(vectors.integer_vectors(rows))
    assert found.collect() == [] and [n for n, _ in found.dtypes][-1] == "identity_error"


def test_large_entries_and_counts_stay_exact():
    w = whitening.Whitening(1 << 40, [5, -(1 << 60)], [(3.0, 1.0, [1.0, 0.0])])
    dev = w.deviations(np.array([[1 << 27, -(1 << 27)]]))
    assert dev.tolist() == [[(1 << 67) - 5, -(1 << 67) + (1 << 60)]]
    assert w.squares(dev) == [((1 << 67) - 5) ** 2 + ((1 << 67) - (1 << 60)) ** 2]
    x = np.random.default_rng(0).integers(-(1 << 27), 1 << 27, (50, 3))
    assert (whitening._exact_products(x) == x.T.astype(object).dot(x.astype(object))).all()
