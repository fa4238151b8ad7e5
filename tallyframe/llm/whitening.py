"""Operator 11, whitening of embeddings with components from an exact characteristic polynomial.

1. The fit list is every distinct integer vector once. Its count n, sums S and products P are summed exactly, so
   A = n P - S S' is n^2 times the covariance in whole numbers.
2. A's characteristic polynomial modulo each of many 31-bit primes, by reduction to Hessenberg form; the primes are dealt over
   tasks. Chinese remaindering gives its integer coefficients: their bound follows from the trace.
3. All roots are real, so the sign changes of the polynomial shifted by a count exactly the roots above a. Bisection
   by that count isolates the largest roots, the sign of the polynomial narrows a simple one down to ``PRECISION`` bits.
4. A component spans the null space of A - root: inverse iteration in fixed point with ``PRECISION`` further
   bits, a task a root. Roots that agree to all those bits get an orthonormal basis together.

With components v and roots r, a row's whitened value is (n x - S) v / sqrt(r).

Scale: the corpus is read for the distinct vectors, for the sums (each partition gives one row a pair of
dimensions, summed by map-side combine), for the covariance of the whitened values, and for the result. What reaches
the driver is bounded by the dimensions: sums, residues, components.

Cases: vectors left out are those of ``vectors.integer_vectors``. Components of a zero root do not exist, so fewer than ``k`` may
come; with none (an empty table, one distinct vector) the result is empty. Rows that repeat an id or a vector each
have their rows; a null id stays null. A deviation that passes a long is null there and whole in
``deviation_exact``. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, written
from .vectors import embeddings, integer_vectors, matrix

K = 4
#: Significant bits of a root, and bits behind the point in inverse iteration beyond those of the matrix.
PRECISION = 128
#: Entries are cut into halves of so many bits, whose products sum exactly in doubles over ``ROWS`` rows.
HALF_BITS, ROWS = 14, 1 << 20

SUMS = "i int, j int, v decimal(38,0)"
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, deviation_exact decimal(38,0)"


# ---- sums over the fit list --------------------------------------------------------------

def _exact_products(x: np.ndarray) -> np.ndarray:
    """x' x as Python integers."""
    total = np.zeros((x.shape[1], x.shape[1]), object)
    for at in range(0, len(x), ROWS):
        high, low = np.divmod(x[at : at + ROWS], 1 << HALF_BITS)
        high, low = high.astype(float), low.astype(float)
        hh, hl, ll = ((a.T @ b).astype(np.int64).astype(object) for a, b in ((high, high), (high, low), (low, low)))
        total += (hh << 2 * HALF_BITS) + ((hl + hl.T) << HALF_BITS) + ll
    return total


def scatter(fit: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """(n, S, A) of the vectors ``x``: A = n times the sum of x x' less S S'."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, p = 0, 0, 0
        for batch in batches:
            x = matrix(batch.column("x"))
            n, s, p = n + len(x), s + x.sum(axis=0).astype(object), p + _exact_products(x)
        if n:
            i, j = np.triu_indices(len(s))
            rows = [(-1, -1, n), *[(k, -1, v) for k, v in enumerate(s)], *zip(i.tolist(), j.tolist(), p[i, j])]
            cells = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                     pa.array([Decimal(int(r[2])) for r in rows], pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays(cells, names=["i", "j", "v"])

    found = {(r.i, r.j): int(r.v) for r in map_arrow(fit, sums, SUMS).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}
    n = found.get((-1, -1), 0)
    dims = sum(j == -1 for _, j in found) - (n > 0)
    s = [found[k, -1] for k in range(dims)]
    a = np.zeros((dims, dims), object)
    for (i, j), v in found.items():
        if j >= 0:
            a[i, j] = a[j, i] = n * v - s[i] * s[j]
    return n, s, a


# ---- characteristic polynomial -----------------------------------------------------------

def primes_below(top: int, bits: float) -> list[int]:
    """The largest primes below ``top`` (at most 2^31) whose product has more than ``bits`` bits."""

    def is_prime(p: int) -> bool:
        if any(p % q == 0 for q in (3, 5, 7, 11, 13)):
            return False
        odd, twos = p - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1
        for base in (2, 3, 5, 7):  # enough below 3 215 031 751
            x = pow(base, odd, p)
            if x not in (1, p - 1) and all((x := x * x % p) != p - 1 for _ in range(twos - 1)):
                return False
        return True

    out, p, have = [], top | 1, 0.0
    while have <= bits:
        p -= 2
        if is_prime(p):
            out.append(p)
            have += math.log2(p)
    return out


def polynomial_modulo(m: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x - m) modulo the prime ``p`` < 2^31, constant first."""
    m, d = m.copy(), len(m)
    for k in range(d - 2):
        below = np.flatnonzero(m[k + 1 :, k])
        if not len(below):
            continue
        r = k + 1 + int(below[0])
        if r != k + 1:
            m[[r, k + 1]] = m[[k + 1, r]]
            m[:, [r, k + 1]] = m[:, [k + 1, r]]
        f = m[k + 2 :, k] * pow(int(m[k + 1, k]), -1, p) % p
        m[k + 2 :] = (m[k + 2 :] - f[:, None] * m[k + 1] % p) % p
        m[:, k + 1] = (m[:, k + 1] + (m[:, k + 2 :] * f % p).sum(axis=1)) % p
    # Of the leading k x k part of a Hessenberg matrix, from those of the smaller parts.
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(d):
        polys[k + 1, 1:] = polys[k, :-1]
        weights, chain = np.zeros(k + 1, np.int64), 1
        for i in range(k, -1, -1):
            weights[i] = int(m[i, k]) * chain % p
            chain = chain * int(m[i, i - 1]) % p if i else 0
        polys[k + 1] = (polys[k + 1] - (weights[:, None] * polys[: k + 1] % p).sum(axis=0)) % p
    return polys[d]


def characteristic_polynomial(spark: SparkSession, a: np.ndarray) -> list[int]:
    """Integer coefficients of det(x - a), constant first, of a symmetric matrix without negative roots.

    A coefficient is at most that of (x + trace / d)^d, so at most (1 + trace / d)^d.
    """
    d, entries = len(a), [[int(v) for v in row] for row in a]
    bits = d * math.log2(2 + sum(entries[i][i] for i in range(d)) // d) + 2
    primes = primes_below(1 << 31, bits)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column("p").to_pylist():
                found = polynomial_modulo(np.array([[v % p for v in row] for row in entries], np.int64), p)
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([found.tolist()], pa.list_(pa.int64()))], names=["p", "c"])

    cores = spark.sparkContext.defaultParallelism
    rows = spark.createDataFrame([(p,) for p in primes], "p long").repartition(min(len(primes), 4 * cores))
    residues = {r.p: r.c for r in map_arrow(rows, reduce, "p long, c array<long>").collect()}
    whole = math.prod(primes)
    parts = [(whole // p) * pow(whole // p, -1, p) for p in primes]
    out = [sum(r * residues[p][k] for p, r in zip(primes, parts)) % whole for k in range(d + 1)]
    return [c - whole if 2 * c > whole else c for c in out]


# ---- roots -----------------------------------------------------------------------------------

def roots_above(poly: np.ndarray, at: int) -> int:
    """How many roots of the real-rooted ``poly`` (integers, constant first) are greater than ``at`` >= 0: sign changes of
    poly(x + at). Powers of ``at`` are multiplied in first, which leaves signs alone and makes it a shift by one."""
    c = np.array([v * at**i for i, v in enumerate(poly)] if at else poly, object)
    if at:
        for i in range(len(c) - 1):
            c[i:] = np.add.accumulate(c[i:][::-1])[::-1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def largest_roots(poly: list[int], top: int, k: int, precision: int = PRECISION) -> list[tuple[Fraction, int]]:
    """(root, how many of the largest share it) of the ``k`` largest positive roots, falling; ``top`` is at least the largest.

    A root is good to ``precision`` significant bits; roots that agree to them count as one.
    """
    d = len(poly) - 1

    def value(c, y):
        out = 0
        for v in reversed(c):
            out = out * y + v
        return out

    found: list[tuple[Fraction, int]] = []
    positive, have = roots_above(poly, 0), 0
    while have < min(k, positive):
        scale = max(0, precision + 8 - top.bit_length())
        while True:
            scaled = [v << scale * (d - i) for i, v in enumerate(poly)]
            low, high, above_low, above_high = 0, top + 1 << scale, positive, 0
            # Invariant: more than ``have`` roots above low, at most ``have`` above high.
            while high - low > 1:
                mid = (low + high) // 2
                if above_low - above_high == 1:
                    s = value(scaled, mid)
                    n = above_high if s == 0 or (s > 0) == (above_high % 2 == 0) else above_low
                    if s == 0:
                        low = high = mid
                        break
                else:
                    n = roots_above(scaled, mid)
                if n > have:
                    low, above_low = mid, n
                else:
                    high, above_high = mid, n
            if high.bit_length() >= precision:
                break
            scale += precision + 1 - high.bit_length()  # a small root: finer steps
        times = max(1, above_low - above_high)
        found.append((Fraction(low + high, 2 << scale), min(times, k - have)))
        have += times
    return found


# ---- components ------------------------------------------------------------------------------

def null_space(a: np.ndarray, root: Fraction, m: int, precision: int = PRECISION, rounds: int = 3) -> list[list[float]]:
    """``m`` orthonormal vectors that a - root takes to nearly zero, by inverse iteration in fixed point."""
    d = len(a)
    bits = 2 * precision + int(max(abs(v) for v in a.ravel())).bit_length()
    u = np.array([[int(v) << bits for v in row] for row in a], object)
    shift = (root.numerator << bits) // root.denominator
    for i in range(d):
        u[i, i] -= shift
    order, factors = list(range(d)), []
    for k in range(d):
        r = k + max(range(d - k), key=lambda i: abs(u[k + i, k]))
        if r != k:
            u[[r, k]] = u[[k, r]]
            order[r], order[k] = order[k], order[r]
            for f in factors:
                f[r], f[k] = f[k], f[r]
        pivot = u[k, k] or 1
        u[k, k] = pivot
        f = np.array([0] * d, object)
        f[k + 1 :] = [(v << bits) // pivot for v in u[k + 1 :, k]]
        u[k + 1 :, k:] -= (f[k + 1 :, None] * u[k, k:][None, :]) >> bits
        factors.append(f)

    def solve(b):
        y = np.array([b[i] for i in order], object)
        for k, f in enumerate(factors):
            y[k + 1 :] -= (f[k + 1 :] * y[k]) >> bits
        for k in range(d - 1, -1, -1):
            y[k] = ((y[k] - (int((u[k, k + 1 :] * y[k + 1 :]).sum()) >> bits if k + 1 < d else 0)) << bits) // u[k, k]
        return y

    def unit(v):
        return np.array([(int(x) << bits) // max(1, math.isqrt(int((v * v).sum()))) for x in v], object)

    rng = np.random.default_rng(0)
    basis = [unit(np.array([int(x) for x in rng.integers(1, 1 << 30, d)], object)) for _ in range(m)]
    for _ in range(rounds):
        done: list[np.ndarray] = []
        for v in basis:
            v = unit(solve(v))
            for _ in range(2):
                for w in done:
                    v = v - ((w * (int((v * w).sum()) >> bits)) >> bits)
                v = unit(v)
            done.append(v)
        basis = done
    out = []
    for v in basis:
        sign = 1 if v[int(np.argmax(np.abs(v)))] > 0 else -1
        out.append([sign * int(x) / (1 << bits) for x in v])
    return out


def components(spark: SparkSession, a: np.ndarray, k: int = K) -> list[tuple[float, float, list[float]]]:
    """(sqrt of the root, root over the trace, unit vector) of the ``k`` largest positive roots of ``a``."""
    trace = sum(int(a[i, i]) for i in range(len(a)))
    if not trace:
        return []
    roots = largest_roots(characteristic_polynomial(spark, a), trace, k)
    rows = spark.createDataFrame([(i, str(r.numerator), str(r.denominator), m) for i, (r, m) in enumerate(roots)],
                                 "i int, over string, under string, m int").repartition(len(roots), "i")

    def iterate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                vectors = null_space(a, Fraction(int(r["over"]), int(r["under"])), r["m"])
                yield pa.RecordBatch.from_arrays([pa.array([r["i"]], pa.int32()), pa.array([vectors], pa.list_(pa.list_(pa.float64())))], names=["i", "v"])

    found = {r.i: r.v for r in map_arrow(rows, iterate, "i int, v array<array<double>>").collect()}
    out = []
    for i, (root, _) in enumerate(roots):
        # floor(sqrt(root * 4^60)) has over 60 significant bits
        up = max(0, 60 - root.numerator.bit_length() // 2 + root.denominator.bit_length() // 2)
        size = Fraction(math.isqrt((root.numerator << 2 * up) // root.denominator), 1 << up)
        out += [(float(size), float(root / trace), v) for v in found[i]]
    return out


# ---- whitened rows ---------------------------------------------------------------------------

class Whitening:
    """n, sums and components of a fit list, applied to vectors."""

    def __init__(self, n: int, sums: list[int], found: list[tuple[float, float, list[float]]]):
        self.n, self.sums = n, sums
        self.sizes = np.array([f[0] for f in found])
        self.explained = np.array([f[1] for f in found])
        self.vectors = np.array([f[2] for f in found]).reshape(len(found), len(sums)).T

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exactly: longs where they hold it, else Python integers."""
        most = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        kind = np.int64 if most < 1 << 62 else object
        return x.astype(kind) * self.n - np.array(self.sums, kind)

    def squares(self, dev: np.ndarray) -> list[int]:
        if dev.dtype != object and dev.shape[1] * int(np.abs(dev).max(initial=0)) ** 2 >= 1 << 63:
            dev = dev.astype(object)
        return [int(v) for v in (dev * dev).sum(axis=1)] if dev.size else [0] * len(dev)

    def whitened(self, dev: np.ndarray) -> np.ndarray:
        return dev.astype(float) @ self.vectors / self.sizes


def _whitened_columns(vectors: DataFrame, w: Whitening) -> DataFrame:
    names = [f"w{k}" for k in range(len(w.sizes))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = w.whitened(w.deviations(matrix(batch.column("x"))))
            yield pa.RecordBatch.from_arrays([pa.array(found[:, k]) for k in range(len(names))], names=names)

    return map_arrow(vectors, run, ", ".join(f"{n} double" for n in names))


def identity_error(fit: DataFrame, w: Whitening) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity."""
    k = len(w.sizes)
    pairs = [F.abs(F.covar_pop(f"w{i}", f"w{j}") - (1.0 if i == j else 0.0)).alias(f"{i}_{j}") for i in range(k) for j in range(i, k)]
    return max(_whitened_columns(fit, w).agg(*pairs).first())


def whiten(vectors: DataFrame, k: int = K) -> DataFrame:
    """The rows of ``vectors`` (vec_id, x) on the ``k`` components of their distinct vectors."""
    fit = written(vectors.select("x").distinct(), "whiten-fit")
    n, sums, a = scatter(fit)
    w = Whitening(n, sums, components(vectors.sparkSession, a, k) if n else [])
    k = len(w.sizes)
    error = identity_error(fit, w) if k else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.decimal128(38, 0))
        for batch in batches if k else ():
            dev = w.deviations(matrix(batch.column("x")))
            m, squares = len(dev), w.squares(dev)
            ids = batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k)))
            each = lambda values: [v for v in values for _ in range(k)]
            cells = [ids, np.tile(np.arange(1, k + 1, dtype=np.int32), m), [w.n] * (m * k), each([v if v < 1 << 63 else None for v in squares]),
                     w.whitened(dev).ravel(), np.tile(w.explained, m), each([Decimal(v) if v < 10**38 else None for v in squares])]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cells, kinds)],
                                             names=[f.split()[0] for f in RESULT.split(", ")])

    return map_arrow(vectors, run, RESULT).withColumn("identity_error", F.lit(error).cast("double"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(written(integer_vectors(embeddings(spark, sf_dir)), "whiten-vectors"))
