"""Embedding whitening from the exact characteristic polynomial of the integer scatter.

Entries become integers, floor(scale * c), and every distinct vector counts once. Two passes over the
distinct vectors give the scatter: first their sums, then the products of the vectors moved by the rounded
mean; both are exact integers, summed per task and then by Spark. With n vectors the integer matrix M = n * n * V
is formed from them without rounding (V: covariance with divisor n).

The characteristic polynomial of M is found modulo many primes below 2**31, one prime a row of a Spark job, by
reduction to Hessenberg form, and put together by Chinese remaindering; Maclaurin's inequality bounds its
coefficients. As all its roots are real, Descartes' rule counts the roots above any number exactly,
multiplicities included; bisection with that count isolates the largest roots, and the sign of the polynomial
then narrows them to `BITS` bits behind the point. Components come from inverse iteration at those roots with
`DIGITS` decimal digits; a root that occurs several times gets an orthonormal basis of its space.

Only matrices of the vectors' dimension reach the driver. All vectors are projected in one pass.

Defined cases: rows whose vector is null, empty, or holds null or non-finite entries are dropped, and so are
vectors of another length than the commonest (of equally common ones, the shortest); a component whose
eigenvalue is exactly zero can't be whitened and is left out, so equal vectors alone give no rows; repeated rows
and null keys each give their rows; an empty table gives an empty result; entries of 2**48 and more after scaling
are an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattspark.operators.common import attach_one_row, settle

BITS = 256
DIGITS = 160
LARGEST = 1 << 48
_EXACT = 1 << 53  # whole numbers below are exact as doubles
_START = 1_000_003  # of the start vectors' entries


def integer_vectors(rows: DataFrame, vector: str, out: str, scale: int = 256) -> DataFrame:
    """Adds `out` (array of long): floor(scale * c) of each entry. Rows without a whole finite vector are dropped."""
    v = F.col(f"`{vector}`")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    good = rows.where(v.isNotNull() & (F.size(v) > 0)).where(F.forall(v, lambda c: finite(c.cast("double"))))
    scaled = lambda c: F.lit(float(scale)) * c.cast("double")
    whole = lambda c: F.when(F.abs(scaled(c)) < float(LARGEST), F.floor(scaled(c))).otherwise(F.raise_error(F.lit("an entry is too large")).cast("long"))
    return good.withColumn(out, F.transform(v, whole))


def _matrix(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return batch.column(0).flatten().to_numpy().reshape(-1, size)


def column_sums(vectors: DataFrame, size: int) -> list[int]:
    """Exact sums of each place of `vectors` (one column of arrays)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * size
        for b in batches:
            m = _matrix(b, size)
            for i in range(0, len(m), 1 << 14):  # entries are below 2**48
                total = [t + s for t, s in zip(total, m[i : i + (1 << 14)].sum(axis=0).tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(map(Decimal, total), pa.decimal128(38, 0))], ["i", "s"])

    found = vectors.mapInArrow(run, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()
    return [int(r.s) for r in sorted(found)]


def scatter(vectors: DataFrame, centre: list[int]) -> list[list[int]]:
    """Exact sums of the products of all pairs of places, after `centre` is taken off."""
    size = len(centre)
    upper = np.triu_indices(size)

    def product(y: np.ndarray) -> np.ndarray:
        most = int(np.abs(y).max(initial=0))
        rows = _EXACT // (most * most + 1)
        if rows < 64:
            whole = y.astype(object)
            return (whole.T @ whole)[upper]
        total = np.zeros(len(upper[0]), object)
        for i in range(0, len(y), rows):
            part = y[i : i + rows].astype(np.float64)
            total += np.array((part.T @ part)[upper].astype(np.int64).tolist(), object)
        return total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(upper[0]), object)
        for b in batches:
            total += product(_matrix(b, size) - np.array(centre, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(u.astype(np.int32)) for u in upper] + [pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))], ["i", "j", "s"])

    found = vectors.mapInArrow(run, "i int, j int, s decimal(38,0)").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    out = [[0] * size for _ in range(size)]
    for r in found:
        out[r.i][r.j] = out[r.j][r.i] = int(r.s)
    return out


def primes_below(start: int, product: int) -> list[int]:
    """Primes downwards from `start`, as many as make their product exceed `product`."""
    small = [p for p in range(2, math.isqrt(start) + 1) if all(p % q for q in range(2, math.isqrt(p) + 1))]
    out, n, made = [], start, 1
    while made <= product:
        if all(n % p for p in small):
            out.append(n)
            made *= n
        n -= 1
    return out


def polynomial_modulo(matrix: np.ndarray, p: int) -> list[int]:
    """Characteristic polynomial modulo the prime p, coefficients from the constant on, by Hessenberg form."""
    h, n = matrix % p, len(matrix)
    for m in range(1, n - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        i = m + int(below[0])
        if i != m:
            h[[i, m]] = h[[m, i]]
            h[:, [i, m]] = h[:, [m, i]]
        u = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - u[:, None] * h[m]) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * u % p).sum(axis=1)) % p
    polys = np.zeros((n + 1, n + 1), np.int64)
    polys[0, 0] = 1
    for k in range(1, n + 1):
        new = np.zeros(n + 1, np.int64)
        new[1:] = polys[k - 1, :-1]
        new = (new - h[k - 1, k - 1] * polys[k - 1]) % p
        chain, factors = 1, np.zeros(k, np.int64)
        for i in range(1, k):
            chain = chain * int(h[k - i, k - i - 1]) % p
            factors[k - i - 1] = int(h[k - i - 1, k - 1]) * chain % p
        polys[k] = (new - (factors[:, None] * polys[:k] % p).sum(axis=0)) % p
    return polys[n].tolist()


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Exact coefficients, from the constant on, of a positive semidefinite integer matrix."""
    n, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    # No elementary symmetric function of the roots exceeds that of equal roots.
    bound = max(math.comb(n, k) * trace**k // n**k + 1 for k in range(n + 1))
    primes = primes_below((1 << 31) - 1, 2 * bound + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for k in b.column(0).to_pylist():
                p = primes[k]
                found.append(polynomial_modulo(np.array([[x % p for x in row] for row in matrix], np.int64), p))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], ["id", "residues"])

    tasks = min(len(primes), 4 * spark.sparkContext.defaultParallelism)
    rows = spark.range(0, len(primes), 1, tasks).mapInArrow(run, "id long, residues array<long>").collect()
    whole, made = [0] * (n + 1), 1
    for r in rows:
        p = primes[r.id]
        back = pow(made, -1, p)
        whole = [w + made * ((x - w) * back % p) for w, x in zip(whole, r.residues)]
        made *= p
    return [w - made if 2 * w > made else w for w in whole]


def roots_above(poly: list[int], a: int) -> int:
    """How many roots of a polynomial with real roots only are greater than a (Descartes' rule, exact)."""
    c = poly[::-1]
    for i in range(len(c) - 1):  # Taylor shift by repeated division
        for j in range(1, len(c) - i):
            c[j] += a * c[j - 1]
    signs = [x > 0 for x in c if x]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def largest_roots(poly: list[int], count: int) -> list[Fraction]:
    """The `count` largest roots (with repetitions), falling, to `BITS` bits behind the point; none may be negative."""
    degree = len(poly) - 1
    scaled = [c << BITS * (degree - k) for k, c in enumerate(poly)]  # its roots are larger by 2**BITS
    top = max(1, -scaled[degree - 1])  # the sum of the roots

    def sign(a: int) -> int:
        value = 0
        for c in reversed(scaled):
            value = value * a + c
        return (value > 0) - (value < 0)

    known = {0: roots_above(scaled, 0), top: 0}
    out = []
    for j in range(1, count + 1):
        low = max(a for a, n in known.items() if n >= j)
        high = min(a for a, n in known.items() if n < j)
        while high - low > 1 and known[low] - known[high] > 1:
            middle = (low + high) // 2
            n = known[middle] = roots_above(scaled, middle)
            low, high = (middle, high) if n >= j else (low, middle)
        # One root is left in (low, high], or they are closer than the precision.
        over = 1 if known[high] % 2 == 0 else -1  # sign between this root and the next
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (low, middle) if sign(middle) in (0, over) else (middle, high)
        out.append(Fraction(high, 1 << BITS))
    return out


def null_vectors(matrix: list[list[int]], roots: list[Fraction]) -> list[list[Decimal]]:
    """Orthonormal vectors, one for each root, by inverse iteration with `DIGITS` digits."""
    n = len(matrix)
    out: list[np.ndarray] = []
    with localcontext() as context:
        context.prec = DIGITS
        tiny = Decimal(10) ** -DIGITS
        whole = np.array([[Decimal(x) for x in row] for row in matrix], object)
        factors: tuple = ()
        for k, root in enumerate(roots):
            if k == 0 or root != roots[k - 1]:
                shifted = whole.copy()
                value = Decimal(root.numerator) / Decimal(root.denominator)
                for i in range(n):
                    shifted[i, i] -= value
                factors = _factorise(shifted, tiny)
            vector = np.array([Decimal((i + 1) * (i + k + 2) % _START * 7919 % _START + 1) for i in range(n)], object)
            for _ in range(3):
                vector = _solve(*factors, vector)
                for other in out:
                    vector = vector - other * sum(vector * other)
                vector = vector / sum(vector * vector).sqrt()
            largest = max(range(n), key=lambda i: abs(vector[i]))
            out.append(vector if vector[largest] > 0 else -vector)
    return [v.tolist() for v in out]


def _factorise(a: np.ndarray, tiny: Decimal) -> tuple[np.ndarray, list[int]]:
    """Triangular factors in place, with row exchanges; a zero pivot is replaced by a tiny one."""
    n, order = len(a), []
    for k in range(n):
        i = max(range(k, n), key=lambda r: abs(a[r, k]))
        order.append(i)
        a[[i, k]] = a[[k, i]]
        if not a[k, k]:
            a[k, k] = tiny
        a[k + 1 :, k] = a[k + 1 :, k] / a[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k, k + 1 :])
    return a, order


def _solve(a: np.ndarray, order: list[int], b: np.ndarray) -> np.ndarray:
    x, n = b.copy(), len(b)
    for k, i in enumerate(order):
        x[[i, k]] = x[[k, i]]
    for k in range(n):
        x[k + 1 :] -= a[k + 1 :, k] * x[k]
    for k in reversed(range(n)):
        x[k] = x[k] / a[k, k]
        x[:k] -= a[:k, k] * x[k]
    return x


@dataclass
class Whitening:
    size: int  # of the vectors
    n: int  # distinct vectors
    sums: list[int]
    eigenvalues: list[float]
    explained: list[float]
    components: list[list[float]]  # unit vectors
    scale: list[float]  # square roots of the eigenvalues


def fit(vectors: DataFrame, components: int = 4) -> Whitening:
    """The whitening of distinct integer vectors (one column of arrays of one length, stored: it is read several times)."""
    spark, n = vectors.sparkSession, vectors.count()
    size = len(vectors.first()[0]) if n else 0
    if not n:
        return Whitening(0, 0, [], [], [], [], [])
    sums = column_sums(vectors, size)
    centre = [(2 * s + n) // (2 * n) for s in sums]
    raw = scatter(vectors, centre)
    moved = [s - n * c for s, c in zip(sums, centre)]
    matrix = [[n * raw[i][j] - moved[i] * moved[j] for j in range(size)] for i in range(size)]
    common = math.gcd(*(x for row in matrix for x in row))
    if not common:
        return Whitening(size, n, sums, [], [], [], [])
    matrix = [[x // common for x in row] for row in matrix]
    poly = characteristic_polynomial(spark, matrix)
    rank = size - next(i for i, c in enumerate(poly) if c)
    roots = largest_roots(poly, min(components, rank))
    unit = null_vectors(matrix, roots)
    trace = sum(matrix[i][i] for i in range(size))
    values = [root * common / n**2 for root in roots]
    with localcontext() as context:
        context.prec = DIGITS
        scale = [float((Decimal(v.numerator) / Decimal(v.denominator)).sqrt()) for v in values]
    return Whitening(size, n, sums, [float(v) for v in values], [float(root / trace) for root in roots], [[float(x) for x in v] for v in unit], scale)


def project(model: Whitening, vector: str) -> Column:
    """struct<deviation, whitened> of integer vectors: sum of (n * x - sums)**2, and the whitened coordinates."""
    sums, n = np.array(model.sums, object), model.n
    basis = np.array(model.components, np.float64).reshape(len(model.scale), model.size).T / np.array(model.scale)
    short = max([abs(s) for s in model.sums], default=0)

    @F.arrow_udf("struct<deviation: decimal(38,0), whitened: array<double>>")
    def run(vectors: pa.Array) -> pa.Array:
        x = vectors.flatten().to_numpy().reshape(len(vectors), -1)
        most = int(np.abs(x).max(initial=0)) * n + short
        if most * most * model.size < 1 << 63:
            y = x * n - sums.astype(np.int64)
            deviation = pa.array((y * y).sum(axis=1)).cast(pa.decimal128(38, 0))
            centred = y / n
        else:
            y = x.astype(object) * n - sums
            deviation = pa.array([Decimal(int(v)) for v in (y * y).sum(axis=1)], pa.decimal128(38, 0))
            centred = (y / n).astype(np.float64)
        white = centred @ basis
        ends = pa.array(np.arange(len(white) + 1, dtype=np.int32) * basis.shape[1])
        return pa.StructArray.from_arrays([deviation, pa.ListArray.from_arrays(ends, pa.array(white.ravel()))], ["deviation", "whitened"])

    return run(F.col(vector))


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 4, scale: int = 256) -> DataFrame:
    """Columns `key`, component (from 1, by falling eigenvalue), n, deviation (decimal), whitened, explained,
    identity_error (the largest entry of the whitened covariance less the identity, over the distinct vectors)."""
    points = integer_vectors(rows.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").alias("v")), "v", "x", scale)
    length = F.size("x")
    distinct = settle(points.select("x").distinct())
    lengths = distinct.groupBy(length.alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").limit(1).collect()
    size = lengths[0]["size"] if lengths else 0
    distinct = distinct.where(length == size)
    model = fit(distinct, components)
    k = len(model.scale)
    # Each entry of the whitened covariance, centred by Spark's own covariance, less that of the identity.
    white = distinct.select(project(model, "x")["whitened"].alias("w")).select(*(F.col("w")[i].alias(f"w{i}") for i in range(k)))
    entries = [F.abs(F.covar_pop(f"w{i}", f"w{j}") - F.lit(float(i == j))) for i in range(k) for j in range(i + 1)]
    error = settle(white.agg(F.greatest(*entries, F.lit(0.0)).alias("identity_error"))) if k else None
    made = points.where(length == size).select("id", project(model, "x").alias("p"))
    made = made.select("id", F.col("p.deviation").alias("deviation"), F.posexplode("p.whitened").alias("i", "whitened"))
    explained = F.array(*map(F.lit, model.explained)) if k else F.array(F.lit(0.0))
    out = attach_one_row(made, error) if k else made.where(F.lit(False)).withColumn("identity_error", F.lit(0.0))
    return out.select(
        F.col("id").alias(key), (F.col("i") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained[F.col("i")].alias("explained"), "identity_error"
    )
