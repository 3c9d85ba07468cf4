import math
import random
from fractions import Fraction

import numpy as np
import pytest

from wattspark.llm import whitening as w


def plain(rows, k):
    """(n, per row deviation, whitened up to sign) by NumPy on the distinct vectors."""
    good = [(key, [math.floor(256 * float(c)) for c in v]) for key, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in good}), float)
    mean = fit.mean(0)
    values, vectors = np.linalg.eigh((fit - mean).T @ (fit - mean) / len(fit))
    values, vectors = values[::-1], vectors[:, ::-1]
    sums = [sum(int(x) for x in c) for c in fit.T]
    out = {}
    for key, x in good:
        deviation = sum((len(fit) * a - s) ** 2 for a, s in zip(x, sums))
        out.setdefault(key, []).append((deviation, [float((np.array(x) - mean) @ vectors[:, i] / math.sqrt(values[i])) for i in range(k)]))
    return len(fit), out, [v / values.sum() for v in values[:k]]


def vectors(seed, n=300, size=6):
    r = random.Random(seed)
    rows = [(i, [r.gauss(0, 1 + j / 3) for j in range(size)]) for i in range(n)]
    rows += [(n, rows[0][1]), (0, rows[1][1]), (None, rows[2][1])]
    return rows


def test_whitened_rows_against_numpy(spark):
    rows = vectors(1)
    odd = [(900, None), (901, []), (902, [None] * 6), (903, [float("nan")] * 6), (904, [float("inf")] + [0.0] * 5), (905, [1.0] * 3), (906, [-0.0] * 6)]
    docs = spark.createDataFrame([(*x, 1.0, "c") for x in rows + odd], "vec_id long, embedding array<float>, whitened double, x string")
    as_float = [(k, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for k, v in rows + odd if k != 905]
    n, want, shares = plain(as_float, 4)
    got = w.whiten(docs).collect()
    assert len(got) == 4 * sum(map(len, want.values()))
    signs = {}
    for r in got:
        assert r.n == n and r.identity_error < 1e-9 and abs(r.explained / shares[r.component - 1] - 1) < 1e-9
        candidates = [x for d, x in want[r.vec_id] if d == int(r.deviation)]
        assert candidates
        value = candidates[0][r.component - 1]
        if abs(value) > 1e-6:
            sign = round(r.whitened / value)
            assert signs.setdefault(r.component, sign) == sign and abs(r.whitened - sign * value) < 1e-9


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5, 0.25]), (2, [0.5, 0.25])]])
def test_nothing_to_whiten(spark, rows):
    found = w.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert found.count() == 0


def test_low_rank_and_large_numbers(spark):
    """Two of three places depend on the first; sums of products exceed 64 bits."""
    rows = [(i, [float(i) * 2**30, float(i) * 2**31, 7.0]) for i in range(50)]
    got = w.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 50 and {r.component for r in got} == {1}
    sums = [sum(math.floor(256 * v[j]) for _, v in rows) for j in range(3)]
    for r in got:
        assert int(r.deviation) == sum((50 * math.floor(256 * c) - s) ** 2 for c, s in zip(rows[r.vec_id][1], sums))
        assert r.explained == 1.0 and r.identity_error < 1e-9


def test_polynomial_roots_and_vectors(spark):
    r = random.Random(2)
    n = 9
    x = [[r.randint(-9, 9) for _ in range(n)] for _ in range(n - 2)]
    m = [[sum(row[i] * row[j] for row in x) for j in range(n)] for i in range(n)]
    poly = w.characteristic_polynomial(spark, m)
    assert poly[:2] == [0, 0] and poly[2] != 0 and poly[n] == 1 and -poly[n - 1] == sum(m[i][i] for i in range(n))
    want = sorted(np.linalg.eigvalsh(np.array(m, float)))[::-1]
    roots = w.largest_roots(poly, n - 2)
    assert np.allclose([float(v) for v in roots], want[: n - 2], rtol=1e-9)
    for root, v in zip(roots, w.null_vectors(m, roots)):
        residual = [sum(Fraction(m[i][j]) * Fraction(v[j]) for j in range(n)) - root * Fraction(v[i]) for i in range(n)]
        assert max(map(abs, residual)) < 1e-60


def test_repeated_and_close_roots(spark):
    # Roots 5, 5, 5, 2 and a pair that differs in the twentieth digit.
    big = 10**20
    m = [[0] * 6 for _ in range(6)]
    for i, v in enumerate([5, 5, 2, 5, big, big + 1]):
        m[i][i] = v
    poly = w.characteristic_polynomial(spark, m)
    roots = w.largest_roots(poly, 6)
    assert roots == [big + 1, big, 5, 5, 5, 2]
    found = w.null_vectors(m, roots)
    gram = [[float(sum(Fraction(a) * Fraction(b) for a, b in zip(x, y))) for y in found] for x in found]
    assert np.allclose(gram, np.eye(6), atol=1e-50)
    assert abs(float(found[0][5])) == 1 and abs(float(found[1][4])) == 1 and abs(float(found[5][2])) == 1
