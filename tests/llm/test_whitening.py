import random
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest

from foliowire.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, w string, n int"


@pytest.fixture
def vectors(rows):
    return lambda data, schema=SCHEMA: rows([(i, v, 1, "x", 2) for i, v in data], schema)


def brute_polynomial(matrix):
    """Faddeev and LeVerrier over fractions, constant first."""
    d = len(matrix)
    a = [[Fraction(int(x)) for x in r] for r in matrix]
    m, out = [[Fraction(0)] * d for _ in range(d)], [Fraction(1)]
    for k in range(1, d + 1):
        m = [[sum(a[i][t] * m[t][j] for t in range(d)) + (out[0] if i == j else 0) for j in range(d)] for i in range(d)]
        out.insert(0, -sum(sum(a[i][t] * m[t][i] for t in range(d)) for i in range(d)) / k)
    return [int(c) for c in out]


def check(df, data, dtype=np.float32, components=8):
    """Compare with a plain eigendecomposition, up to sign."""
    kept = [(i, np.array(v, dtype=dtype).astype(float)) for i, v in data if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    x = np.floor(1024 * np.stack([v for _, v in kept])) + 100000
    n, whole = len(x), [[int(c) for c in r] for r in x]
    sums = [sum(c) for c in zip(*whole, strict=True)]
    centred = x - x.mean(axis=0)
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    got = df.collect()
    r = len(got) // n
    by = {}
    for row in got:
        by.setdefault((row.vec_id, int(row.deviation)), {})[row.component] = row
    want = centred @ u[:, :r] / np.sqrt(e[:r])
    mine, theirs = [], []
    for (i, _), ints, w in zip(kept, whole, want, strict=True):
        deviation = sum((n * a - s) ** 2 for a, s in zip(ints, sums, strict=True))
        row = by[i, deviation]
        assert sorted(row) == list(range(1, r + 1)) and all(c.n == n for c in row.values())
        np.testing.assert_allclose([row[k].explained for k in sorted(row)], e[:r] / np.trace(cov), rtol=1e-9, atol=1e-15)  # eigh is exact to the largest only
        assert row[1].identity_error < 1e-9
        mine.append([row[k].whitened for k in sorted(row)])
        theirs.append(w)
    mine, theirs = np.array(mine), np.array(theirs)
    if np.all(np.diff(-e[:r]) > 1e-6 * e[0]):  # single eigenvalues
        theirs *= np.sign((mine * theirs).sum(axis=0))
        np.testing.assert_allclose(mine, theirs, atol=1e-7)
    return r


def test_equals_plain_decomposition(vectors):
    rng = np.random.default_rng(1)
    mix = rng.normal(size=(12, 12)) * np.linspace(0.1, 3, 12)
    data = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(200, 12)) @ mix)]
    data += [(300, None), (301, [1.0] * 11 + [float("nan")]), (302, [float("inf")] + [0.0] * 11), (303, [None] + [0.0] * 11), (304, []), (305, [1.0, 2.0])]
    data += [(None, data[3][1]), (2**60 + 1, data[4][1]), (2**60 + 1, data[4][1]), (7, data[7][1])]
    usable = [r for r in data if r[0] not in (304, 305)]
    got = whitening.whitened(vectors(data))
    assert check(got, usable) == 8
    assert {r.vec_id for r in got.collect()} == {i for i, v in usable if i is None or i < 300 or i > 400}


def test_small_dimension_and_low_rank(vectors):
    rng = np.random.default_rng(2)
    data = [(i, [float(a), float(b), float(a), 5.0]) for i, (a, b) in enumerate(rng.integers(-50, 50, size=(40, 2)))]
    assert check(whitening.whitened(vectors(data)), data) == 2


def test_repeated_eigenvalues_give_orthonormal_components(vectors):
    data = [(2 * i + s, [float((1 - 2 * s) * (j == i)) for j in range(5)]) for i in range(5) for s in (0, 1)]
    assert check(whitening.whitened(vectors(data)), data) == 5


def test_degenerate_tables(vectors):
    assert whitening.whitened(vectors([])).collect() == []
    assert whitening.whitened(vectors([(1, [1.0, 2.0])])).collect() == []
    assert whitening.whitened(vectors([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    assert whitening.whitened(vectors([(1, None), (2, [])])).collect() == []
    assert set(whitening.whitened(vectors([])).columns) == {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"}


def test_wide_ranges_stay_exact(vectors):
    rng = np.random.default_rng(3)
    scale = [1.0, 1e3, 1e6, 1e9]
    data = [(i, [float(x) for x in v * scale]) for i, v in enumerate(rng.normal(size=(60, 4)))]
    schema = SCHEMA.replace("float", "double")
    rows = whitening.whitened(vectors(data, schema))
    assert check(rows, data, dtype=np.float64) == 4
    extreme = whitening.whitened(vectors([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0])], schema)).collect()
    assert {r.component for r in extreme} == {1, 2} and all(np.isfinite(r.whitened) for r in extreme)
    assert extreme[0].identity_error < 1e-9


def test_polynomial_is_exact(spark):
    rng = random.Random(4)
    for d in (1, 2, 5, 9):
        g = np.array([[rng.randrange(-10**9, 10**9) for _ in range(d)] for _ in range(d + 2)], dtype=object)
        matrix = g.T @ g
        assert whitening.characteristic_polynomial(spark, matrix) == brute_polynomial(matrix)
    sparse = np.array([[4, 0, 1], [0, 9, 0], [1, 0, 4]], dtype=object)
    assert whitening.characteristic_polynomial(spark, sparse) == brute_polynomial(sparse)


def test_roots_are_isolated():
    roots = [1, 1, 2, 3, 3, 3, 1000, 10**12]
    c = [1]
    for r in roots:
        c = [(c[i - 1] if i else 0) - (r * c[i] if i < len(c) else 0) for i in range(len(c) + 1)]
    for j, want in enumerate(sorted(roots, reverse=True), 1):
        m, s = whitening.isolated_root(c, j)
        assert abs(Fraction(m, 2**s) - want) <= Fraction(want, 2**150)
    m, s = whitening.isolated_root([1, -3 * 2**400, 2**800], 2)  # a root far below one
    assert Fraction(0) < Fraction(m, 2**s) < Fraction(1, 2**399)


def test_null_vectors_solve_to_high_precision():
    matrix = [[2, 1, 0], [1, 2, 0], [0, 0, 3]]
    vectors = whitening.null_vectors(matrix, Decimal(3), 2)
    for v in vectors:
        image = [sum(a * x for a, x in zip(row, v, strict=True)) - 3 * x for row, x in zip(matrix, v, strict=True)]
        assert max(map(abs, image)) < Decimal(10) ** -20
    assert abs(sum(a * b for a, b in zip(*vectors, strict=True))) < Decimal(10) ** -20
