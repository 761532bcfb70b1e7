import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import quadrature as q

RULES = {"leg": np.polynomial.legendre.leggauss, "cheb": np.polynomial.chebyshev.chebgauss, "herm": np.polynomial.hermite.hermgauss, "herme": np.polynomial.hermite_e.hermegauss, "lag": np.polynomial.laguerre.laggauss}


@pytest.mark.parametrize("basis", sorted(RULES))
@pytest.mark.parametrize("degree", [1, 2, 3, 7, 20, 45])
def test_rules_as_numpy(basis, degree):
    nodes, weights = q.gauss(basis, degree)
    want = RULES[basis](degree)
    order = np.argsort(want[0])
    mine = np.argsort(nodes)
    np.testing.assert_allclose(np.array(nodes)[mine], want[0][order], rtol=1e-12, atol=1e-12)
    np.testing.assert_allclose(np.array(weights)[mine], want[1][order], rtol=1e-8, atol=1e-13)


def test_legendre_is_exact_to_twice_its_degree():
    nodes, weights = q.gauss("leg", 30)
    for k in range(60):
        assert math.fsum(w * x**k for x, w in zip(nodes, weights)) == pytest.approx((1 + (-1) ** k) / (k + 1), abs=1e-12)
    with pytest.raises(ValueError):
        q.gauss("leg", 0)


def test_eigenvalues_of_any_tridiagonal_matrix():
    rng = np.random.default_rng(2)
    for n in (1, 2, 9, 40):
        d, e = rng.normal(size=n), rng.normal(size=n - 1) * (rng.random(n - 1) < 0.8)
        values, first = q.tridiagonal(d, e)
        want = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
        np.testing.assert_allclose(values, want, atol=1e-12)
        assert sum(f * f for f in first) == pytest.approx(1)


def test_points_interpolation_and_roots(spark):
    np.testing.assert_allclose(q.chebyshev_points(7), np.polynomial.chebyshev.chebpts1(7), atol=1e-15)
    np.testing.assert_allclose(q.chebyshev_points(7, True), np.polynomial.chebyshev.chebpts2(7), atol=1e-15)
    frame = spark.createDataFrame([(0.7, [1.0, 2.0]), (-1.0, [])], "x double, r array<double>")
    row = frame.select(q.chebyshev_interpolate(lambda x: F.exp(x * 2), 9).alias("c"), q.value_from_roots(F.col("x"), F.col("r")).alias("v")).collect()
    np.testing.assert_allclose(row[0].c, np.polynomial.chebyshev.chebinterpolate(lambda x: np.exp(2 * x), 9), atol=1e-12)
    assert [r.v for r in row] == pytest.approx([0.39, 1.0])
    made = spark.range(1).select(q.companion([F.lit(v) for v in (-6.0, 11.0, -6.0, 1.0)]).alias("m")).first().m
    np.testing.assert_allclose(sorted(np.linalg.eigvals(made).real), [1, 2, 3], atol=1e-9)
