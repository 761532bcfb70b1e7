import numpy as np
import pytest

from tessera.operators import elimination


def test_against_lapack(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(60):
        n = int(rng.integers(1, 8))
        rows.append((i, [[float(v) for v in r] for r in rng.normal(size=(n, n))], [float(v) for v in rng.normal(size=n)]))
    frame = spark.createDataFrame(rows, "`a.i` long, m array<array<double>>, b array<double>")
    by_id = {r[0]: (np.array(r[1]), np.array(r[2])) for r in rows}
    for r in elimination.solve(frame, "m", "b").collect():
        np.testing.assert_allclose(r.x, np.linalg.solve(*by_id[r[0]]), rtol=1e-7, atol=1e-9)
    for r in elimination.inv(frame, "m").collect():
        np.testing.assert_allclose(r.inverse, np.linalg.inv(by_id[r[0]][0]), rtol=1e-6, atol=1e-8)
    for r in elimination.slogdet(frame, "m").collect():
        want = np.linalg.slogdet(by_id[r[0]][0])
        assert (r.sign, r.logabsdet) == (want[0], pytest.approx(want[1]))


def test_singular_odd_and_missing(spark):
    rows = [(1, [[1.0, 2.0], [2.0, 4.0]], [1.0, 1.0]), (2, [[1.0, 2.0]], [1.0]), (3, None, [1.0]), (4, [[1.0, None], [0.0, 1.0]], [1.0, 1.0]), (5, [[2.0]], None), (6, [[0.0, 1.0], [1.0, 0.0]], [3.0, 4.0])]
    frame = spark.createDataFrame(rows, "i int, m array<array<double>>, b array<double>")
    assert {r.i: r.x for r in elimination.solve(frame, "m", "b").collect()} == {1: None, 2: None, 3: None, 4: None, 5: None, 6: [4.0, 3.0]}
    assert {r.i: r.det for r in elimination.det(frame, "m").collect()} == {1: 0.0, 2: None, 3: None, 4: None, 5: 2.0, 6: -1.0}
    assert elimination.inv(frame.limit(0), "m").count() == 0
