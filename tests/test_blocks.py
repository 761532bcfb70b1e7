import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import blocks, tensor


def rows(spark, array, parts=3):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(array)], "i long, v array<double>").repartition(parts)


def dense(b):
    out = np.zeros(b.shape)
    for r in blocks.to_coordinates(b).collect():
        out[r.i, r.j] = r.x
    return out


@pytest.mark.parametrize("shape", [(5, 7, 3), (16, 16, 16), (33, 40, 17), (1, 50, 1)])
def test_products_of_any_shape(spark, shape):
    rng = np.random.default_rng(sum(shape))
    a, b = rng.normal(size=shape[:2]), rng.normal(size=shape[1:])
    left, right = blocks.from_rows(rows(spark, a), "i", "v", a.shape, 16), blocks.from_rows(rows(spark, b), "i", "v", b.shape, 16)
    np.testing.assert_allclose(dense(blocks.matmul(left, right)), a @ b, atol=1e-12)
    np.testing.assert_allclose(dense(left.T), a.T)


def test_product_moves_blocks_and_not_cells(spark):
    frame = spark.range(512).select(F.col("id").alias("i"), F.transform(F.sequence(F.lit(0), F.lit(767)), lambda j: F.sin(F.col("id") * j)).alias("v"))
    other = spark.range(768).select(F.col("id").alias("i"), F.transform(F.sequence(F.lit(0), F.lit(383)), lambda j: F.cos(F.col("id") + j)).alias("v"))
    made = blocks.matmul(blocks.from_rows(frame, "i", "v", (512, 768), 128), blocks.from_rows(other, "i", "v", (768, 384), 128))
    assert made.frame.count() == 12
    got = dense(made)
    want = np.sin(np.outer(np.arange(512), np.arange(768))) @ np.cos(np.add.outer(np.arange(768), np.arange(384)))
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_missing_rows_and_misfits(spark):
    sparse = blocks.from_rows(spark.createDataFrame([(3, [1.0, None]), (9, [2.0, 5.0])], "i long, v array<double>"), "i", "v", (10, 2), 4)
    want = np.zeros((10, 2))
    want[3], want[9] = [1, 0], [2, 5]
    np.testing.assert_array_equal(dense(sparse), want)
    with pytest.raises(ValueError):
        blocks.matmul(sparse, sparse)


@pytest.mark.parametrize("shape", [(4, 4), (50, 6), (3, 5), (1, 1)])
def test_triangle(shape):
    a = np.random.default_rng(3).normal(size=shape)
    r = blocks.triangle(a)
    assert r.shape == (shape[1], shape[1]) and np.allclose(r, np.triu(r)) and (np.diag(r) >= 0).all()
    np.testing.assert_allclose(r.T @ r, a.T @ a, atol=1e-12)


def test_tall_r_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(blocks, "FAN", 2)
    a = np.random.default_rng(4).normal(size=(300, 5))
    want = np.linalg.qr(a)[1]
    np.testing.assert_allclose(blocks.tall_r(rows(spark, a, 9), "v"), want * np.sign(np.diag(want))[:, None], atol=1e-10)
    assert blocks.tall_r(rows(spark, a[:0]), "v") is None
    with_null = rows(spark, a).union(spark.createDataFrame([(1, None), (2, [None] * 5)], "i long, v array<double>"))
    np.testing.assert_allclose(blocks.tall_r(with_null, "v"), want * np.sign(np.diag(want))[:, None], atol=1e-10)


def test_ill_conditioned_polynomial(spark):
    x = np.linspace(0, 1, 4000)
    c = np.arange(13) % 5 - 2.0
    frame = spark.createDataFrame([(float(v), float(np.polyval(c[::-1], v))) for v in x], "x double, y double").withColumn("v", F.array(*[F.pow("x", F.lit(k)) for k in range(13)]))
    solution, residual, rank, s = blocks.least_squares(frame, "v", "y")
    np.testing.assert_allclose(solution, c, atol=1e-6)
    assert rank == 13 and residual < 1e-20 and s[0] / s[-1] > 1e8


def test_rank_deficient_is_of_least_norm(spark):
    rng = np.random.default_rng(6)
    a = rng.normal(size=(60, 3))
    a = np.hstack([a, a[:, :1] + a[:, 1:2]])
    y = rng.normal(size=60)
    frame = spark.createDataFrame([([float(v) for v in r], float(t)) for r, t in zip(a, y)], "v array<double>, y double")
    solution, residual, rank, _ = blocks.least_squares(frame, "v", "y")
    want = np.linalg.lstsq(a, y, rcond=None)
    np.testing.assert_allclose(solution, want[0], atol=1e-9)
    assert rank == 3 and residual == pytest.approx(((a @ want[0] - y) ** 2).sum())


def test_rows_of_q(spark):
    a = np.random.default_rng(8).normal(size=(80, 4))
    frame = rows(spark, a).withColumnRenamed("i", "the.id")
    q = np.array([r.q for r in sorted(blocks.tall_q(frame, "v", blocks.tall_r(frame, "v")).collect(), key=lambda r: r["the.id"])])
    np.testing.assert_allclose(q.T @ q, np.eye(4), atol=1e-12)


def test_order_of_a_chain():
    sizes = {"a": 1000, "b": 2, "c": 1000, "d": 3, "e": 1000}
    path, products = blocks.contraction_path(["ab", "bc", "cd", "de"], "ae", sizes)
    assert path[0] == (1, 2) and products == 2 * 1000 * 3 + 1000 * 2 * 3 + 1000 * 3 * 1000 or products == 2 * 1000 * 3 + 2 * 3 * 1000 + 1000 * 2 * 1000


def test_einsum_with_an_order_and_an_ellipsis(spark):
    rng = np.random.default_rng(9)
    arrays = [rng.normal(size=s) for s in ((3, 4), (4, 5), (5, 2), (2, 3))]
    frames = [(spark.createDataFrame([(int(i), int(j), float(v)) for (i, j), v in np.ndenumerate(a)], "p long, q long, x double"), ["p", "q"], "x") for a in arrays]
    out = np.zeros((3, 3))
    for r in tensor.einsum("ij,jk,kl,lm->im", *frames, optimize=True).collect():
        out[r.i, r.m] = r.x
    np.testing.assert_allclose(out, np.linalg.multi_dot(arrays), atol=1e-12)
    assert tensor.expanded("...ij,...jk->...ik", [3, 2]) == "Aij,jk->Aik" and tensor.expanded("i...,i...", [3, 2]) == "iAB,iB->AB"
    cube = rng.normal(size=(2, 3, 4))
    frame = (spark.createDataFrame([(*map(int, i), float(v)) for i, v in np.ndenumerate(cube)], "a long, b long, c long, x double"), ["a", "b", "c"], "x")
    for axes, other, at in ((1, arrays[1], 1), (([1], [0]), arrays[0], 0), (([1, 2], [0, 1]), arrays[0], 0)):
        want = np.tensordot(cube, other, axes)
        got = np.zeros(want.shape)
        for r in tensor.tensordot(frame, frames[at], axes).collect():
            got[tuple(r[:-1])] = r.x
        np.testing.assert_allclose(got, want, atol=1e-12)
