import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import spectra


def vector(spark, z):
    return spark.createDataFrame([(i, float(v.real), float(v.imag)) for i, v in enumerate(z)], "pos long, a double, b double").repartition(3)


def dense(frame, n):
    out = np.full(n, np.nan, dtype=complex)
    for r in frame.collect():
        assert np.isnan(out[r.pos])
        out[r.pos] = complex(r.re, r.im)
    return out


@pytest.mark.parametrize("n", [1, 2, 7, 12, 60, 97, 128, 1000])
def test_as_numpy(spark, n):
    rng = np.random.default_rng(n)
    z = rng.normal(size=n) + 1j * rng.normal(size=n)
    v = vector(spark, z)
    np.testing.assert_allclose(dense(spectra.transform(v, F.col("a"), F.col("b")), n), np.fft.fft(z), atol=1e-10)
    np.testing.assert_allclose(dense(spectra.transform(v, F.col("a"), F.col("b"), inverse=True, norm="ortho"), n), np.fft.ifft(z, norm="ortho"), atol=1e-10)


@pytest.mark.parametrize("n", [5003, 2 * 2503])
def test_lengths_without_a_good_divisor(spark, n):
    z = np.random.default_rng(n).normal(size=n) + 0j
    np.testing.assert_allclose(dense(spectra.transform(vector(spark, z), F.col("a")), n), np.fft.fft(z), atol=1e-8)


def test_cut_filled_up_and_sparse(spark):
    z = np.arange(10) + 0j
    v = vector(spark, z)
    for n in (6, 16):
        np.testing.assert_allclose(dense(spectra.transform(v, F.col("a"), n=n), n), np.fft.fft(z.real, n), atol=1e-10)
    z[3] = 0
    np.testing.assert_allclose(dense(spectra.transform(v.filter("pos <> 3"), F.col("a")), 10), np.fft.fft(z), atol=1e-10)
    assert spectra.transform(v.limit(0), F.col("a")).count() == 0


@pytest.mark.parametrize("n", [8, 15])
def test_real_halves(spark, n):
    x = np.random.default_rng(n).normal(size=n)
    half = spectra.rfft(vector(spark, x + 0j), F.col("a"))
    np.testing.assert_allclose(dense(half, n // 2 + 1), np.fft.rfft(x), atol=1e-12)
    back = {r.pos: r.x for r in spectra.irfft(half, n).collect()}
    np.testing.assert_allclose([back[i] for i in range(n)], x, atol=1e-12)
