import numpy as np
import pytest

from tessera.functions.fourier import transform


def test_lengths_nulls_and_order(spark):
    given = [(1, [1.0, 2.0, 3.0]), (2, None), (3, [4.0]), (4, []), (5, [0.5, -1.0, 2.0]), (6, [1.0, 2.0])]
    got = {r.id: r.y for r in transform(spark.createDataFrame(given, "id int, v array<double>").coalesce(1), "fft", "v").collect()}
    for key, v in given:
        assert got[key] is None if not v else np.allclose([complex(z.re, z.im) for z in got[key]], np.fft.fft(v))


def test_complex_input_and_errors(spark):
    z = spark.createDataFrame([(1, [(1.0, 2.0), (0.0, -1.0), (3.0, 0.5)])], "id int, v array<struct<re: double, im: double>>")
    y = transform(z, "ifft", "v").first().y
    assert np.allclose([complex(c.re, c.im) for c in y], np.fft.ifft([1 + 2j, -1j, 3 + 0.5j]))
    with pytest.raises(ValueError, match="shape"):
        transform(z, "fft2", "v")
    with pytest.raises(ValueError, match="unknown"):
        transform(z, "fft", "v", norm="none")
    assert transform(z.limit(0), "fft", "v").collect() == []
