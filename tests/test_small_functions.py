import numpy as np
from pyspark.sql import functions as F

from tessera.operators import axes


def test_cross_as_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [([float(x) for x in rng.normal(size=n)], [float(x) for x in rng.normal(size=n)]) for n in (3, 3, 2)]
    for r in spark.createDataFrame(rows, "a array<double>, b array<double>").select("a", "b", axes.cross(F.col("a"), F.col("b")).alias("y")).collect():
        want = np.cross(r.a, r.b) if len(r.a) == 3 else [r.a[0] * r.b[1] - r.a[1] * r.b[0]]
        np.testing.assert_allclose(r.y, want)
    odd = spark.createDataFrame([([1.0], [2.0]), (None, [1.0, 2.0])], "a array<double>, b array<double>")
    assert [r.y for r in odd.select(axes.cross(F.col("a"), F.col("b")).alias("y")).collect()] == [None, None]


def test_ediff1d_as_numpy(spark):
    x = [3.0, 7.0, 1.0, 1.0, 9.5]
    frame = spark.createDataFrame(list(enumerate(x)), "i long, x double").repartition(3)
    for begin, end in (([], []), ([0.5], [8.0, 9.0])):
        got = [r.x for r in axes.ediff1d(frame, ["i"], "x", begin, end).orderBy("pos").collect()]
        assert got == np.ediff1d(x, end or None, begin or None).tolist()
    assert axes.ediff1d(frame.limit(0), ["i"], "x").count() == 0
    assert [r.x for r in axes.ediff1d(frame.filter("i = 0"), ["i"], "x", [1.0], [2.0]).orderBy("pos").collect()] == [1.0, 2.0]


def test_sort_complex_as_numpy(spark):
    z = [2 + 1j, 1 - 3j, 2 - 1j, 1 + 0j, -4 + 0j]
    frame = spark.createDataFrame([((v.real, v.imag),) for v in z], "z struct<re:double,im:double>")
    assert [complex(r.z.re, r.z.im) for r in axes.sort_complex(frame, "z").orderBy("pos").collect()] == np.sort_complex(z).tolist()


def test_vander_as_numpy(spark):
    frame = spark.createDataFrame([(v,) for v in (0.0, -1.5, 2.0)], "x double")
    for increasing in (False, True):
        got = [r.v for r in frame.select(axes.vander(F.col("x"), 4, increasing).alias("v")).collect()]
        np.testing.assert_allclose(got, np.vander([0.0, -1.5, 2.0], 4, increasing))
