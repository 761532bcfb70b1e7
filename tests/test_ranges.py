import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import reduce, select, sets, window
from tessera.operators.ranges import bounds_of, range_of


def _hot(spark, n=9000):
    """A third of all rows is one number."""
    return spark.range(n).select("id", F.when(F.col("id") % 3 == 0, 50.0).otherwise((F.col("id") * 7919) % 1000 / 10.0).alias("x"), (F.col("id") % 2).alias("g"))


def test_ranges_cover_all_numbers(spark):
    frame = _hot(spark)
    bounds = bounds_of(frame, "x", 8)
    assert bounds == sorted(set(bounds)) and len(bounds) <= 7
    got = {r.x: r.r for r in frame.select("x", range_of(F.col("x"), bounds).alias("r")).distinct().collect()}
    assert got == {x: sum(b <= x for b in bounds) for x in got}


@pytest.mark.parametrize("method", ["linear", "hazen", "lower", "higher", "nearest", "midpoint", "inverted_cdf", "weibull"])
def test_quantiles_of_hot_numbers(spark, method):
    frame = _hot(spark)
    x = np.array([r.x for r in frame.collect()])
    for q in (0.0, 0.31, 0.5, 1.0):
        assert reduce.quantile(frame, "x", q, method=method).first()[0] == pytest.approx(np.quantile(x, q, method=method))
    groups = {g: x[[r.g == g for r in frame.select("g").collect()]] for g in (0, 1)}
    got = {r.g: r.q for r in reduce.quantile(frame, "x", 0.8, ["g"], method, "q").collect()}
    assert got == {g: pytest.approx(np.quantile(v, 0.8, method=method)) for g, v in groups.items()}


def test_quantiles_of_little(spark):
    few = spark.createDataFrame([(1, None), (2, 4.0), (2, float("nan")), (3, 7.0)], "g int, x double")
    got = {r.g: r.q for r in reduce.quantile(few, "x", 0.5, ["g"], out="q").collect()}
    assert set(got) == {2, 3} and np.isnan(got[2]) and got[3] == 7.0
    assert {r.g: r.q for r in reduce.quantile(few, "x", 0.5, ["g"], out="q", nan=False).collect()} == {2: 4.0, 3: 7.0}
    assert reduce.quantile(few.limit(0), "x", 0.5, ["g"]).collect() == []


def test_interpolation_like_a_loop(spark):
    known = spark.range(400).select((F.col("id") * 3.7 % 211).alias("xp"), F.sin("id").alias("fp"))
    points = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 17.5).otherwise(F.col("id") * 0.1 - 20).alias("x"))
    rows = sorted((r.xp, r.fp) for r in known.groupBy("xp").agg(F.max("fp").alias("fp")).collect())
    got = {r.id: (r.x, r.y) for r in window.interpolate(points, known, "x", "xp", "fp").collect()}
    xs = np.array([got[k][0] for k in range(3000)])
    assert np.allclose([got[k][1] for k in range(3000)], np.interp(xs, *zip(*rows)))
    ended = {r.id: r.y for r in window.interpolate(points, known, "x", "xp", "fp", left=-9.0, right=9.0).collect()}
    assert np.allclose([ended[k] for k in range(3000)], np.interp(xs, *zip(*rows), left=-9.0, right=9.0))


def test_interpolation_without_points_or_samples(spark):
    known = spark.createDataFrame([(1.0, 2.0), (None, 3.0)], "xp double, fp double")
    points = spark.createDataFrame([(1, None), (2, 5.0), (2, 5.0)], "k int, x double")
    assert sorted(map(tuple, window.interpolate(points, known, "x", "xp", "fp").collect()), key=str) == [(1, None, None), (2, 5.0, 2.0), (2, 5.0, 2.0)]
    assert {r.y for r in window.interpolate(points, known.limit(0), "x", "xp", "fp").collect()} == {None}
    assert window.interpolate(points.limit(0), known, "x", "xp", "fp").collect() == []


@pytest.mark.parametrize("mode", select.PAD_MODES)
@pytest.mark.parametrize("size", [1, 2, 7])
def test_padding(spark, mode, size):
    vector = spark.range(size).select(F.col("id").alias("pos"), (F.col("id") * F.col("id") + 1.0).alias("x"))
    got = {r.pos: r.x for r in select.pad_mode(vector, "pos", "x", 3, 4, mode).collect()}
    assert sorted(got) == list(range(size + 7))
    if mode != "empty":
        assert np.allclose([got[k] for k in range(size + 7)], np.pad(np.arange(size) ** 2 + 1.0, (3, 4), mode))


@pytest.mark.parametrize("mode", ["full", "same", "valid"])
@pytest.mark.parametrize("size", [2, 3, 9])
def test_convolution_modes(spark, mode, size):
    vector = spark.range(size).select(F.col("id").alias("pos"), (F.col("id") + 1.0).alias("x"))
    for weights in ([2.0, -1.0], [1.0, 0.5, 3.0]):
        if mode == "valid" and len(weights) > size:
            continue
        got = {r.pos: r.y for r in window.slide(vector, "pos", "x", weights, mode).collect()}
        assert np.allclose([got[k] for k in sorted(got)], np.convolve(np.arange(size) + 1.0, weights, mode))
        got = {r.pos: r.y for r in window.slide(vector, "pos", "x", weights, mode, flipped=False).collect()}
        if len(weights) <= size:
            assert np.allclose([got[k] for k in sorted(got)], np.correlate(np.arange(size) + 1.0, weights, mode))


@pytest.mark.parametrize("bins", ["sqrt", "sturges", "rice", "scott", "doane", "fd"])
def test_bin_edges(spark, bins):
    frame = spark.range(500).select((F.pow(F.col("id") / 50.0, F.lit(1.7))).alias("x"))
    x = np.array([r.x for r in frame.collect()])
    assert np.allclose(reduce.histogram_bin_edges(frame, "x", bins), np.histogram_bin_edges(x, bins))
    assert reduce.histogram_bin_edges(frame.limit(0), "x", bins) == [0.0, 1.0]


def test_unique_all(spark):
    rows = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b")], "pos int, x string")
    assert sorted(map(tuple, sets.unique_all(rows, "x", "pos").select("value", "counts", "index", "inverse").collect())) == [("a", 1, 1, 0), ("b", 2, 0, 1)]
