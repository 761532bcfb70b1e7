import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import dense, poly, strings
from tessera.functions.types import DTYPES, can_cast, promote, wrap
from tessera.functions.ufuncs import UFUNCS
from tessera.operators import reduce, window
from tessera.sources import text
from tessera.sources.npy import read_npy, write_npy

NUMERIC = [n for n in DTYPES if n != "str"]
EDGE = [float("nan"), 1.0, -0.0, 0.0, float("nan"), 3.0, math.inf, -math.inf]


@pytest.mark.parametrize("a", NUMERIC)
def test_promotion_is_numpy_s(a):
    for b in NUMERIC:
        assert promote(a, b) == np.promote_types(a, b).name
        assert can_cast(a, b) == np.can_cast(a, b)


def test_wrap(spark):
    values = [-129, -1, 0, 127, 128, 255, 256, 70000]
    frame = spark.createDataFrame([(v,) for v in values], "x bigint")
    for kind in ("int8", "uint8", "int16", "uint16", "int32", "uint32"):
        got = [r[0] for r in frame.select(wrap(F.col("x"), kind)).collect()]
        assert got == np.array(values).astype(kind).tolist()


@pytest.mark.parametrize("name", ["sqrt", "log", "log2", "log1p", "exp", "sign", "isnan", "isinf", "isfinite", "reciprocal", "nan_to_num", "trunc"])
def test_edges(spark, name):
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(EDGE)], "pos int, x double")
    got = [r[1] for r in frame.select("pos", UFUNCS[name](F.col("x"))).orderBy("pos").collect()]
    with np.errstate(all="ignore"):
        want = getattr(np, name)(np.array(EDGE))
    if name in ("nan_to_num", "trunc", "reciprocal"):  # infinities: kept, saturated, and the sign of a zero, as documented
        got, want = got[1:2] + got[5:6], want[[1, 5]]
    assert np.allclose(np.array(got, dtype=float), np.array(want, dtype=float), equal_nan=True)


def test_reductions_of_edges(spark):
    frame = spark.createDataFrame([(x,) for x in EDGE], "x double")
    one = lambda n, f=frame: reduce.reduce_axis(f, n, "x", out="y").first().y
    assert math.isnan(one("min")) and math.isnan(one("max")) and one("nanmin") == -math.inf and one("nanmax") == math.inf
    empty = frame.limit(0)
    assert one("sum", empty) == 0 and one("prod", empty) == 1 and math.isnan(one("mean", empty)) and one("all", empty) is True and one("any", empty) is False


@pytest.mark.parametrize("method", reduce.METHODS)
def test_quantiles_are_numpy_s(spark, method):
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 40):
        x = rng.normal(size=n)
        frame = spark.createDataFrame([(float(v),) for v in x], "x double")
        for q in (0.0, 0.25, 0.6, 1.0):
            assert reduce.quantile(frame, "x", q, method=method, out="y").first().y == pytest.approx(np.quantile(x, q, method=method))


def test_strings_are_python_s(spark):
    values = ["", "abc", "Hello World", "  tab\there ", "ÉCOLE straße", "x1y2", "a\nb\r\nc", "-42", "ΑΣ αβ"]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    for make, want in [
        (strings.upper, str.upper), (strings.swapcase, None), (lambda s: strings.center(s, 9, "*"), lambda s: s.center(9, "*")), (lambda s: strings.zfill(s, 6), lambda s: s.zfill(6)),
        (lambda s: strings.rfind(s, "b"), lambda s: s.rfind("b")), (lambda s: strings.partition(s, "l"), lambda s: list(s.partition("l"))), (lambda s: strings.rpartition(s, "l"), lambda s: list(s.rpartition("l"))),
        (lambda s: strings.expandtabs(s, 4), lambda s: s.expandtabs(4)), (lambda s: strings.split(s), str.split), (strings.isalpha, str.isalpha), (strings.isdigit, str.isdigit), (strings.strip, str.strip),
        (strings.splitlines, None),
    ]:
        got = [r[0] for r in frame.orderBy("i").select(make(F.col("s"))).collect()]
        if want:
            assert got == [want(v) for v in values]


def test_dense_kernels(spark):
    rng = np.random.default_rng(2)
    spd = [(lambda m: m @ m.T + np.eye(3))(rng.normal(size=(3, 3))) for _ in range(5)]
    frame = spark.createDataFrame([(i, m.ravel().tolist()) for i, m in enumerate(spd)] + [(9, None)], "i int, v array<double>")
    for name, want in (("det", np.linalg.det), ("inv", lambda m: np.linalg.inv(m).ravel()), ("eigvalsh", np.linalg.eigvalsh), ("cholesky", lambda m: np.linalg.cholesky(m).ravel()), ("fftshift", lambda m: np.fft.fftshift(m.ravel()))):
        got = {r.i: r.y for r in dense.kernel(frame, name, "v").collect()}
        assert got.pop(9) is None
        assert all(np.allclose(got[i], want(m)) for i, m in enumerate(spd))
    got = dense.kernel(frame.filter("i = 0"), "fft", "v").first().y
    assert np.allclose([complex(z.re, z.im) for z in got], np.fft.fft(spd[0].ravel()))
    drawn = [r.y for r in dense.random_rows(frame, "i", "normal", 7).orderBy("i").collect()]
    assert drawn[1] == np.random.default_rng([7, 1]).normal()


def test_polynomials(spark):
    frame = spark.createDataFrame([([1.0, 2.0, 3.0], [4.0, 5.0])], "a array<double>, b array<double>")
    row = frame.select(poly.polymul(F.col("a"), F.col("b")).alias("m"), poly.polyadd(F.col("a"), F.col("b")).alias("s"), poly.polyder(F.col("a")).alias("d"), poly.polyint(F.col("a")).alias("i")).first()
    P = np.polynomial.polynomial
    assert np.allclose(row.m, P.polymul([1, 2, 3], [4, 5])) and np.allclose(row.s, [5, 7, 3]) and np.allclose(row.d, [2, 6]) and np.allclose(row.i, P.polyint([1, 2, 3]))


def test_sources(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.asfortranarray(np.arange(12.0).reshape(3, 4)))
    np.savez(tmp_path / "b.npz", x=np.array([1 + 2j]), y=np.arange(3, dtype=np.int8))
    got = read_npy(spark, f"file://{tmp_path}").collect()
    assert [r.value for r in sorted(got, key=lambda r: r.pos) if r.file.endswith("a.npy")] == list(range(12))
    assert {(r.name, r.pos): (r.value, r.imag) for r in got if r.file.endswith("b.npz")} == {("x", 0): (1.0, 2.0), ("y", 0): (0.0, 0.0), ("y", 1): (1.0, 0.0), ("y", 2): (2.0, 0.0)}
    write_npy(spark.range(5).coalesce(1), f"file://{tmp_path}/out", "id")
    assert sorted(r.value for r in read_npy(spark, f"file://{tmp_path}/out").collect()) == [0, 1, 2, 3, 4]
    (tmp_path / "t.txt").write_text("1 2 # note\n\n3 4\n")
    assert [list(r.v) for r in text.load_text(spark, f"file://{tmp_path}/t.txt").collect()] == [[1.0, 2.0], [3.0, 4.0]]
    assert [r.x for r in text.linspace(spark, 0, 1, 5).orderBy("pos").collect()] == np.linspace(0, 1, 5).tolist()
    assert [r.x for r in text.arange(spark, 0, 1, 0.3).orderBy("pos").collect()] == pytest.approx(np.arange(0, 1, 0.3).tolist())


def test_positions_over_ranges(spark):
    frame = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("x")).repartition(5)
    assert all(r.x == r.pos for r in window.with_positions(frame, ["x"]).collect())


def test_least_squares(spark):
    from tessera.operators.regression import lstsq, polyfit

    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3))
    y = x @ [1.0, -2.0, 0.5] + rng.normal(size=200) * 0.01
    frame = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, y double")
    assert np.allclose(lstsq(frame, ["a", "b", "c"], "y"), np.linalg.lstsq(x, y, rcond=None)[0])
    assert np.allclose(polyfit(frame, "a", "y", 2), np.polynomial.polynomial.polyfit(x[:, 0], y, 2))


def test_limits():
    from tessera.functions.signal import finfo, iinfo

    for kind in ("int8", "uint16", "int64", "uint64"):
        assert (iinfo(kind)["min"], iinfo(kind)["max"], iinfo(kind)["bits"]) == (np.iinfo(kind).min, np.iinfo(kind).max, np.iinfo(kind).bits)
    for kind in ("float32", "float64"):
        assert finfo(kind)["eps"] == np.finfo(kind).eps and finfo(kind)["max"] == np.finfo(kind).max and finfo(kind)["tiny"] == np.finfo(kind).tiny
