import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm.whitening import fit_whitening, whiten
from tessera.llm.whitening_query import op13_whitening

SCHEMA = "vec_id long, embedding array<float>, x string, deviation string, c0 int"


def usable(vector, d=None):
    return vector is not None and len(vector) > 0 and all(v is not None and math.isfinite(v) for v in vector) and (d is None or len(vector) == d)


def brute(rows, d, components=16):
    """Everything in numpy at once: (vec_id, component) -> deviation, |whitened|, explained."""
    x = {i: tuple(math.floor(64 * float(v)) + 1_000_000 for v in e) for i, e in rows}
    fit = np.array(sorted(set(x.values())), dtype=np.int64)
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    centred = fit - np.array(sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    found = {}
    for i, v in x.items():
        deviation = sum((n * a - s) ** 2 for a, s in zip(v, sums))
        at = np.array([float(Fraction(a) - Fraction(s, n)) for a, s in zip(v, sums)])
        for k in range(min(components, d)):
            found[i, k + 1] = (deviation, abs(at @ vectors[:, k]) / math.sqrt(values[k]), values[k] / values.sum())
    return n, found


def test_whole_table_against_numpy(spark, sf_dir):
    given = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    n, want = brute([r for r in given if usable(r[1])], 64)
    got = op13_whitening(spark, sf_dir).toPandas()
    assert len(got) == len(want) and set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error.iloc[0] <= 1e-9
    for r in got.itertuples():
        deviation, whitened, explained = want[r.vec_id, r.component]
        assert r.deviation == deviation
        assert abs(r.whitened) == pytest.approx(whitened, rel=1e-6, abs=1e-6)
        assert r.explained == pytest.approx(explained, rel=1e-9)


def test_one_sign_for_all_rows(spark, sf_dir):
    got = op13_whitening(spark, sf_dir).groupBy("component").agg(F.avg("whitened").alias("mean"), F.stddev_pop("whitened").alias("s")).collect()
    assert len(got) == 16 and all(abs(r.s - 1) < 0.2 and abs(r["mean"]) < 0.2 for r in got)


def test_what_takes_no_part(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(v) for v in rng.normal(size=5)], "x", "d", 1) for i in range(40)]
    odd = [None, [], [1.0, None, 0.0, 0.0, 0.0], [float("nan")] * 5, [float("inf"), 0.0, 0.0, 0.0, 0.0], [1.0, 2.0]]
    again = [(100, good[0][1], None, None, None), (None, good[1][1], None, None, None), *[(101, good[2][1], "x", "d", 1)] * 3]
    frame = spark.createDataFrame(good + [(200 + i, o, None, None, None) for i, o in enumerate(odd)] + again, SCHEMA)
    got = whiten(frame).toPandas()
    assert len(got) == 5 * 45 and set(got.n) == {40} and set(got.component) == {1, 2, 3, 4, 5}
    _, want = brute([(r[0], [float(np.float32(v)) for v in r[1]]) for r in good], 5)
    for r in got[got.vec_id < 40].itertuples():
        assert (r.deviation, abs(r.whitened)) == (want[r.vec_id, r.component][0], pytest.approx(want[r.vec_id, r.component][1], rel=1e-9, abs=1e-9))
    assert set(got[got.vec_id == 101].deviation) == set(got[got.vec_id == 2].deviation)


def test_flat_directions(spark):
    frame = spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(30)], "vec_id long, embedding array<double>")
    got = whiten(frame).toPandas()
    assert got[got.component > 1].whitened.isna().all() and got[got.component == 1].whitened.notna().all()
    assert got.explained.max() == pytest.approx(1) and got.identity_error.iloc[0] < 1e-9
    one = whiten(frame.filter("vec_id = 3")).toPandas()
    assert one.whitened.isna().all() and one.identity_error.isna().all() and set(one.deviation) == {0}


def test_empty_and_large_entries(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert whiten(frame).count() == 0 and whiten(frame).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    large = spark.createDataFrame([(i, [i * 1e9, -i * 3e8]) for i in range(5)], "vec_id long, embedding array<double>")
    x = [(64 * i * 10**9 + 10**6, -64 * i * 3 * 10**8 + 10**6) for i in range(5)]
    sums = [sum(v) for v in zip(*x)]
    want = {i: sum((5 * a - s) ** 2 for a, s in zip(v, sums)) for i, v in enumerate(x)}
    got = {r.vec_id: r.deviation for r in whiten(large).collect()}
    assert got == {i: v if v < 1 << 63 else None for i, v in want.items()}


def test_components_do_not_depend_on_partitions(spark, sf_dir):
    fit = spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("transform(embedding, c -> floor(64 * double(c))) AS x").distinct()
    a, b = fit_whitening(fit.repartition(1)), fit_whitening(fit.repartition(7))
    np.testing.assert_allclose(a.eigenvalues, b.eigenvalues, rtol=1e-10)
    assert (np.abs((a.axes[:4] * b.axes[:4]).sum(axis=1)) > 1 - 1e-9).all()
