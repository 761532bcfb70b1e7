import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.ufuncs import UFUNCS, float_divmod, integer_divmod
from tessera.operators.axes import i0

INF, NAN = float("inf"), float("nan")
PAIRS = [(7.0, 2.0), (-7.0, 2.0), (7.0, -2.0), (1.0, 0.1), (6.0, 0.1), (5.0, INF), (-5.0, INF), (5.0, -INF), (INF, 2.0), (NAN, 1.0), (1.0, NAN), (1.0, 0.0), (-1.0, 0.0), (1.0, -0.0), (0.0, 0.0), (0.0, -3.0), (-0.0, 3.0), (1e300, 7.0), (5e-324, 2.0), (-5e-324, 2.0), (8.0, -3.0)]


def same(a, b):
    return a == b and math.copysign(1, a) == math.copysign(1, b) or (a != a and b != b)


def test_doubles_as_numpy(spark):
    rng = np.random.default_rng(5)
    pairs = PAIRS + [(float(a), float(b)) for a, b in zip(rng.normal(scale=50, size=300), rng.normal(scale=3, size=300))] + [(k / 10, j / 10) for k in range(-20, 20) for j in (-3, 1, 7)]
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i long, x double, y double")
    q, r = float_divmod(F.col("x"), F.col("y"))
    with np.errstate(all="ignore"):
        for row in frame.select("x", "y", q.alias("q"), r.alias("r")).collect():
            want = np.divmod(np.float64(row.x), np.float64(row.y))
            want = (np.floor_divide(np.float64(row.x), np.float64(row.y)), want[1])
            assert same(row.q, want[0]) and same(row.r, want[1]), (row, want)


def test_integers(spark):
    pairs = [(7, 2), (-7, 2), (8, -3), (7, -2), (7, 0), (0, 5), (-(2**62), 3), (2**62 + 1, -7)]
    q, r = integer_divmod(F.col("x"), F.col("y"))
    for row in spark.createDataFrame(pairs, "x long, y long").select("x", "y", q.alias("q"), r.alias("r")).collect():
        assert (row.q, row.r) == ((row.x // row.y, row.x % row.y) if row.y else (0, 0))


def test_null_stays_null(spark):
    frame = spark.createDataFrame([(None, 1.0), (1.0, None)], "x double, y double")
    made = [UFUNCS[n](F.col("x"), F.col("y")).alias(n) for n in ("floor_divide", "mod", "floor_divide_integer", "mod_integer")]
    assert all(v is None for row in frame.select(*made).collect() for v in row)


def test_i0_up_to_the_last_double(spark):
    values = [0.0, 1e-9, 0.5, 3.75, -3.75, 8.0, 20.0, 60.0, 100.0, 300.0, -690.0]
    got = spark.createDataFrame([(v,) for v in values], "x double").select(i0(F.col("x")).alias("y")).collect()
    for v, row in zip(values, got):
        assert row.y == pytest.approx(float(np.i0(v)), rel=1e-12)
