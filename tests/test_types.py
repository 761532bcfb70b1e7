import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import apply, types
from tessera.sources import text

NAMES = [n for n in types.DTYPES if n != "str"]


def test_casts_and_promotion_as_arrays_do():
    for a, b in itertools.product(NAMES, NAMES):
        for casting in ("no", "safe", "same_kind", "unsafe"):
            assert types.can_cast(a, b, casting) == np.can_cast(a, b, casting), (a, b, casting)
        if "complex128" not in (a, b):
            assert types.result_type(a, b) == np.result_type(a, b).name, (a, b)


@pytest.mark.parametrize("value", [True, 0, 255, 256, 70_000, 2**32, 2**64 - 1, -1, -128, -129, -(2**31), -(2**63)])
def test_least_types(value):
    assert types.min_scalar_type(value) == np.min_scalar_type(value).name


def test_kinds():
    assert types.issubdtype("int8", "integer") and not types.issubdtype("bool", "number") and types.issubdtype("float32", "float32")
    assert types.isdtype("uint8", ("bool", "integral")) and not types.isdtype("float64", "integral")
    assert types.common_type("int8", "float32") == "float64" and types.common_type("float32") == "float32"
    with pytest.raises(OverflowError):
        types.min_scalar_type(2**64)


def test_matches_of_a_pattern(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1312 foo 1534 bar\nnone\n444 qux\n")
    rows = text.fromregex(spark, str(tmp_path), r"(\d+)\s+(...)", [("num", "bigint"), ("key", "string")]).collect()
    assert sorted(map(tuple, rows)) == [(444, "qux"), (1312, "foo"), (1534, "bar")]


def test_own_functions_with_nulls_and_nothing(spark):
    frame = spark.createDataFrame([(1, 2.0), (None, 3.0), (4, None)], "a long, b double")
    add = apply.vectorize(lambda a, b: a + b)
    assert [r.y for r in frame.select(add("a", "b").alias("y")).collect()] == [3.0, None, None]
    assert [r.y for r in frame.select(apply.vectorize(lambda a: a * 2, "bigint")("a").alias("y")).collect()] == [2, None, 8]
    assert frame.limit(0).select(add("a", "b").alias("y")).collect() == []
    with pytest.raises(TypeError):
        apply.frompyfunc(len, 1)(F.col("a"), F.col("b"))
    assert apply.apply_along_axis(frame.limit(0).withColumn("k", F.lit(1)), np.cumsum, ["k"], "a", "b").collect() == []
