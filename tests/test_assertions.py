import pytest

from tessera.operators import assertions as A


def _frame(spark, *values):
    return spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x double")


def test_equal_with_nan_null_and_shape(spark):
    one = _frame(spark, 1.0, float("nan"), None)
    A.assert_array_equal(one, one, ["k"])
    with pytest.raises(AssertionError, match="1 positions"):
        A.assert_array_equal(one, _frame(spark, 1.0, float("nan")), ["k"])
    with pytest.raises(AssertionError, match="not equal"):
        A.assert_array_equal(one, _frame(spark, 1.0, 2.0, None), ["k"])
    A.assert_array_equal(one.limit(0), one.limit(0), ["k"])


def test_tolerances(spark):
    a, b = _frame(spark, 100.0, -2.0, 0.0), _frame(spark, 100.001, -2.0, 0.0)
    A.assert_allclose(a, b, ["k"], rtol=1e-4)
    A.assert_array_almost_equal(a, b, ["k"], 2)
    A.assert_approx_equal(a, b, ["k"], 5)
    A.assert_array_max_ulp(_frame(spark, 1.0, 0.0), _frame(spark, 1.0 + 2**-52, 0.0), ["k"], 1)
    A.assert_array_less(a, _frame(spark, 101.0, 0.0, 1.0), ["k"])
    for check in (lambda: A.assert_allclose(a, b, ["k"]), lambda: A.assert_array_almost_equal(a, b, ["k"], 4), lambda: A.assert_approx_equal(a, b, ["k"], 7), lambda: A.assert_array_max_ulp(a, b, ["k"], 5), lambda: A.assert_array_less(a, b, ["k"])):
        assert isinstance(A.assert_raises(AssertionError, check), AssertionError)


def test_plain_values():
    A.assert_string_equal("a", "a")
    with pytest.raises(AssertionError, match="not raised"):
        A.assert_raises(ValueError, lambda: None)
