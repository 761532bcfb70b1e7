"""Comparisons of two arrays that raise: both are joined by position, and only counts and a few examples leave the tasks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_Agrees = Callable[[Column, Column], Column]
EXAMPLES = 5


def equal(a: Column, b: Column) -> Column:
    """NULL is equal to NULL, and NaN to NaN, as Spark compares them."""
    return a.eqNullSafe(b)


def close(rtol: float = 1e-7, atol: float = 0.0) -> _Agrees:
    return lambda a, b: equal(a, b) | (F.abs(a - b) <= atol + rtol * F.abs(b))


def almost(decimal: int = 6) -> _Agrees:
    return lambda a, b: equal(a, b) | (F.abs(a - b) < 1.5 * 10.0**-decimal)


def approx(significant: int = 7) -> _Agrees:
    """Both over the power of ten of their mean magnitude differ by less than one in the last significant digit."""

    def agrees(a: Column, b: Column) -> Column:
        mean = (F.abs(a) + F.abs(b)) / 2
        scale = F.pow(F.lit(10.0), F.floor(F.log10(mean)))
        return equal(a, b) | (F.abs(a / scale - b / scale) < 10.0 ** -(significant - 1))

    return agrees


def less(a: Column, b: Column) -> Column:
    return a < b


def within_units(units: float = 1.0) -> _Agrees:
    """At most so many units in the last place of the larger one apart."""

    def agrees(a: Column, b: Column) -> Column:
        largest = F.greatest(F.abs(a), F.abs(b))
        unit = F.greatest(F.pow(F.lit(2.0), F.floor(F.log2(largest)) - 52), F.lit(5e-324))
        return equal(a, b) | (F.abs(a - b) <= units * unit)

    return agrees


def mismatches(a: DataFrame, b: DataFrame, keys: Sequence[str], agrees: _Agrees = equal, value: str = "x") -> DataFrame:
    """(keys, a, b) of the positions of which just one side has one, or where ``agrees`` isn't true."""
    left = a.select(*keys, F.col(value).alias("a"), F.lit(True).alias("__in_a"))
    right = b.select(*keys, F.col(value).alias("b"), F.lit(True).alias("__in_b"))
    both = left.join(right, list(keys), "full")
    wrong = F.col("__in_a").isNull() | F.col("__in_b").isNull() | ~F.coalesce(agrees(F.col("a"), F.col("b")), F.lit(False))
    return both.filter(wrong).select(*keys, "a", "b")


def _raise_if(wrong: DataFrame, what: str) -> None:
    examples = wrong.limit(EXAMPLES).collect()
    if examples:
        raise AssertionError(f"{what}: {wrong.count()} positions, such as {[tuple(r) for r in examples]}")


def assert_array_equal(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str = "x") -> None:
    _raise_if(mismatches(a, b, keys, equal, value), "not equal")


def assert_allclose(a: DataFrame, b: DataFrame, keys: Sequence[str], rtol: float = 1e-7, atol: float = 0.0, value: str = "x") -> None:
    _raise_if(mismatches(a, b, keys, close(rtol, atol), value), f"not close (rtol {rtol}, atol {atol})")


def assert_array_almost_equal(a: DataFrame, b: DataFrame, keys: Sequence[str], decimal: int = 6, value: str = "x") -> None:
    _raise_if(mismatches(a, b, keys, almost(decimal), value), f"not equal to {decimal} decimals")


def assert_approx_equal(a: DataFrame, b: DataFrame, keys: Sequence[str], significant: int = 7, value: str = "x") -> None:
    _raise_if(mismatches(a, b, keys, approx(significant), value), f"not equal to {significant} digits")


def assert_array_less(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str = "x") -> None:
    _raise_if(mismatches(a, b, keys, less, value), "not less")


def assert_array_max_ulp(a: DataFrame, b: DataFrame, keys: Sequence[str], units: float = 1.0, value: str = "x") -> None:
    _raise_if(mismatches(a, b, keys, within_units(units), value), f"more than {units} units apart")


def assert_string_equal(a: str, b: str) -> None:
    if a != b:
        raise AssertionError(f"{a!r} is not {b!r}")


def assert_raises(error: type[BaseException], action: Callable[[], object]) -> BaseException:
    """The error that an action, such as collecting a frame, ends with."""
    try:
        action()
    except error as raised:
        return raised
    raise AssertionError(f"{error.__name__} not raised")


assert_equal, assert_almost_equal, assert_array_almost_equal_nulp = assert_array_equal, assert_array_almost_equal, assert_array_max_ulp
