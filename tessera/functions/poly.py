"""Polynomials whose coefficients are constants or array columns, lowest degree first, as expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def polyval(x: Column, coefficients: Sequence[float]) -> Column:
    """Horner's rule."""
    out = F.lit(float(coefficients[-1]))
    for c in reversed(coefficients[:-1]):
        out = out * x + float(c)
    return out


def polyval_column(x: Column, coefficients: Column) -> Column:
    return F.aggregate(F.reverse(coefficients), F.lit(0.0), lambda acc, c: acc * x + c)


def _clenshaw(x: Column, c: Sequence[float], next_term) -> Column:
    """Sum of c[k] * P_k(x) with P_0 = 1 and P_{k+1} by ``next_term(k, P_k, P_{k-1})``."""
    before, now, total = F.lit(0.0), F.lit(1.0), F.lit(float(c[0]))
    for k in range(1, len(c)):
        before, now = now, next_term(k - 1, now, before)
        total = total + now * float(c[k])
    return total


def chebval(x: Column, c: Sequence[float]) -> Column:
    return _clenshaw(x, c, lambda k, now, before: x if k == 0 else 2 * x * now - before)


def legval(x: Column, c: Sequence[float]) -> Column:
    return _clenshaw(x, c, lambda k, now, before: (x * now * (2 * k + 1) - before * k) / (k + 1))


def hermval(x: Column, c: Sequence[float]) -> Column:
    return _clenshaw(x, c, lambda k, now, before: 2 * x * now - before * (2 * k))


def hermeval(x: Column, c: Sequence[float]) -> Column:
    return _clenshaw(x, c, lambda k, now, before: x * now - before * k)


def lagval(x: Column, c: Sequence[float]) -> Column:
    return _clenshaw(x, c, lambda k, now, before: ((2 * k + 1 - x) * now - before * k) / (k + 1))


def polyadd(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))


def polymul(a: Column, b: Column) -> Column:
    """Coefficients of the product: one sum for each degree."""
    size = F.size(a) + F.size(b) - 1
    term = lambda d: F.aggregate(F.sequence(F.lit(0), F.size(a) - 1), F.lit(0.0), lambda acc, i: acc + F.when((d - i >= 0) & (d - i < F.size(b)), F.get(a, i) * F.get(b, d - i)).otherwise(0.0))
    return F.transform(F.sequence(F.lit(0), size - 1), term)


def polyder(c: Column) -> Column:
    return F.transform(F.slice(c, 2, F.size(c)), lambda x, i: x * (i + 1))


def polyint(c: Column, constant: float = 0.0) -> Column:
    return F.concat(F.array(F.lit(constant)), F.transform(c, lambda x, i: x / (i + 1)))
