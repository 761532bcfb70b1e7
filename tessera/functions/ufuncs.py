"""Elementwise functions: name -> how to make a column, how it reduces, and its identity.

Every function is a Catalyst expression. Where Spark answers NULL or an error outside a function's domain, the
expressions give NaN or an infinity as IEEE arithmetic does; NULL stays NULL (a masked element).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


@dataclass(frozen=True)
class Ufunc:
    """``sql`` states the function for DuckDB, with {x} and {y}; ``reduce`` is the aggregate its reduction uses."""

    name: str
    arity: int
    make: Callable[..., Column]
    sql: str
    reduce: Callable[[Column], Column] | None = None
    identity: object = None

    def __call__(self, *args: Column) -> Column:
        return self.make(*[a if isinstance(a, Column) else F.lit(a) for a in args])


def _d(x: Column) -> Column:
    return x.cast("double")


def _domain(inside: Column, value: Column, outside: float | Column = NAN) -> Column:
    """``value`` where ``inside`` holds, else ``outside``; NULL stays NULL."""
    return F.when(inside.isNull(), F.lit(None).cast("double")).when(inside, value).otherwise(outside)


def _log(of: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: F.when(_d(x) == 0, -INF).when(_d(x) > 0, of(_d(x))).when(x.isNotNull(), NAN)


def float_divmod(x: Column, y: Column) -> tuple[Column, Column]:
    """Floor quotient and remainder of doubles, the remainder exact and with the divisor's sign.

    The quotient comes from the exact remainder: x / y itself may round up to the next whole number. A zero divisor gives
    x / y and NaN.
    """
    x, y = _d(x), _d(y)
    rest = F.try_mod(x, y)
    other = (rest != 0) & ((rest < 0) != (y < 0)) & ~F.isnan(rest)
    moved = F.when(other, rest + y).when(rest == 0, F.signum(y) * 0.0).otherwise(rest)
    near = (x - rest) / F.nullif(y, F.lit(0.0)) - F.when(other, 1.0).otherwise(0.0)
    whole = F.rint(near)
    signed = F.when(whole == 0, F.signum(x) * F.signum(y) * 0.0).otherwise(whole)
    by_zero = F.when((x == 0) | F.isnan(x), NAN).when((x < 0) != (F.pow(y, F.lit(-1.0)) < 0), -INF).otherwise(INF)  # a zero's power tells its sign
    known = x.isNotNull() & y.isNotNull()
    return F.when(known, F.when(y == 0, by_zero).otherwise(signed)), F.when(known, F.when(y == 0, NAN).otherwise(moved))


def integer_divmod(x: Column, y: Column) -> tuple[Column, Column]:
    """Floor quotient and remainder of integers in whole numbers; a zero divisor gives 0 and 0."""
    x, y = x.cast("long"), y.cast("long")
    rest = F.try_mod(x, y)
    other = (rest != 0) & ((rest < 0) != (y < 0))
    quotient = F.call_function("div", x, F.nullif(y, F.lit(0).cast("long"))) - F.when(other, 1).otherwise(0)
    known = x.isNotNull() & y.isNotNull()
    return F.when(known, F.coalesce(quotient, F.lit(0).cast("long"))), F.when(known, F.coalesce(F.when(other, rest + y).otherwise(rest), F.lit(0).cast("long")))


def floor_mod(x: Column, y: Column) -> Column:
    """Remainder with the sign of the divisor; 0 divisor: NaN."""
    return float_divmod(x, y)[1]


def true_divide(x: Column, y: Column) -> Column:
    x, y = _d(x), _d(y)
    return F.when(y == 0, F.when((x == 0) | F.isnan(x), NAN).when(x > 0, INF).when(x < 0, -INF)).otherwise(x / F.nullif(y, F.lit(0.0)))


def maximum(x: Column, y: Column) -> Column:
    return F.when(x.isNull() | y.isNull(), None).otherwise(F.greatest(x, y))  # NaN is greatest, so it propagates


def minimum(x: Column, y: Column) -> Column:
    return F.when(x.isNull() | y.isNull(), None).when(F.isnan(_d(x)) | F.isnan(_d(y)), NAN).otherwise(F.least(x, y))


def _fmax(x: Column, y: Column) -> Column:
    return F.when(F.isnan(_d(x)), y).when(F.isnan(_d(y)), x).otherwise(F.greatest(x, y))


def _fmin(x: Column, y: Column) -> Column:
    return F.when(F.isnan(_d(x)), y).when(F.isnan(_d(y)), x).otherwise(F.least(x, y))


def logaddexp(x: Column, y: Column) -> Column:
    top = F.greatest(_d(x), _d(y))
    return F.when(top == -INF, -INF).otherwise(top + F.log1p(F.exp(-F.abs(_d(x) - _d(y)))))


def _frexp_exponent(x: Column) -> Column:
    return F.when(_d(x) == 0, 0).otherwise(F.floor(F.log2(F.nullif(F.abs(_d(x)), F.lit(0.0)))) + 1).cast("int")


def _sinc(x: Column) -> Column:
    y = F.when(_d(x) == 0, 1e-20).otherwise(_d(x)) * math.pi
    return F.sin(y) / y


def _heaviside(x: Column, y: Column) -> Column:
    return F.when(F.isnan(_d(x)), NAN).when(_d(x) < 0, 0.0).when(_d(x) == 0, _d(y)).when(_d(x) > 0, 1.0)


def _gcd(x: Column, y: Column) -> Column:
    """Euclid's steps in a fold: 64-bit integers need fewer than 93."""
    start = F.struct(F.abs(x.cast("bigint")).alias("a"), F.abs(y.cast("bigint")).alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.try_mod(s["a"], s["b"]).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(93)), start, step, lambda s: s["a"])


def _lcm(x: Column, y: Column) -> Column:
    return F.when((x == 0) | (y == 0), F.lit(0).cast("bigint")).otherwise(F.abs(x.cast("bigint") * y.cast("bigint")).cast("bigint") / _gcd(x, y)).cast("bigint")


def _shift(x: Column, y: Column, left: bool) -> Column:
    """Shifts by 64 or more give 0, or -1 for negatives to the right; Spark's own takes the count modulo 64."""
    moved = (x.cast("bigint") * F.pow(F.lit(2.0), y).cast("bigint")) if left else F.floor(x.cast("bigint") / F.pow(F.lit(2.0), y)).cast("bigint")
    return F.when(y >= 63, F.when(F.lit(left) | (x >= 0), 0).otherwise(-1)).otherwise(moved).cast("bigint")


def _u(name, make, sql, reduce=None, identity=None):
    return Ufunc(name, 1, make, sql, reduce, identity)


def _b(name, make, sql, reduce=None, identity=None):
    return Ufunc(name, 2, make, sql, reduce, identity)


#: Floor division stated in whole numbers: finite doubles of everyday size times 2**60 are whole, and exact.
_X, _Y = "({x} * pow(2, 60))::HUGEINT", "({y} * pow(2, 60))::HUGEINT"
_FINITE = "isnan({x}) OR isnan({y}) OR isinf({x})"
FLOOR_SQL = (
    f"CASE WHEN isnan({{x}}) OR isnan({{y}}) THEN 'nan'::DOUBLE WHEN isinf({{x}}) AND {{y}} <> 0 THEN 'nan'::DOUBLE WHEN {{y}} = 0 THEN CASE WHEN {{x}} = 0 THEN 'nan'::DOUBLE WHEN ({{x}} < 0) = ({{y}}::VARCHAR LIKE '-%') THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END"
    f" WHEN isinf({{y}}) THEN CASE WHEN {{x}} = 0 OR ({{x}} < 0) = ({{y}} < 0) THEN 0.0 ELSE -1.0 END"
    f" ELSE (({_X} - (({_X} % {_Y}) + {_Y}) % {_Y}) // {_Y})::DOUBLE END"
)
MOD_SQL = (
    f"CASE WHEN {_FINITE} OR {{y}} = 0 THEN 'nan'::DOUBLE WHEN isinf({{y}}) THEN CASE WHEN {{x}} = 0 OR ({{x}} < 0) = ({{y}} < 0) THEN {{x}} ELSE {{y}} END"
    f" ELSE ((({_X} % {_Y}) + {_Y}) % {_Y})::DOUBLE / pow(2, 60) END"
)


_ALL = [
    _u("negative", lambda x: -x, "-{x}"),
    _u("positive", lambda x: x, "{x}"),
    _u("absolute", F.abs, "abs({x})"),
    _u("fabs", lambda x: F.abs(_d(x)), "abs({x}::DOUBLE)"),
    _u("sign", lambda x: F.signum(_d(x)), "sign({x})::DOUBLE"),
    _u("square", lambda x: x * x, "{x} * {x}"),
    _u("sqrt", lambda x: F.sqrt(_d(x)), "sqrt({x})"),
    _u("cbrt", lambda x: F.cbrt(_d(x)), "cbrt({x})"),
    _u("reciprocal", lambda x: true_divide(F.lit(1.0), x), "1.0 / {x}"),
    _u("exp", lambda x: F.exp(_d(x)), "exp({x})"),
    _u("exp2", lambda x: F.pow(F.lit(2.0), _d(x)), "pow(2.0, {x})"),
    _u("expm1", lambda x: F.expm1(_d(x)), "exp({x}) - 1"),
    _u("log", _log(F.log), "ln({x})"),
    _u("log2", _log(F.log2), "log2({x})"),
    _u("log10", _log(F.log10), "log10({x})"),
    _u("log1p", lambda x: F.when(_d(x) == -1, -INF).when(_d(x) > -1, F.log1p(_d(x))).when(x.isNotNull(), NAN), "ln(1 + {x})"),
    _u("sin", lambda x: F.sin(_d(x)), "sin({x})"),
    _u("cos", lambda x: F.cos(_d(x)), "cos({x})"),
    _u("tan", lambda x: F.tan(_d(x)), "tan({x})"),
    _u("arcsin", lambda x: F.asin(_d(x)), "asin({x})"),
    _u("arccos", lambda x: F.acos(_d(x)), "acos({x})"),
    _u("arctan", lambda x: F.atan(_d(x)), "atan({x})"),
    _u("sinh", lambda x: F.sinh(_d(x)), "sinh({x})"),
    _u("cosh", lambda x: F.cosh(_d(x)), "cosh({x})"),
    _u("tanh", lambda x: F.tanh(_d(x)), "tanh({x})"),
    _u("arcsinh", lambda x: F.asinh(_d(x)), "asinh({x})"),
    _u("arccosh", lambda x: F.acosh(_d(x)), "acosh({x})"),
    _u("arctanh", lambda x: F.atanh(_d(x)), "atanh({x})"),
    _u("degrees", lambda x: F.degrees(_d(x)), "degrees({x})"),
    _u("radians", lambda x: F.radians(_d(x)), "radians({x})"),
    _u("rad2deg", lambda x: _d(x) * (180.0 / math.pi), "{x} * 180.0 / pi()"),
    _u("deg2rad", lambda x: _d(x) * (math.pi / 180.0), "{x} * pi() / 180.0"),
    _u("floor", lambda x: _d(F.floor(_d(x))), "floor({x})::DOUBLE"),
    _u("ceil", lambda x: _d(F.ceil(_d(x))), "ceil({x})::DOUBLE"),
    _u("trunc", lambda x: F.when(_d(x) < 0, F.ceil(_d(x))).otherwise(F.floor(_d(x))).cast("double"), "trunc({x})::DOUBLE"),
    _u("rint", lambda x: F.rint(_d(x)), "round_even({x}, 0)::DOUBLE"),
    _u("isnan", lambda x: F.isnan(_d(x)), "isnan({x}::DOUBLE)"),
    _u("isinf", lambda x: F.abs(_d(x)) == INF, "isinf({x}::DOUBLE)"),
    _u("isfinite", lambda x: ~F.isnan(_d(x)) & (F.abs(_d(x)) != INF), "isfinite({x}::DOUBLE)"),
    _u("signbit", lambda x: F.startswith(x.cast("string"), F.lit("-")), "{x} < 0"),
    _u("logical_not", lambda x: _d(x) == 0, "NOT ({x} <> 0)"),
    _u("sinc", _sinc, "sin(pi() * {x}) / (pi() * {x})"),
    _u("nan_to_num", lambda x: F.when(F.isnan(_d(x)), 0.0).otherwise(_d(x)), "CASE WHEN isnan({x}::DOUBLE) THEN 0 ELSE {x}::DOUBLE END"),
    _u("frexp_mantissa", lambda x: _d(x) / F.pow(F.lit(2.0), _frexp_exponent(x)), "{x} / pow(2, floor(log2(abs({x}))) + 1)"),
    _u("frexp_exponent", _frexp_exponent, "(floor(log2(abs({x}))) + 1)::INTEGER"),
    _u("modf_fraction", lambda x: _d(x) - F.when(_d(x) < 0, F.ceil(_d(x))).otherwise(F.floor(_d(x))), "{x} - trunc({x})"),
    _u("sigmoid", lambda x: 1.0 / (1.0 + F.exp(-_d(x))), "1.0 / (1.0 + exp(-{x}))"),
    _u("silu", lambda x: _d(x) / (1.0 + F.exp(-_d(x))), "{x} / (1.0 + exp(-{x}))"),
    _b("add", lambda x, y: x + y, "{x} + {y}", F.sum, 0),
    _b("subtract", lambda x, y: x - y, "{x} - {y}"),
    _b("multiply", lambda x, y: x * y, "{x} * {y}", F.product, 1),
    _b("divide", true_divide, "{x} / {y}"),
    _b("floor_divide", lambda x, y: float_divmod(x, y)[0], FLOOR_SQL),
    _b("mod", floor_mod, MOD_SQL),
    _b("fmod", lambda x, y: F.try_mod(_d(x), _d(y)), "{x} % {y}"),
    _b("power", lambda x, y: F.pow(_d(x), _d(y)), "pow({x}, {y})"),
    _b("float_power", lambda x, y: F.pow(_d(x), _d(y)), "pow({x}::DOUBLE, {y}::DOUBLE)"),
    _b("hypot", lambda x, y: F.hypot(_d(x), _d(y)), "sqrt({x} * {x} + {y} * {y})"),
    _b("arctan2", lambda x, y: F.atan2(_d(x), _d(y)), "atan2({x}, {y})"),
    _b("maximum", maximum, "greatest({x}, {y})", F.max),
    _b("minimum", minimum, "least({x}, {y})", F.min),
    _b("fmax", _fmax, "greatest({x}, {y})", F.max),
    _b("fmin", _fmin, "least({x}, {y})", F.min),
    _b("logaddexp", logaddexp, "ln(exp({x}) + exp({y}))"),
    _b("logaddexp2", lambda x, y: logaddexp(_d(x) * math.log(2), _d(y) * math.log(2)) / math.log(2), "log2(pow(2, {x}) + pow(2, {y}))"),
    _b("copysign", lambda x, y: F.when(F.startswith(y.cast("string"), F.lit("-")), -F.abs(_d(x))).otherwise(F.abs(_d(x))), "CASE WHEN {y} < 0 THEN -abs({x}) ELSE abs({x}) END"),
    _b("heaviside", _heaviside, "CASE WHEN {x} < 0 THEN 0.0 WHEN {x} = 0 THEN {y} ELSE 1.0 END::DOUBLE"),
    _b("ldexp", lambda x, y: _d(x) * F.pow(F.lit(2.0), y), "{x} * pow(2, {y})"),
    _b("equal", lambda x, y: x == y, "{x} = {y}"),
    _b("not_equal", lambda x, y: x != y, "{x} <> {y}"),
    _b("less", lambda x, y: x < y, "{x} < {y}"),
    _b("less_equal", lambda x, y: x <= y, "{x} <= {y}"),
    _b("greater", lambda x, y: x > y, "{x} > {y}"),
    _b("greater_equal", lambda x, y: x >= y, "{x} >= {y}"),
    _b("logical_and", lambda x, y: (_d(x) != 0) & (_d(y) != 0), "{x} <> 0 AND {y} <> 0", F.bool_and, True),
    _b("logical_or", lambda x, y: (_d(x) != 0) | (_d(y) != 0), "{x} <> 0 OR {y} <> 0", F.bool_or, False),
    _b("logical_xor", lambda x, y: (_d(x) != 0) != (_d(y) != 0), "({x} <> 0) <> ({y} <> 0)"),
]
_INTEGER = [
    _b("floor_divide_integer", lambda x, y: integer_divmod(x, y)[0], "CASE WHEN {y} = 0 THEN 0 ELSE ({x} - (({x} % {y}) + {y}) % {y}) // {y} END::BIGINT"),
    _b("mod_integer", lambda x, y: integer_divmod(x, y)[1], "CASE WHEN {y} = 0 THEN 0 ELSE (({x} % {y}) + {y}) % {y} END::BIGINT"),
    _u("invert", F.bitwise_not, "~{x}"),
    _u("bitwise_count", lambda x: F.bit_count(F.abs(x)).cast("int"), "bit_count(abs({x}))::INTEGER"),
    _b("bitwise_and", lambda x, y: x.bitwiseAND(y), "{x} & {y}", F.bit_and, -1),
    _b("bitwise_or", lambda x, y: x.bitwiseOR(y), "{x} | {y}", F.bit_or, 0),
    _b("bitwise_xor", lambda x, y: x.bitwiseXOR(y), "xor({x}, {y})", F.bit_xor, 0),
    _b("left_shift", lambda x, y: _shift(x, y, True), "{x} << {y}"),
    _b("right_shift", lambda x, y: _shift(x, y, False), "{x} >> {y}"),
    _b("gcd", _gcd, "gcd({x}, {y})"),
    _b("lcm", _lcm, "lcm({x}, {y})"),
]
UFUNCS: dict[str, Ufunc] = {u.name: u for u in _ALL + _INTEGER}
INTEGER_ONLY = frozenset(u.name for u in _INTEGER)
