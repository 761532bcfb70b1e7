"""Functions of masked arrays: NULL is the mask, so an element is masked in a result if it is in any operand.

Functions with a domain also mask what lies outside it (the root of a negative number, division by zero) and what is not
finite where the plain function would give NaN or an infinity. Reductions skip masked elements; of a group without any
unmasked element they give NULL, sums and products included. Everything is a Catalyst expression.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.ufuncs import float_divmod

#: Divisors smaller than this against their dividend are masked.
TINY = 2.2250738585072014e-308


def _within(inside: Callable[[Column], Column], function: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: F.when(inside(x), function(x))


def _as_is(x: Column) -> Column:
    return x


def _rounded(x: Column, decimals: int = 0) -> Column:
    """Halves go to the even neighbour."""
    return F.bround(x, decimals)


UNARY: dict[str, Callable[..., Column]] = {
    "sqrt": _within(lambda x: x >= 0, F.sqrt),
    "log": _within(lambda x: x > 0, F.log),
    "log2": _within(lambda x: x > 0, F.log2),
    "log10": _within(lambda x: x > 0, F.log10),
    "arcsin": _within(lambda x: F.abs(x) <= 1, F.asin),
    "arccos": _within(lambda x: F.abs(x) <= 1, F.acos),
    "arccosh": _within(lambda x: x >= 1, F.acosh),
    "arctanh": _within(lambda x: F.abs(x) < 1, F.atanh),
    "tan": _within(lambda x: F.abs(F.cos(x)) > 1e-35, F.tan),
    "exp": F.exp,
    "sin": F.sin,
    "cos": F.cos,
    "arctan": F.atan,
    "sinh": F.sinh,
    "cosh": F.cosh,
    "tanh": F.tanh,
    "arcsinh": F.asinh,
    "absolute": F.abs,
    "abs": F.abs,
    "fabs": lambda x: F.abs(x.cast("double")),
    "floor": lambda x: F.floor(x).cast("double"),
    "ceil": lambda x: F.ceil(x).cast("double"),
    "negative": lambda x: -x,
    "conjugate": _as_is,
    "around": _rounded,
    "round_": _rounded,
    "round": _rounded,
    "logical_not": lambda x: x == 0,
    "angle": lambda x: F.when(x < 0, F.pi()).when(x.isNotNull(), 0.0),
}


def _divided(function: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    """Division masks divisors that are zero, or so small that the quotient has no finite value."""
    return lambda x, y: F.when(F.abs(x) * TINY < F.abs(y), function(x, F.nullif(y, F.lit(0) * y)))


BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda x, y: x + y,
    "subtract": lambda x, y: x - y,
    "multiply": lambda x, y: x * y,
    "divide": _divided(lambda x, y: x / y),
    "true_divide": _divided(lambda x, y: x / y),
    "floor_divide": _divided(lambda x, y: float_divmod(x, y)[0]),
    "remainder": _divided(lambda x, y: float_divmod(x, y)[1]),
    "mod": _divided(lambda x, y: float_divmod(x, y)[1]),
    "fmod": _divided(lambda x, y: x % y),
    "power": lambda x, y: masked_invalid(F.pow(x, y)),
    "maximum": lambda x, y: F.when(x.isNotNull() & y.isNotNull(), F.greatest(x, y)),
    "minimum": lambda x, y: F.when(x.isNotNull() & y.isNotNull(), F.least(x, y)),
    "hypot": F.hypot,
    "arctan2": F.atan2,
    "equal": lambda x, y: x == y,
    "not_equal": lambda x, y: x != y,
    "less": lambda x, y: x < y,
    "less_equal": lambda x, y: x <= y,
    "greater": lambda x, y: x > y,
    "greater_equal": lambda x, y: x >= y,
    "logical_and": lambda x, y: _both(x, y, lambda a, b: a & b),
    "logical_or": lambda x, y: _both(x, y, lambda a, b: a | b),
    "logical_xor": lambda x, y: _both(x, y, lambda a, b: a != b),
}

INTEGER: dict[str, Callable[[Column, Column], Column]] = {
    "bitwise_and": lambda x, y: x.bitwiseAND(y),
    "bitwise_or": lambda x, y: x.bitwiseOR(y),
    "bitwise_xor": lambda x, y: x.bitwiseXOR(y),
    "left_shift": lambda x, y: F.call_function("shiftleft", x, y.cast("int")),
    "right_shift": lambda x, y: F.call_function("shiftright", x, y.cast("int")),
}


def _both(x: Column, y: Column, function: Callable[[Column, Column], Column]) -> Column:
    """A logical function of two truths, masked where either is; SQL's own would know false AND NULL."""
    return F.when(x.isNotNull() & y.isNotNull(), function(x != 0, y != 0))


def masked_invalid(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


#: Masks by comparison with a value.
COMPARED: dict[str, Callable[[Column, object], Column]] = {
    "masked_equal": lambda x, v: F.when(x != v, x),
    "masked_not_equal": lambda x, v: F.when(x == v, x),
    "masked_greater": lambda x, v: F.when(x <= v, x),
    "masked_greater_equal": lambda x, v: F.when(x < v, x),
    "masked_less": lambda x, v: F.when(x >= v, x),
    "masked_less_equal": lambda x, v: F.when(x > v, x),
    "masked_object": lambda x, v: F.when(x != v, x),
}


def fix_invalid(x: Column, mask: Column | None = None) -> Column:
    """Mask what is not finite, and what ``mask`` says."""
    fixed = masked_invalid(x)
    return fixed if mask is None else F.when(~F.coalesce(mask, F.lit(False)), fixed)


REDUCTIONS: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "prod": F.product,
    "product": F.product,
    "mean": F.avg,
    "var": F.var_pop,
    "variance": F.var_pop,
    "std": F.stddev_pop,
    "max": F.max,
    "amax": F.max,
    "min": F.min,
    "amin": F.min,
    "ptp": lambda x: F.max(x) - F.min(x),
    "median": F.median,
    "all": lambda x: F.bool_and(x != 0),
    "alltrue": lambda x: F.bool_and(x != 0),
    "any": lambda x: F.bool_or(x != 0),
    "sometrue": lambda x: F.bool_or(x != 0),
    "count": F.count,
    "count_masked": lambda x: F.count_if(x.isNull()),
    "is_masked": lambda x: F.bool_or(x.isNull()),
}


def reduce(frame: DataFrame, name: str, x: str, keys: Sequence[str], out: str) -> DataFrame:
    return frame.groupBy(*keys).agg(REDUCTIONS[name](F.col(x)).alias(out))


def arg_extreme(frame: DataFrame, x: str, position: str, keys: Sequence[str], largest: bool, out: str = "position") -> DataFrame:
    """First position of the extreme among what is not masked."""
    value = F.col(x) if largest else -F.col(x)
    best = F.max_by(F.when(F.col(x).isNotNull(), F.col(position)), F.when(F.col(x).isNotNull(), F.struct(value.alias("v"), (-F.col(position)).alias("p"))))
    return frame.groupBy(*keys).agg(best.alias(out))


def average(frame: DataFrame, x: str, weight: str, keys: Sequence[str], out: str) -> DataFrame:
    """Weighted mean of what is masked in neither."""
    value, by = F.col(x), F.col(weight)
    return frame.groupBy(*keys).agg((F.sum(value * by) / F.nullif(F.sum(F.when(value.isNotNull(), by)), F.lit(0.0))).alias(out))


def moments(frame: DataFrame, x: str, y: str, keys: Sequence[str]) -> DataFrame:
    """cov and corrcoef over the pairs that are masked in neither."""
    a, b = (F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.col(c)) for c in (x, y))
    return frame.groupBy(*keys).agg(F.covar_samp(a, b).alias("cov"), F.corr(a, b).alias("corrcoef"))


def dot(frame: DataFrame, x: str, y: str, keys: Sequence[str], out: str = "dot") -> DataFrame:
    """Sum of products; masked elements count as zero."""
    return frame.groupBy(*keys).agg(F.coalesce(F.sum(F.col(x) * F.col(y)), F.lit(0.0)).alias(out))


def cumulative(name: str, x: Column, keys: Sequence[str], order: Sequence[str]) -> Column:
    """cumsum or cumprod along an order; masked elements stay masked and count as 0 or 1."""
    over = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = {"cumsum": F.sum, "cumprod": F.product}[name](x).over(over)
    return F.when(x.isNotNull(), total)


def ranks(x: Column, keys: Sequence[str], tie: Sequence[str]) -> Column:
    """Places from 0 in sorted order, as argsort gives them; masked elements come last."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc_nulls_last(x), *tie)) - 1


def unique(frame: DataFrame, x: str) -> DataFrame:
    """Distinct elements with their number; all masked ones are one."""
    return frame.groupBy(x).count()


def allequal(frame: DataFrame, x: str, y: str, fill_value: bool = True, out: str = "allequal") -> DataFrame:
    """Whether all pairs are equal; masked ones count as ``fill_value``."""
    return frame.agg(F.coalesce(F.bool_and(F.coalesce(F.col(x) == F.col(y), F.lit(fill_value))), F.lit(True)).alias(out))


def allclose(frame: DataFrame, x: str, y: str, masked_equal: bool = True, rtol: float = 1e-5, atol: float = 1e-8, out: str = "allclose") -> DataFrame:
    near = F.abs(F.col(x) - F.col(y)) <= atol + rtol * F.abs(F.col(y))
    return frame.agg(F.coalesce(F.bool_and(F.coalesce(near, F.lit(masked_equal))), F.lit(True)).alias(out))


def runs(frame: DataFrame, x: str, position: str, masked: bool, keys: Sequence[str] = ()) -> DataFrame:
    """(first, last) of each run of masked or unmasked positions (clump_masked, flatnotmasked_contiguous).

    Positions are whole numbers without gaps; within a run the position less its rank among its kind doesn't change.
    """
    wanted = F.col(x).isNull() if masked else F.col(x).isNotNull()
    mine = frame.filter(wanted).select(*keys, F.col(position).alias("__p"))
    marked = mine.withColumn("__run", F.col("__p") - F.row_number().over(Window.partitionBy(*keys).orderBy("__p")))
    return marked.groupBy(*keys, "__run").agg(F.min("__p").alias("first"), F.max("__p").alias("last")).drop("__run")


def edges(frame: DataFrame, x: str, position: str, keys: Sequence[str] = ()) -> DataFrame:
    """First and last unmasked position (flatnotmasked_edges, notmasked_edges along keys)."""
    there = F.when(F.col(x).isNotNull(), F.col(position))
    return frame.groupBy(*keys).agg(F.min(there).alias("first"), F.max(there).alias("last"))


def mask_axis(frame: DataFrame, x: str, axes: Sequence[str]) -> DataFrame:
    """Mask whole rows, columns or both that hold a masked element (mask_rows, mask_cols, mask_rowcols)."""
    hit = F.lit(False)
    for axis in axes:
        hit = hit | F.bool_or(F.col(x).isNull()).over(Window.partitionBy(axis))
    return frame.withColumn("__hit", hit).withColumn(x, F.when(~F.col("__hit"), F.col(x))).drop("__hit")


def compress_axis(frame: DataFrame, x: str, axes: Sequence[str]) -> DataFrame:
    """Leave such rows, columns or both out (compress_rows, compress_cols, compress_rowcols, compress_nd)."""
    hit = F.lit(False)
    for axis in axes:
        hit = hit | F.bool_or(F.col(x).isNull()).over(Window.partitionBy(axis))
    return frame.withColumn("__hit", hit).filter("not __hit").drop("__hit")


def set_operation(name: str, left: DataFrame, right: DataFrame) -> DataFrame:
    """intersect1d, union1d, setdiff1d and setxor1d of one-column frames; masked elements are one element."""
    if name == "intersect1d":
        return left.intersect(right)
    if name == "union1d":
        return left.union(right).distinct()
    if name == "setdiff1d":
        return left.subtract(right)
    return left.subtract(right).union(right.subtract(left))


def membership(frame: DataFrame, x: str, wanted: DataFrame, out: str) -> DataFrame:
    """in1d and isin: masked where the element is; ``wanted`` has one column."""
    known = wanted.select(F.col(wanted.columns[0]).alias("__known")).distinct().withColumn("__hit", F.lit(True))
    joined = frame.join(known, F.col(x).eqNullSafe(F.col("__known")), "left")
    return joined.withColumn(out, F.when(F.col(x).isNotNull(), F.coalesce("__hit", F.lit(False)))).drop("__known", "__hit")


def put(x: Column, condition: Column, value: Column | object, hard: bool = False) -> Column:
    """putmask: assign where the condition holds; a hard mask keeps masked elements masked (harden_mask, soften_mask)."""
    new = value if isinstance(value, Column) else F.lit(value)
    return F.when(condition & ~(x.isNull() & F.lit(hard)), new).otherwise(x)


def polyfit(frame: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Straight line through the pairs masked in neither: slope and intercept."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(y)), F.when(both, F.col(x))
    return frame.groupBy(*keys).agg(F.regr_slope(a, b).alias("slope"), F.regr_intercept(a, b).alias("intercept"))
