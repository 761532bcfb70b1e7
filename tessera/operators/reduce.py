"""Reductions along axes: a frame's group columns are the axes kept, all others are reduced.

Partial sums run before the shuffle, so a group may hold any share of the rows. An empty group list reduces everything.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.ranges import bounds_of, range_of

NAN = float("nan")


def variance(x: Column, ddof: int = 0) -> Column:
    """Variance with ``ddof`` degrees taken off; NaN where none are left."""
    n = F.count(x)
    return F.when(n > ddof, F.var_pop(x) * n / F.nullif(n - ddof, F.lit(0))).otherwise(NAN)


def not_nan(x: Column) -> Column:
    """NULL for NaN, which every aggregate leaves out."""
    return F.when(~F.isnan(x.cast("double")), x)


def minimum_of(x: Column) -> Column:
    """Smallest element; NaN if there is one."""
    return F.when(F.max(F.isnan(x.cast("double"))), NAN).otherwise(F.min(x))


AGGREGATES = {
    "sum": lambda x: F.coalesce(F.sum(x), F.lit(0)),
    "prod": lambda x: F.coalesce(F.product(x.cast("double")), F.lit(1.0)),
    "mean": lambda x: F.coalesce(F.avg(x), F.lit(NAN)),
    "var": variance,
    "std": lambda x: F.sqrt(variance(x)),
    "var_sample": lambda x: variance(x, 1),
    "std_sample": lambda x: F.sqrt(variance(x, 1)),
    "max": F.max,
    "min": minimum_of,
    "ptp": lambda x: F.max(x) - minimum_of(x),
    "any": lambda x: F.coalesce(F.bool_or(x.cast("double") != 0), F.lit(False)),
    "all": lambda x: F.coalesce(F.bool_and(x.cast("double") != 0), F.lit(True)),
    "count_nonzero": lambda x: F.count_if(x.cast("double") != 0),
    "size": F.count,
    "nansum": lambda x: F.coalesce(F.sum(not_nan(x)), F.lit(0)),
    "nanprod": lambda x: F.coalesce(F.product(not_nan(x).cast("double")), F.lit(1.0)),
    "nanmean": lambda x: F.coalesce(F.avg(not_nan(x)), F.lit(NAN)),
    "nanvar": lambda x: variance(not_nan(x)),
    "nanstd": lambda x: F.sqrt(variance(not_nan(x))),
    "nanmax": lambda x: F.coalesce(F.max(not_nan(x)), F.lit(NAN)),
    "nanmin": lambda x: F.coalesce(F.min(not_nan(x)), F.lit(NAN)),
    "median": F.median,
    "nanmedian": lambda x: F.median(not_nan(x)),
    "logsumexp": None,
}


def reduce_axis(frame: DataFrame, name: str, value: str, keep: Sequence[str] = (), out: str | None = None) -> DataFrame:
    """One aggregate of ``value`` over the rows that agree in the columns ``keep``."""
    if name == "logsumexp":
        return logsumexp(frame, value, keep, out or name)
    return frame.groupBy(*keep).agg(AGGREGATES[name](F.col(value)).alias(out or name))


def arg_extreme(frame: DataFrame, value: str, position: str, keep: Sequence[str] = (), largest: bool = True, out: str = "position") -> DataFrame:
    """Position of the first largest (smallest) element, NaN counting as extreme either way; one struct aggregate."""
    x = F.col(value).cast("double")
    first = F.struct(F.isnan(x).alias("nan"), (x if largest else -x).alias("x"), (-F.col(position)).alias("p"))
    return frame.filter(F.col(value).isNotNull()).groupBy(*keep).agg((-F.max(first)["p"]).alias(out))


def logsumexp(frame: DataFrame, value: str, keep: Sequence[str] = (), out: str = "logsumexp") -> DataFrame:
    """log(sum(exp(x))) shifted by each group's largest element: two aggregates, no group in one place."""
    top = frame.groupBy(*keep).agg(F.max(value).alias("__top"))
    joined = frame.join(top, list(keep)) if keep else frame.crossJoin(F.broadcast(top))
    return joined.groupBy(*keep).agg((F.max("__top") + F.log(F.sum(F.exp(F.col(value) - F.col("__top"))))).alias(out))


def average(frame: DataFrame, value: str, weight: str, keep: Sequence[str] = (), out: str = "average") -> DataFrame:
    return frame.groupBy(*keep).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias(out))


#: method -> (alpha, beta) of the continuous quantile definitions: place = alpha + q * (n + 1 - alpha - beta).
CONTINUOUS = {
    "interpolated_inverted_cdf": (0.0, 1.0),
    "hazen": (0.5, 0.5),
    "weibull": (0.0, 0.0),
    "linear": (1.0, 1.0),
    "median_unbiased": (1 / 3, 1 / 3),
    "normal_unbiased": (3 / 8, 3 / 8),
}
#: method -> how the place (n - 1) * q between two elements is settled.
SETTLED = {"lower": F.floor, "higher": F.ceil, "nearest": F.rint}
METHODS = (*CONTINUOUS, *SETTLED, "midpoint", "inverted_cdf", "averaged_inverted_cdf", "closest_observation")


def quantile(frame: DataFrame, value: str, q: float, keep: Sequence[str] = (), method: str = "linear", out: str = "quantile", nan: bool = True) -> DataFrame:
    """The q-quantile of each group by any of METHODS; a NaN makes it NaN, or is left out without ``nan``. NULL never counts.

    Equal values become one row with a count, counts are added up by ranges of values, and only the ranges that hold the one
    or two elements needed are put in order, so no group passes through one task, nor does the whole frame without ``keep``.
    """
    given = frame.select(*keep, F.col(value).cast("double").alias("__x")).filter("__x is not null" if nan else "__x is not null and not isnan(__x)")
    counted = given.groupBy(*keep, "__x").agg(F.count("*").alias("__c"))
    counted = counted.withColumn("__range", range_of(F.col("__x"), bounds_of(given, "__x")))
    over = Window.partitionBy(*keep).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*keep)
    blocks = counted.groupBy(*keep, "__range").agg(F.sum("__c").alias("__size"), F.max(F.isnan("__x")).alias("__nan"))
    blocks = blocks.withColumn("__before", F.coalesce(F.sum("__size").over(over), F.lit(0))).withColumn("__n", F.sum("__size").over(group).cast("double")).withColumn("__nan", F.max("__nan").over(group))
    low, part = _places(F.col("__n"), q, method)
    blocks = blocks.withColumn("__low", low.cast("bigint")).withColumn("__part", part)
    needed = blocks.filter((F.col("__before") <= F.col("__low")) & (F.col("__before") + F.col("__size") >= F.col("__low")))
    inside = Window.partitionBy(*keep, "__range").orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.join(needed, [*keep, "__range"]).withColumn("__end", F.col("__before") + F.sum("__c").over(inside))
    has = lambda place: (F.col("__end") >= place) & (F.col("__end") - F.col("__c") < place)
    first = F.max(F.when(has(F.col("__low")), F.col("__x")))
    second = F.max(F.when(has(F.col("__low") + 1), F.col("__x")))
    share = F.max("__part")
    result = F.when(F.max("__nan"), F.lit(float("nan"))).when(share == 0, first).otherwise(first + (second - first) * share)
    return placed.groupBy(*keep).agg(result.alias(out))


def _places(n: Column, q: float, method: str) -> tuple[Column, Column]:
    """Place, from 1, of the element at or below the quantile of n elements, and the share of the one after it."""
    if method in CONTINUOUS:
        alpha, beta = CONTINUOUS[method]
        place = F.least(F.greatest(F.lit(alpha) + F.lit(q) * (n + 1 - alpha - beta), F.lit(1.0)), n)
        return F.floor(place), place - F.floor(place)
    if method in SETTLED or method == "midpoint":
        place = (n - 1) * q
        low = F.floor(place) + 1 if method == "midpoint" else SETTLED[method](place) + 1
        return low, F.when(place > F.floor(place), 0.5).otherwise(0.0) if method == "midpoint" else F.lit(0.0)
    place = n * q
    if method == "closest_observation":
        return F.greatest(F.rint(place), F.lit(1.0)), F.lit(0.0)
    half = (place == F.floor(place)) & (place >= 1) & (place < n)
    return F.greatest(F.ceil(place), F.lit(1.0)), F.when(half, 0.5).otherwise(0.0) if method == "averaged_inverted_cdf" else F.lit(0.0)


def percentile(frame: DataFrame, value: str, p: float, keep: Sequence[str] = (), method: str = "linear", out: str = "percentile", nan: bool = True) -> DataFrame:
    return quantile(frame, value, p / 100, keep, method, out, nan)


#: estimator -> width of a bin from (n, spread, deviation, |skewness|, interquartile range).
WIDTHS = {
    "sqrt": lambda n, spread, *_: spread / math.sqrt(n),
    "sturges": lambda n, spread, *_: spread / (math.log2(n) + 1),
    "rice": lambda n, spread, *_: spread / (2 * n ** (1 / 3)),
    "scott": lambda n, _, deviation, *__: (24 * math.sqrt(math.pi) / n) ** (1 / 3) * deviation,
    "doane": lambda n, spread, _, skew, __: spread / (1 + math.log2(n) + math.log2(1 + skew / math.sqrt(6 * (n - 2) / ((n + 1) * (n + 3))))) if n > 2 else 0.0,
    "fd": lambda n, _, __, ___, quartiles: 2 * quartiles / n ** (1 / 3),
    "auto": lambda n, spread, *rest: min(WIDTHS["fd"](n, spread, *rest) or math.inf, WIDTHS["sturges"](n, spread)),
}


def histogram_bin_edges(frame: DataFrame, value: str, bins: int | str = 10) -> list[float]:
    """Edges of equal bins over all values, by number or by one of WIDTHS; from one row of moments and two quantiles.

    Without values the edges are those of [0, 1], and one value alone gets half a unit on either side.
    """
    x = F.col(value).cast("double")
    n, low, high, deviation, skew = frame.agg(F.count(x), F.min(x), F.max(x), F.stddev_pop(x), F.abs(F.skewness(x))).first()
    if not n:
        low, high = 0.0, 1.0
    if isinstance(bins, str):
        spread = high - low
        quartiles = quantile(frame, value, 0.75).first()[0] - quantile(frame, value, 0.25).first()[0] if bins in ("fd", "auto") and n else 0.0
        width = WIDTHS[bins](n, spread, deviation, skew or 0.0, quartiles) if n and spread else 0.0
        bins = max(1, math.ceil(spread / width)) if width else 1
    if low == high:
        low, high = low - 0.5, high + 0.5
    return [low + (high - low) * k / bins for k in range(bins)] + [high]


def histogramdd(frame: DataFrame, values: Sequence[str], bins: Sequence[int], ranges: Sequence[tuple[float, float]]) -> DataFrame:
    """(b0, b1, ..., count) of the cells that hold rows; the last bin of each axis is closed, rows beyond a range count nowhere."""
    inside, at = F.lit(True), []
    for k, (value, count, (low, high)) in enumerate(zip(values, bins, ranges)):
        x = F.col(value).cast("double")
        inside &= (x >= low) & (x <= high)
        at.append(F.least(F.floor((x - low) / ((high - low) / count)), F.lit(count - 1)).cast("int").alias(f"b{k}"))
    return frame.filter(inside).groupBy(*at).agg(F.count("*").alias("count"))


def histogram(frame: DataFrame, value: str, bins: int, low: float, high: float) -> DataFrame:
    """(bin, count) of all ``bins`` equal bins of [low, high]; the last one is closed."""
    x = F.col(value).cast("double")
    at = F.least(F.floor((x - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    counted = frame.filter((x >= low) & (x <= high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    every = frame.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(counted), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("count"))


def histogram2d(frame: DataFrame, x: str, y: str, bins: tuple[int, int], ranges: tuple[tuple[float, float], tuple[float, float]]) -> DataFrame:
    """(i, j, count) of the bins that hold rows."""
    place = lambda c, n, r: F.least(F.floor((F.col(c).cast("double") - r[0]) / ((r[1] - r[0]) / n)), F.lit(n - 1)).cast("int")
    inside = F.col(x).between(*ranges[0]) & F.col(y).between(*ranges[1])
    return frame.filter(inside).groupBy(place(x, bins[0], ranges[0]).alias("i"), place(y, bins[1], ranges[1]).alias("j")).agg(F.count("*").alias("count"))


def bincount(frame: DataFrame, value: str, weight: str | None = None) -> DataFrame:
    """(value, count) for every integer from 0 to the largest."""
    counted = frame.filter(F.col(value) >= 0).groupBy(F.col(value).cast("bigint").alias("value")).agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    top = counted.agg(F.max("value").alias("top"))
    every = top.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("top"))).alias("value"))
    return every.join(counted, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("count"))


def digitize(value: Column, edges: Sequence[float], right: bool = False) -> Column:
    """How many of the increasing edges lie at or below (below, if ``right``) the value."""
    hits = [F.when((value > e) if right else (value >= e), 1).otherwise(0) for e in edges]
    return sum(hits[1:], hits[0]).cast("int") if hits else F.lit(0)


def moments(frame: DataFrame, x: str, y: str, keep: Sequence[str] = (), ddof: int = 1) -> DataFrame:
    """Covariance and correlation of two columns."""
    covariance = F.covar_samp(x, y) if ddof else F.covar_pop(x, y)
    return frame.groupBy(*keep).agg(covariance.alias("cov"), F.corr(x, y).alias("corrcoef"))
