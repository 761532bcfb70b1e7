"""Ranges of a number over a whole frame: what replaces one sorted partition.

Bounds come from a quantile sketch, so ranges hold like shares of the rows; which range a number belongs to is an
expression, the same in every task and retry. Equal numbers share a range, so what works on ranges first makes equal
numbers one row with a count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounds_of(frame: DataFrame, value: str, ranges: int | None = None) -> list[float]:
    """At most ``ranges`` - 1 ascending bounds, by default as many ranges as shuffles have partitions; NaN and NULL don't count."""
    ranges = ranges or int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if ranges < 2:
        return []
    return sorted(set(frame.approxQuantile(value, [k / ranges for k in range(1, ranges)], 0.25 / ranges)))


def range_of(x: Column, bounds: Sequence[float]) -> Column:
    """Number of bounds that are not above x, by halving; NaN is above all."""
    if not bounds:
        return F.lit(0)
    middle = len(bounds) // 2
    above = range_of(x, bounds[middle + 1 :]) + (middle + 1)
    return F.when(x < bounds[middle], range_of(x, bounds[:middle])).otherwise(above)
