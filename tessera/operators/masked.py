"""Masked arrays: NULL is the mask. Data under a mask is kept only where a raw column stands beside."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def masked_where(condition: Column, x: Column) -> Column:
    return F.when(~F.coalesce(condition, F.lit(False)), x)


def masked_outside(x: Column, low, high) -> Column:
    return F.when(x.between(low, high), x)


def masked_inside(x: Column, low, high) -> Column:
    return F.when(~x.between(low, high), x)


def masked_values(x: Column, value: float, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.when(F.abs(x - value) > atol + rtol * abs(value), x)


def masked_invalid(x: Column) -> Column:
    return F.when(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")), x)


def filled(x: Column, value) -> Column:
    return F.coalesce(x, F.lit(value))


def compressed(frame: DataFrame, value: str) -> DataFrame:
    return frame.filter(F.col(value).isNotNull())


def count(x: Column) -> Column:
    return F.count(x)


def getmaskarray(x: Column) -> Column:
    return x.isNull()


def anom(x: Column, keys: Sequence[str] = ()) -> Column:
    """Distance from the mean of what is not masked."""
    return x - F.avg(x).over(Window.partitionBy(*keys))


def mask_or(a: Column, b: Column) -> Column:
    return a | b


def clump_unmasked(frame: DataFrame, value: str, position: str, keys: Sequence[str] = ()) -> DataFrame:
    """Runs of unmasked positions: (first, last), by the difference between position and rank."""
    over = Window.partitionBy(*keys).orderBy(position)
    runs = compressed(frame, value).withColumn("__run", F.col(position) - F.row_number().over(over))
    return runs.groupBy(*keys, "__run").agg(F.min(position).alias("first"), F.max(position).alias("last")).drop("__run")


def ediff1d(x: Column, keys: Sequence[str], order: Sequence[str]) -> Column:
    return x - F.lag(x).over(Window.partitionBy(*keys).orderBy(*order))
