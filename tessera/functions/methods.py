"""Methods of elementwise functions as operators: reduce, accumulate, outer, at, reduceat."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.ufuncs import UFUNCS
from tessera.operators.window import running

FOLDS = {"add": "cumsum", "multiply": "cumprod", "maximum": "cummax", "fmax": "cummax", "minimum": "cummin", "fmin": "cummin"}


def ufunc_reduce(frame: DataFrame, name: str, value: str, keep: Sequence[str] = (), out: str = "y") -> DataFrame:
    """The function's own aggregate; its identity where a whole frame is empty."""
    ufunc = UFUNCS[name]
    if ufunc.reduce is None:
        raise TypeError(f"{name} has no reduction")
    result = ufunc.reduce(F.col(value))
    return frame.groupBy(*keep).agg((F.coalesce(result, F.lit(ufunc.identity)) if ufunc.identity is not None else result).alias(out))


def ufunc_accumulate(frame: DataFrame, name: str, value: str, order: Sequence[str], keep: Sequence[str] = (), out: str = "y") -> DataFrame:
    return frame.withColumn(out, running(FOLDS[name], F.col(value), Window.partitionBy(*keep).orderBy(*order)))


def ufunc_outer(a: DataFrame, b: DataFrame, name: str, x: str, y: str, out: str = "z") -> DataFrame:
    """The function of every pair: the result has |a| * |b| rows by definition."""
    return a.crossJoin(b).withColumn(out, UFUNCS[name](F.col(x), F.col(y)))


def ufunc_at(frame: DataFrame, name: str, index: str, value: str, updates: DataFrame, at: str, x: str) -> DataFrame:
    """Unbuffered update: all of an index's updates count. They are summed up before they meet the frame."""
    ufunc = UFUNCS[name]
    total = updates.groupBy(F.col(at).alias("__at")).agg(ufunc.reduce(F.col(x)).alias("__x"))
    joined = frame.join(total, F.col(index) == F.col("__at"), "left")
    return joined.withColumn(value, F.when(F.col("__at").isNull(), F.col(value)).otherwise(ufunc(F.col(value), F.col("__x")))).drop("__at", "__x")


def ufunc_reduceat(frame: DataFrame, name: str, position: str, value: str, starts: Sequence[int], out: str = "y") -> DataFrame:
    """(segment, y): reductions of the slices between increasing starts; the last one goes to the end."""
    segment = sum((F.when(F.col(position) >= s, 1).otherwise(0) for s in starts[1:]), F.lit(0))
    inside = frame.filter(F.col(position) >= starts[0])
    return inside.groupBy(segment.alias("segment")).agg(UFUNCS[name].reduce(F.col(value)).alias(out))
