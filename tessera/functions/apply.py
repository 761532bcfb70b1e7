"""Functions of one's own over elements, lines of an axis, and axes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def vectorize(function: Callable, kind: str = "double") -> Callable[..., Column]:
    """A function of plain values as one of columns, in Arrow batches. Where an argument is NULL the result is, unasked."""

    @F.pandas_udf(kind)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for given in batches:
            columns = (given,) if isinstance(given, pd.Series) else given
            there = ~pd.concat([c.isna() for c in columns], axis=1).any(axis=1)
            out = pd.Series([None] * len(there), dtype=object)
            out[there.to_numpy()] = [function(*row) for row in zip(*(c[there].tolist() for c in columns))]
            yield out

    return run


def frompyfunc(function: Callable, inputs: int, kind: str = "string") -> Callable[..., Column]:
    """``vectorize`` that checks the number of arguments."""
    made = vectorize(function, kind)

    def call(*columns: Column) -> Column:
        if len(columns) != inputs:
            raise TypeError(f"{inputs} arguments wanted, {len(columns)} given")
        return made(*columns)

    return call


def apply_along_axis(frame: DataFrame, function: Callable[[np.ndarray], np.ndarray | float], keys: Sequence[str], position: str, value: str, out: str = "y") -> DataFrame:
    """(keys, position, out): ``function`` of each line, in the order of its positions; numbers it gives instead of arrays stand at 0.

    A line is as long as one axis and is worked on in one task; lines are dealt by their keys. NULL elements become NaN.
    """
    given = frame.select(*keys, F.col(position).cast("bigint").alias(position), F.col(value).cast("double").alias(value))
    schema = T.StructType([given.schema[k] for k in keys] + [T.StructField(position, T.LongType()), T.StructField(out, T.DoubleType())])

    def line(rows: pd.DataFrame) -> pd.DataFrame:
        result = np.atleast_1d(np.asarray(function(rows.sort_values(position)[value].to_numpy(dtype=float)), dtype=float))
        made = pd.DataFrame({position: np.arange(len(result)), out: result})
        for k in keys:
            made[k] = rows[k].iloc[0]
        return made[[*keys, position, out]]

    return given.groupBy(*keys).applyInPandas(line, schema)


def apply_over_axes(frame: DataFrame, fold: Callable[[Column], Column], positions: Sequence[str], axes: Sequence[str], value: str) -> DataFrame:
    """A fold along one axis after another, all axes kept, those folded with the one place 0."""
    for axis in axes:
        kept = [p for p in positions if p != axis]
        frame = frame.groupBy(*kept).agg(fold(F.col(value)).alias(value)).withColumn(axis, F.lit(0).cast("bigint")).select(*positions, value)
    return frame
