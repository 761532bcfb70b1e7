"""Set routines. NaN counts as one value and -0.0 as 0.0, as Spark's grouping has it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.window import with_positions


def unique(frame: DataFrame, value: str, position: str | None = None) -> DataFrame:
    """Distinct values with their counts and, given a position, the first one."""
    aggregates = [F.count("*").alias("counts")] + ([F.min(position).alias("index")] if position else [])
    return frame.groupBy(F.col(value).alias("value")).agg(*aggregates)


def unique_inverse(frame: DataFrame, value: str) -> DataFrame:
    """Each row with the rank of its value among the distinct ones, from 0; distinct values are numbered by ranges, side by side."""
    return frame.join(with_positions(frame.select(value).distinct(), [value], "inverse"), value)


def unique_values(frame: DataFrame, value: str) -> DataFrame:
    return frame.select(value).distinct()


def unique_all(frame: DataFrame, value: str, position: str) -> DataFrame:
    """Each distinct value with its count, its first position and its rank among the distinct ones, from 0."""
    return with_positions(unique(frame, value, position), ["value"], "inverse")


def isin(frame: DataFrame, value: str, other: DataFrame, key: str, invert: bool = False) -> DataFrame:
    return frame.join(other, frame[value] == other[key], "left_anti" if invert else "left_semi")


def intersect1d(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def union1d(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def setdiff1d(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def setxor1d(a: DataFrame, b: DataFrame) -> DataFrame:
    """Values of just one side: one aggregate over both instead of two differences."""
    sides = a.withColumn("__side", F.lit(1)).union(b.withColumn("__side", F.lit(2)))
    return sides.groupBy(*a.columns).agg(F.min("__side").alias("__lo"), F.max("__side").alias("__hi")).filter("__lo = __hi").select(*a.columns)


def concatenate(frames: Sequence[DataFrame], position: str) -> DataFrame:
    """Frames one after another; positions go on where the frame before ended."""
    out = None
    for frame in frames:
        moved = frame.crossJoin(F.broadcast(offset_frame(frame, out))).withColumn(position, F.col(position) + F.col("__offset")).drop("__offset")
        out = moved if out is None else out.unionByName(moved)
    return out


def offset_frame(like: DataFrame, before: DataFrame | None) -> DataFrame:
    """One row: how many positions stand before."""
    if before is None:
        return like.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("__offset"))
    return before.agg(F.count("*").alias("__offset"))
