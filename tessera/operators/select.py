"""Choosing and moving elements by condition and by position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def where(condition: Column, yes: Column, no: Column) -> Column:
    return F.when(condition, yes).otherwise(no)


def select(conditions: Sequence[Column], choices: Sequence[Column], default: Column) -> Column:
    """The choice of the first condition that holds."""
    out = F
    for condition, choice in zip(conditions, choices):
        out = out.when(condition, choice)
    return out.otherwise(default)


def choose(index: Column, choices: Sequence[Column], mode: str = "raise") -> Column:
    """choices[index]; "wrap" takes the index modulo their number, "clip" to the ends, "raise" gives NULL outside."""
    n = len(choices)
    at = F.pmod(index, F.lit(n)) if mode == "wrap" else F.greatest(F.lit(0), F.least(index, F.lit(n - 1))) if mode == "clip" else index
    return select([at == i for i in range(n)], choices, F.lit(None))


def clip(x: Column, low=None, high=None) -> Column:
    x = x if low is None else F.greatest(x, F.lit(low))
    return x if high is None else F.least(x, F.lit(high))


def take(frame: DataFrame, position: str, indices: DataFrame, index: str) -> DataFrame:
    """Rows at positions, as often as named, in ``indices``' rows."""
    return indices.join(frame, indices[index] == frame[position])


def reversed_positions(frame: DataFrame, position: str) -> DataFrame:
    """flip: the size is one aggregate row."""
    size = frame.agg((F.count("*") - 1).alias("__last"))
    return frame.crossJoin(F.broadcast(size)).withColumn(position, F.col("__last") - F.col(position)).drop("__last")


def roll(frame: DataFrame, position: str, shift: int) -> DataFrame:
    size = frame.agg(F.count("*").alias("__n"))
    moved = F.pmod(F.col(position) + shift, F.col("__n"))
    return frame.crossJoin(F.broadcast(size)).withColumn(position, moved).drop("__n")


def repeat(frame: DataFrame, position: str, times: int) -> DataFrame:
    """Every element ``times`` times in a row."""
    copies = F.explode(F.sequence(F.lit(0), F.lit(times - 1)))
    return frame.withColumn("__k", copies).withColumn(position, F.col(position) * times + F.col("__k")).drop("__k")


def tile(frame: DataFrame, position: str, times: int) -> DataFrame:
    """The whole vector ``times`` times."""
    size = frame.agg(F.count("*").alias("__n"))
    copies = F.explode(F.sequence(F.lit(0), F.lit(times - 1)))
    return frame.crossJoin(F.broadcast(size)).withColumn("__k", copies).withColumn(position, F.col(position) + F.col("__k") * F.col("__n")).drop("__k", "__n")


def pad(frame: DataFrame, position: str, value: str, before: int, after: int, fill) -> DataFrame:
    """``before`` and ``after`` constant elements around the vector."""
    kind = frame.schema[value].dataType
    size = frame.agg(F.count("*").alias("__n"))
    ends = size.select(F.explode(F.concat(F.sequence(F.lit(0), F.lit(before - 1)) if before else F.array().cast("array<int>"), F.transform(F.sequence(F.lit(1), F.lit(after)), lambda i: (F.col("__n") + before - 1 + i).cast("int")) if after else F.array().cast("array<int>"))).alias(position))
    filled = ends.select(F.col(position).cast("bigint").alias(position), F.lit(fill).cast(kind).alias(value))
    return frame.select((F.col(position) + before).alias(position), value).unionByName(filled)


#: Statistics of the whole vector that padding may repeat.
PAD_VALUES = {"maximum": F.max, "minimum": F.min, "mean": F.avg, "median": F.median}
PAD_MODES = ("edge", "reflect", "symmetric", "wrap", "linear_ramp", "empty", *PAD_VALUES)


def pad_mode(frame: DataFrame, position: str, value: str, before: int, after: int, mode: str, end: float = 0.0) -> DataFrame:
    """``before`` and ``after`` elements around a vector of numbers, by one of PAD_MODES; ``end`` is where ramps lead to.

    New elements are before + after rows that look up where they come from. An empty vector stays empty.
    """
    if mode not in PAD_MODES:
        raise ValueError(f"unknown mode {mode}")
    number = frame.select(F.col(position).cast("bigint").alias("__at"), F.col(value).cast("double").alias("__v"))
    size = frame.agg(F.count("*").alias("__n"), *([PAD_VALUES[mode](F.col(value).cast("double")).alias("__all")] if mode in PAD_VALUES else []))
    i, n = F.col("__i"), F.col("__n")
    places = [F.lit(k).cast("bigint") for k in range(-before, 0)] + [n + k for k in range(after)]
    ends = size.filter("__n > 0").withColumn("__i", F.explode(F.array(*places))) if places else None
    moved = frame.select((F.col(position).cast("bigint") + before).alias(position), F.col(value).cast("double").alias(value))
    if ends is None:
        return moved
    if mode == "reflect":
        folded = F.pmod(i, F.greatest(2 * (n - 1), F.lit(1)))
        source = F.when(folded > n - 1, 2 * (n - 1) - folded).otherwise(folded)
    elif mode == "symmetric":
        folded = F.pmod(i, 2 * n)
        source = F.when(folded >= n, 2 * n - 1 - folded).otherwise(folded)
    elif mode == "wrap":
        source = F.pmod(i, n)
    else:
        source = F.least(F.greatest(i, F.lit(0)), n - 1)
    found = number.join(F.broadcast(ends.withColumn("__at", source.cast("bigint"))), "__at")
    v = F.col("__v")
    if mode == "linear_ramp":
        share = F.when(i < 0, -i / float(before or 1)).otherwise((i - n + 1) / float(after or 1))
        v = v + (end - v) * share
    elif mode in PAD_VALUES:
        v = F.col("__all")
    elif mode == "empty":
        v = F.lit(None).cast("double")
    return moved.unionByName(found.select((i + before).alias(position), v.alias(value)))


def diagflat(frame: DataFrame, position: str, value: str, size: int, k: int = 0) -> DataFrame:
    """(i, j, x): the square of ``size`` + abs(k) with the vector on its k-th diagonal; only that diagonal has rows."""
    i = F.col(position).cast("bigint")
    return frame.filter((i >= 0) & (i < size)).select((i + max(-k, 0)).alias("i"), (i + max(k, 0)).alias("j"), F.col(value).alias("x"))


def compress(frame: DataFrame, condition: Column) -> DataFrame:
    """Rows where the condition holds; NULL doesn't."""
    return frame.filter(condition)


def nonzero(frame: DataFrame, positions: Sequence[str], value: str) -> DataFrame:
    """Positions of the elements that aren't zero; NaN isn't zero, a NULL has no place."""
    return frame.filter(F.col(value) != 0).select(*positions)
