"""Changing a frame's shape by its index columns: nothing moves but the numbers that name the cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert(frame: DataFrame, position: str, value: str, at: int, new) -> DataFrame:
    """One element before position ``at``."""
    kind = frame.schema[value].dataType
    row = frame.sparkSession.range(1).select(F.lit(at).cast("bigint").alias(position), F.lit(new).cast(kind).alias(value))
    moved = F.col(position) + F.when(F.col(position) >= at, 1).otherwise(0)
    return frame.select(moved.alias(position), value).unionByName(row)


def delete(frame: DataFrame, position: str, at: Sequence[int]) -> DataFrame:
    """Without the elements at these positions; the others close up."""
    gone = sorted(set(at))
    before = sum((F.when(F.col(position) > p, 1).otherwise(0) for p in gone), F.lit(0))
    return frame.filter(~F.col(position).isin(gone)).withColumn(position, F.col(position) - before)


def cut(frame: DataFrame, position: str, start: int, stop: int, step: int = 1) -> DataFrame:
    """The slice start:stop:step for positive steps, as a range predicate that reaches the scan."""
    inside = F.col(position).between(start, stop - 1) & ((F.col(position) - start) % step == 0)
    return frame.filter(inside).withColumn(position, F.expr(f"(`{position}` - {start}) div {step}"))


def array_split(frame: DataFrame, position: str, parts: int) -> DataFrame:
    """Part number and position inside: the first (size mod parts) parts are one longer."""
    size = frame.agg(F.count("*").alias("__n"))
    each, extra = F.expr(f"__n div {parts}"), F.expr(f"__n % {parts}")
    longer = (each + 1) * extra
    part = F.when(F.col(position) < longer, F.floor(F.col(position) / (each + 1))).otherwise(extra + F.floor((F.col(position) - longer) / F.greatest(each, F.lit(1))))
    begin = F.when(F.col("part") < extra, F.col("part") * (each + 1)).otherwise(longer + (F.col("part") - extra) * each)
    return frame.crossJoin(F.broadcast(size)).withColumn("part", part.cast("bigint")).withColumn("inside", F.col(position) - begin).drop("__n")


def trim_zeros(frame: DataFrame, position: str, value: str) -> DataFrame:
    """Without leading and trailing zeros; positions start at 0 again."""
    ends = frame.filter(F.col(value) != 0).agg(F.min(position).alias("__lo"), F.max(position).alias("__hi"))
    inside = frame.crossJoin(F.broadcast(ends)).filter(F.col(position).between(F.col("__lo"), F.col("__hi")))
    return inside.withColumn(position, F.col(position) - F.col("__lo")).drop("__lo", "__hi")


def reshape(frame: DataFrame, index: Sequence[str], shape: Sequence[int], new: Sequence[str], new_shape: Sequence[int]) -> DataFrame:
    """Row-major: cells keep their flat place."""
    flat: Column = F.lit(0).cast("bigint")
    for name, size in zip(index, shape):
        flat = flat * size + F.col(name)
    others = [c for c in frame.columns if c not in index]
    out, rest = [], F.col("__flat")
    for name, size in list(zip(new, new_shape))[::-1]:
        out.append((rest % size).cast("bigint").alias(name))
        rest = F.floor(rest / size)
    return frame.withColumn("__flat", flat).select(*out[::-1], *others)


def rot90(frame: DataFrame, shape: tuple[int, int], index: Sequence[str] = ("i", "j"), k: int = 1) -> DataFrame:
    i, j = F.col(index[0]), F.col(index[1])
    rows, columns = shape
    new = {0: (i, j), 1: (columns - 1 - j, i), 2: (rows - 1 - i, columns - 1 - j), 3: (j, rows - 1 - i)}[k % 4]
    return frame.select(new[0].alias(index[0]), new[1].alias(index[1]), *[c for c in frame.columns if c not in index])


def diagonal(frame: DataFrame, index: Sequence[str] = ("i", "j"), offset: int = 0) -> DataFrame:
    at = F.least(F.col(index[0]), F.col(index[1]))
    return frame.filter(F.col(index[1]) - F.col(index[0]) == offset).withColumn(index[0], at).drop(index[1])


def diag(frame: DataFrame, position: str = "i", offset: int = 0) -> DataFrame:
    """A vector as the diagonal of a matrix."""
    i = F.col(position)
    return frame.select((i + max(0, -offset)).alias("i"), (i + max(0, offset)).alias("j"), *[c for c in frame.columns if c != position])


def meshgrid(x: DataFrame, y: DataFrame) -> DataFrame:
    """Every pair of the two vectors' cells (i, x) and (j, y); the result is that large by definition."""
    return x.crossJoin(y)


def put(frame: DataFrame, position: str, value: str, updates: DataFrame, at: str, new: str) -> DataFrame:
    """Elements replaced where ``updates`` names their position; of several the largest counts."""
    chosen = updates.groupBy(F.col(at).alias("__at")).agg(F.max(new).alias("__new"))
    joined = frame.join(chosen, F.col(position) == F.col("__at"), "left")
    return joined.withColumn(value, F.coalesce("__new", value)).drop("__at", "__new")


def extract(frame: DataFrame, condition: Column, position: str) -> DataFrame:
    """compress and nonzero: the rows where the condition holds, with their positions."""
    return frame.filter(F.coalesce(condition, F.lit(False))).orderBy(position)
