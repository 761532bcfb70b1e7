"""Sorting, ranking, selection by rank, and search in sorted edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.window import with_positions


def sort(frame: DataFrame, *keys: str, descending: bool = False) -> DataFrame:
    """A distributed sort; NaN is greatest."""
    return frame.orderBy(*[F.col(k).desc() if descending else F.col(k).asc() for k in keys])


def argsort(frame: DataFrame, value: str, position: str, keys: Sequence[str] = ()) -> DataFrame:
    """rank (from 0) and the position of the element that has it; equal values keep their order. A whole frame is ranked by ranges."""
    if not keys:
        return with_positions(frame.select(value, position), [value, position], "rank").select("rank", F.col(position).alias("position"))
    over = Window.partitionBy(*keys).orderBy(value, position)
    return frame.select(*keys, (F.row_number().over(over) - 1).alias("rank"), F.col(position).alias("position"))


def lexsort(frame: DataFrame, by: Sequence[str], position: str, keys: Sequence[str] = ()) -> DataFrame:
    """As ``argsort`` by several columns, the last of ``by`` first."""
    if not keys:
        return with_positions(frame.select(*by, position), [*reversed(by), position], "rank").select("rank", F.col(position).alias("position"))
    over = Window.partitionBy(*keys).orderBy(*reversed(by), position)
    return frame.select(*keys, (F.row_number().over(over) - 1).alias("rank"), F.col(position).alias("position"))


def smallest(frame: DataFrame, value: str, k: int, keys: Sequence[str] = (), largest: bool = False, tie: str | None = None) -> DataFrame:
    """The first k of each group (a partition's head): Spark keeps k rows a group before the shuffle."""
    order = [F.col(value).desc() if largest else F.col(value).asc()] + ([F.col(tie)] if tie else [])
    if not keys:
        return frame.orderBy(*order).limit(k)
    return frame.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__r") <= k).drop("__r")


def searchsorted(edges: Sequence[float], value: Column, right: bool = False) -> Column:
    """Insertion place of a value among increasing edges, by bisection in one expression."""

    def bisect(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when((value >= edges[mid]) if right else (value > edges[mid]), bisect(mid + 1, hi)).otherwise(bisect(lo, mid))

    return bisect(0, len(edges))
