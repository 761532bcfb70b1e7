"""Places of values among a table of edges, by a join of ranges.

Values and edges are dealt into common ranges whose bounds come from a quantile sketch of both. A range holds each distinct
number once, with how many edges equal it; a running sum inside the range plus the number of edges in the ranges before it
(one number a range, all that the driver gets) is the place. Values then meet their places in a join by equal number: there
is no nested loop, no list of edges in a plan, and no task that sees all edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.ranges import bounds_of, range_of


def searchsorted(values: DataFrame, edges: DataFrame, x: str, edge: str, right: bool = False, out: str = "place") -> DataFrame:
    """``values`` with the number of edges below x, or at or below it (``right``).

    The edges' rows may come in any order and repeat; NULL edges don't count. NaN stands above all numbers. A NULL x has place
    NULL, and without edges every place is 0. All rows and columns of ``values`` are kept.
    """
    asked = values.select(F.col(f"`{x}`").cast("double").alias("__v"), F.lit(0).cast("long").alias("__n"))
    known = edges.select(F.col(f"`{edge}`").cast("double").alias("__v"), F.lit(1).cast("long").alias("__n"))
    both = asked.union(known).na.drop(subset="__v")
    both = both.filter(F.col("__v").isNotNull())
    bounds = bounds_of(both, "__v")
    numbers = both.union(known.filter(F.isnan("__v"))).union(asked.filter(F.isnan("__v"))).groupBy("__v").agg(F.sum("__n").alias("__n"))
    numbers = numbers.withColumn("__range", range_of(F.col("__v"), bounds)).persist()
    counts = {r["__range"]: r["__n"] for r in numbers.groupBy("__range").agg(F.sum("__n").alias("__n")).collect()}
    before = [sum(counts.get(k, 0) for k in range(r)) for r in range(len(bounds) + 1)]
    inside = Window.partitionBy("__range").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    running = F.sum("__n").over(inside) - (F.lit(0) if right else F.col("__n"))
    offsets = F.array(*[F.lit(b).cast("long") for b in before])
    places = numbers.select("__v", (running + F.get(offsets, F.col("__range"))).alias("__place"))
    kept = [F.col(f"`{n}`") for n in values.columns if n != out]
    return values.withColumn("__v", F.col(f"`{x}`").cast("double")).join(places, "__v", "left").select(*kept, F.col("__place").alias(out))


def digitize(values: DataFrame, edges: DataFrame, x: str, edge: str, right: bool = False, decreasing: bool = False, out: str = "bin") -> DataFrame:
    """``values`` with the bin among the edges: i where edge i - 1 <= x < edge i, or edge i - 1 < x <= edge i (``right``).

    With decreasing edges i where edge i - 1 > x >= edge i, or edge i - 1 >= x > edge i (``right``).
    """
    found = searchsorted(values, edges, x, edge, right=not right, out=out)
    if not decreasing:
        return found
    total = edges.filter(F.col(f"`{edge}`").isNotNull()).count()
    return found.withColumn(out, F.lit(total) - F.col(out))
