"""Ordered operations on vector frames: positions, running folds, differences, moving windows, interpolation.

Global order without a global sort in one task: rows are range-partitioned by their order, each range is summed up on
its own, and a range's offset is the sum of the ranges before it (one small row for each range).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tessera.operators.ranges import bounds_of, range_of
from tessera.operators.scans import scan


def ordered(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def running(fold: str, x: Column, over: WindowSpec) -> Column:
    """cumsum, cumprod, cummax, cummin along an order."""
    over = over.rowsBetween(Window.unboundedPreceding, 0)
    return {"cumprod": lambda v: F.product(v.cast("double")), "cumsum": F.sum, "cummax": F.max, "cummin": F.min, "cumcount": F.count, "cummean": F.avg}[fold](x).over(over)


def diff(x: Column, over: WindowSpec, n: int = 1) -> Column:
    """n-th difference; NULL for the first n rows, which an array would not have."""
    return diff(x - F.lag(x).over(over), over, n - 1) if n else x


def gradient(x: Column, over: WindowSpec, step: float = 1.0) -> Column:
    """Central differences inside, one-sided ones at both ends."""
    before, after = F.lag(x).over(over), F.lead(x).over(over)
    return F.when(before.isNull(), (after - x) / step).when(after.isNull(), (x - before) / step).otherwise((after - before) / (2 * step))


def sliding(aggregate, x: Column, over: WindowSpec, width: int) -> Column:
    """An aggregate over each full window of ``width`` rows that ends in the row; NULL before the first full one."""
    over = over.rowsBetween(-(width - 1), 0)
    return F.when(F.count(F.lit(1)).over(over) == width, aggregate(x).over(over))


def convolve(x: Column, weights: Sequence[float], over: WindowSpec) -> Column:
    """Discrete convolution, the outputs that start in each row; rows beyond the ends count as 0."""
    terms = [F.coalesce(F.lag(x, k).over(over), F.lit(0.0)) * w for k, w in enumerate(weights)]
    return sum(terms[1:], terms[0])


def affine_scan(frame: DataFrame, decay: Column, x: Column, keys: Sequence[str], order: Sequence[str], out: str = "y") -> DataFrame:
    """``frame`` with h = decay * h + x along an order, from 0 for each key; a whole frame has no keys.

    A NULL x adds nothing and a NULL decay is 1. Keys of any size are split over ranges.
    """
    return scan(frame, "affine", [F.coalesce(decay.cast("double"), F.lit(1.0)), F.coalesce(x.cast("double"), F.lit(0.0))], order, keys, out)


def trapezoid(frame: DataFrame, y: str, x: str, keys: Sequence[str] = (), order: Sequence[str] | None = None, out: str = "area") -> DataFrame:
    over = ordered(keys, order or [x])
    step = (F.col(x) - F.lag(x).over(over)) * (F.col(y) + F.lag(y).over(over)) / 2
    return frame.select(*keys, step.alias("__step")).groupBy(*keys).agg(F.coalesce(F.sum("__step"), F.lit(0.0)).alias(out))


def with_positions(frame: DataFrame, order: Sequence[str], out: str = "pos") -> DataFrame:
    """Number rows from 0 in an order over the whole frame. The ranges' counts, one row each, are all that is gathered."""
    ranged = frame.repartitionByRange(*[F.col(c) for c in order]).withColumn("__range", F.spark_partition_id()).persist()
    counts = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("__range").orderBy(*order)
    numbered = ranged.join(F.broadcast(offsets), "__range").withColumn(out, F.col("__offset") + F.row_number().over(inside) - 1)
    return numbered.drop("__range", "__offset")


def interpolate(points: DataFrame, known: DataFrame, x: str, xp: str, fp: str, out: str = "y", left: float | None = None, right: float | None = None) -> DataFrame:
    """Piecewise linear values at ``points.x`` of the samples (xp, fp), beyond the ends those of the ends, or ``left`` and ``right``.

    Each distinct x looks to its nearest samples on both sides within its range of samples, and beyond it to the range's
    neighbours, whose end samples are one row a range. Of samples with one xp the largest fp counts, samples with a NULL are
    left out, and a NULL x gives NULL.
    """
    samples = known.select(F.col(xp).cast("double").alias("__x"), F.col(fp).cast("double").alias("__f")).na.drop().groupBy("__x").agg(F.max("__f").alias("__f"))
    bounds = bounds_of(known.select(F.col(xp).cast("double").alias("__x")), "__x")
    asked = points.select(F.col(x).cast("double").alias("__x")).na.drop(subset="__x").distinct()
    sample = F.when(F.col("__f").isNotNull(), F.struct("__x", "__f"))
    both = asked.withColumn("__asked", F.lit(True)).join(samples, "__x", "full").withColumn("__range", range_of(F.col("__x"), bounds)).withColumn("__s", sample)
    ends = both.groupBy("__range").agg(F.min("__s").alias("__low"), F.max("__s").alias("__high"))
    by_range = Window.orderBy("__range")
    ends = ends.select("__range", F.last("__high", True).over(by_range.rowsBetween(Window.unboundedPreceding, -1)).alias("__prior"), F.first("__low", True).over(by_range.rowsBetween(1, Window.unboundedFollowing)).alias("__next"))
    inside = Window.partitionBy("__range").orderBy("__x")
    a = F.coalesce(F.last("__s", True).over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.col("__prior"))
    b = F.coalesce(F.first("__s", True).over(inside.rowsBetween(0, Window.unboundedFollowing)), F.col("__next"))
    seen = both.join(F.broadcast(ends), "__range").withColumn("__a", a).withColumn("__b", b).filter("__asked")
    a, b = F.col("__a"), F.col("__b")
    line = a["__f"] + (b["__f"] - a["__f"]) * (F.col("__x") - a["__x"]) / F.nullif(b["__x"] - a["__x"], F.lit(0.0))
    first, last = (b["__f"] if left is None else F.lit(left)), (a["__f"] if right is None else F.lit(right))
    value = F.when(F.isnan("__x"), F.col("__x")).when(a.isNull(), first).when(b.isNull(), last).when(a["__x"] == b["__x"], a["__f"]).otherwise(line)
    found = seen.select("__x", value.alias("__y"))
    kept = [F.col(f"`{n}`") for n in points.columns if n != out]
    return points.withColumn("__x", F.col(x).cast("double")).join(found, "__x", "left").select(*kept, F.col("__y").alias(out))


def slide(frame: DataFrame, position: str, value: str, weights: Sequence[float], mode: str = "full", flipped: bool = True, out: str = "y") -> DataFrame:
    """(pos, y): convolution of a vector with a few weights, or their correlation where they aren't ``flipped``.

    Each element adds to as many outputs as there are weights, and the sums are made in part before they shuffle. Modes are
    full, same and valid; a vector shorter than the weights has no valid output. An empty vector gives no rows.
    """
    given = [float(w) for w in (weights if flipped else reversed(weights))]
    terms = F.posexplode(F.array(*[F.lit(w) for w in given])).alias("__j", "__w")
    full = frame.select(F.col(position).alias("__i"), F.col(value).cast("double").alias("__v"), terms).groupBy((F.col("__i") + F.col("__j")).alias(position)).agg(F.sum(F.col("__v") * F.col("__w")).alias(out))
    if mode == "full":
        return full
    size = frame.agg(F.count("*").alias("__n"))
    m, n = F.lit(len(given)), F.col("__n")
    begin, count = (m - 1, n - m + 1) if mode == "valid" else (F.floor((F.least(m, n) - 1) / 2), F.greatest(m, n))
    return full.crossJoin(F.broadcast(size)).filter((F.col(position) >= begin) & (F.col(position) < begin + count)).select((F.col(position) - begin).cast("bigint").alias(position), out)
