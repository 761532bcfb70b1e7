"""Axes, joins and splits of coordinate frames, places in them, and comparisons of whole frames.

A tensor is a frame of index columns and a value column ``x``. Axes are index columns, so moving them renames columns,
stacking adds or shifts one, splitting numbers the part and the place inside; no cell is copied or ordered.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce as _fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.ufuncs import float_divmod
from tessera.operators.window import with_positions


# Axes.
def permute_dims(frame: DataFrame, index: Sequence[str], axes: Sequence[int]) -> DataFrame:
    """Axis k of the result is axis axes[k] of ``frame``."""
    others = [c for c in frame.columns if c not in index]
    return frame.select(*[F.col(index[axis]).alias(index[k]) for k, axis in enumerate(axes)], *others)


def swapaxes(frame: DataFrame, index: Sequence[str], a: int, b: int) -> DataFrame:
    axes = list(range(len(index)))
    axes[a], axes[b] = axes[b], axes[a]
    return permute_dims(frame, index, axes)


def moveaxis(frame: DataFrame, index: Sequence[str], source: int, destination: int) -> DataFrame:
    axes = [k for k in range(len(index)) if k != source % len(index)]
    axes.insert(destination % len(index), source % len(index))
    return permute_dims(frame, index, axes)


def rollaxis(frame: DataFrame, index: Sequence[str], axis: int, start: int = 0) -> DataFrame:
    return moveaxis(frame, index, axis, start - 1 if axis < start else start)


def matrix_transpose(frame: DataFrame, index: Sequence[str] = ("i", "j")) -> DataFrame:
    return swapaxes(frame, index, -2 % len(index), -1 % len(index))


def expand_dims(frame: DataFrame, axis: str) -> DataFrame:
    """A new axis of length 1 (newaxis, atleast_2d, atleast_3d)."""
    return frame.withColumn(axis, F.lit(0).cast("bigint"))


def squeeze(frame: DataFrame, axis: str) -> DataFrame:
    return frame.drop(axis)


def ravel_multi_index(index: Sequence[Column], shape: Sequence[int]) -> Column:
    """Flat place in row-major order."""
    flat = F.lit(0).cast("bigint")
    for column, size in zip(index, shape):
        flat = flat * size + column
    return flat


def unravel_index(flat: Column, shape: Sequence[int]) -> list[Column]:
    out = []
    for size in reversed(shape):
        out.append((flat % size).cast("bigint"))
        flat = F.floor(flat / size)
    return out[::-1]


def ravel(frame: DataFrame, index: Sequence[str], shape: Sequence[int], out: str = "pos") -> DataFrame:
    others = [c for c in frame.columns if c not in index]
    return frame.select(ravel_multi_index([F.col(c) for c in index], shape).alias(out), *others)


def resize(frame: DataFrame, position: str, size: int, new_size: int) -> DataFrame:
    """A vector of ``size`` cells repeated or cut to ``new_size``."""
    times = -(-new_size // max(size, 1))
    copies = F.explode(F.sequence(F.lit(0), F.lit(max(times - 1, 0))))
    grown = frame.withColumn("__copy", copies).withColumn(position, F.col(position) + F.col("__copy") * size)
    return grown.filter(F.col(position) < new_size).drop("__copy")


def flip(frame: DataFrame, axis: str, size: int) -> DataFrame:
    """fliplr and flipud name their axis."""
    return frame.withColumn(axis, size - 1 - F.col(axis))


# Joining and splitting.
def stack(frames: Sequence[DataFrame], axis: str) -> DataFrame:
    """Frames along a new axis, numbered from 0."""
    return _fold(DataFrame.unionByName, [f.withColumn(axis, F.lit(k).cast("bigint")) for k, f in enumerate(frames)])


def concatenate(frames: Sequence[DataFrame], axis: str, sizes: Sequence[int]) -> DataFrame:
    """Frames along an axis that they have (hstack, vstack, row_stack, dstack, r_, c_, append)."""
    begins = [sum(sizes[:k]) for k in range(len(sizes))]
    return _fold(DataFrame.unionByName, [f.withColumn(axis, F.col(axis) + begin) for f, begin in zip(frames, begins)])


def column_stack(vectors: Sequence[DataFrame], position: str = "i", column: str = "j") -> DataFrame:
    """Vectors as the columns of a matrix."""
    return stack(vectors, column)


def block(blocks: Sequence[Sequence[DataFrame]], heights: Sequence[int], widths: Sequence[int], index: Sequence[str] = ("i", "j")) -> DataFrame:
    return concatenate([concatenate(row, index[1], widths) for row in blocks], index[0], heights)


def unstack(frame: DataFrame, axis: str, size: int) -> list[DataFrame]:
    return [frame.filter(F.col(axis) == k).drop(axis) for k in range(size)]


def split(frame: DataFrame, axis: str, size: int, parts: int) -> DataFrame:
    """Equal parts along an axis (hsplit, vsplit, dsplit name it): ``part``, and the place inside."""
    if size % parts:
        raise ValueError(f"{size} cells don't split into {parts} equal parts")
    each = size // parts
    return frame.withColumn("part", F.floor(F.col(axis) / each)).withColumn(axis, F.col(axis) % each)


# Elements by place.
def take_along_axis(frame: DataFrame, places: DataFrame, axis: str, keys: Sequence[str], at: str) -> DataFrame:
    """For each row of ``places`` (keys, k, at) the element of ``frame`` (keys, axis, x) there."""
    return places.join(frame.withColumnRenamed(axis, at), [*keys, at], "left")


def put_along_axis(frame: DataFrame, places: DataFrame, axis: str, keys: Sequence[str], value: str, new: str) -> DataFrame:
    """Elements replaced where ``places`` (keys, axis, new) names them; of several the largest counts."""
    chosen = places.groupBy(*keys, axis).agg(F.max(new).alias("__new"), F.lit(True).alias("__hit"))
    return frame.join(chosen, [*keys, axis], "left").withColumn(value, F.when(F.col("__hit"), F.col("__new")).otherwise(F.col(value))).drop("__new", "__hit")


def put_where(x: Column, condition: Column, value: Column) -> Column:
    """putmask, copyto and place with one value; a NULL condition is no."""
    return F.when(F.coalesce(condition, F.lit(False)), value).otherwise(x)


def fill_diagonal(frame: DataFrame, value: float, index: Sequence[str] = ("i", "j"), x: str = "x") -> DataFrame:
    return frame.withColumn(x, F.when(F.col(index[0]) == F.col(index[1]), F.lit(value)).otherwise(F.col(x)))


def piecewise(x: Column, cases: Sequence[tuple[Column, Column]], default: Column) -> Column:
    """The value of the last condition that holds, as later assignments overwrite earlier ones."""
    out = None
    for condition, value in reversed(cases):
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(default) if out is not None else default


def argwhere(frame: DataFrame, condition: Column, index: Sequence[str]) -> DataFrame:
    return frame.filter(F.coalesce(condition, F.lit(False))).select(*index)


def argpartition(x: Column, kth: int, keys: Sequence[str], tie: Sequence[str]) -> Column:
    """Side of each element: below, at, or above the kth place; only ranks up to the place matter."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(x, *tie)) - 1
    return F.when(rank < kth, -1).when(rank == kth, 0).otherwise(1)


# Comparison.
def isclose(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8, equal_nan: bool = False) -> Column:
    a, b = a.cast("double"), b.cast("double")
    infinite = (F.abs(a) == float("inf")) | (F.abs(b) == float("inf"))
    near = F.when(F.isnan(a) | F.isnan(b), F.isnan(a) & F.isnan(b) & F.lit(equal_nan)).when(infinite, a == b).otherwise(F.abs(a - b) <= atol + rtol * F.abs(b))
    return F.when(a.isNotNull() & b.isNotNull(), near)


def allclose(frame: DataFrame, a: str, b: str, **tolerance) -> DataFrame:
    return frame.agg(F.coalesce(F.bool_and(isclose(F.col(a), F.col(b), **tolerance)), F.lit(True)).alias("allclose"))


def array_equal(a: DataFrame, b: DataFrame, index: Sequence[str], x: str = "x") -> DataFrame:
    """Whether both have the same cells with the same values: one full join by index."""
    left = a.select(*index, F.col(x).alias("__a"), F.lit(True).alias("__in_a"))
    right = b.select(*index, F.col(x).alias("__b"), F.lit(True).alias("__in_b"))
    same = F.coalesce(F.col("__in_a") & F.col("__in_b") & (F.col("__a") == F.col("__b")), F.lit(False))
    return left.join(right, list(index), "full").agg(F.coalesce(F.bool_and(same), F.lit(True)).alias("array_equal"))


def isposinf(x: Column) -> Column:
    return x == float("inf")


def isneginf(x: Column) -> Column:
    return x == float("-inf")


def iscomplex(z: Column) -> Column:
    """Of struct(re, im): whether there is an imaginary part."""
    return z["im"] != 0


def isreal(z: Column) -> Column:
    return z["im"] == 0


# Rounding and parts.
def fix(x: Column) -> Column:
    """Toward zero."""
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def round_half_even(x: Column, decimals: int = 0) -> Column:
    """round and around."""
    return F.bround(x, decimals)


def divmod_(x: Column, y: Column) -> tuple[Column, Column]:
    """Floor quotient and remainder of doubles."""
    return float_divmod(x, y)


def logn(base: Column | float, x: Column) -> Column:
    return F.log(x) / F.log(base if isinstance(base, Column) else F.lit(float(base)))


def i0(x: Column, halves: int = 128) -> Column:
    """Modified Bessel function of order 0: the mean of exp(x cos t) over half a circle.

    The trapezoidal rule has only the terms of order 2 * ``halves`` and above as its error: below 1e-16 of the value up to
    arguments of 700, beyond which the value leaves the doubles.
    """
    size = F.abs(x.cast("double"))
    places = F.array(*[F.lit(math.cos(math.pi * k / halves) - 1) for k in range(1, halves)])
    inner = F.aggregate(places, F.lit(0.0), lambda total, c: total + F.exp(size * c))
    return F.when(size.isNotNull(), F.exp(size) * ((1 + F.exp(-2 * size)) / 2 + inner) / halves)


def kaiser(spark, size: int, beta: float) -> DataFrame:
    """Samples of the Kaiser window."""
    place = F.lit(2.0) * F.col("id") / (size - 1) - 1
    root = F.sqrt(F.greatest(F.lit(0.0), 1 - place * place))
    return spark.range(size).select(F.col("id").alias("pos"), (i0(root * beta) / i0(F.lit(beta))).alias("x"))


def vander(x: Column, n: int, increasing: bool = False) -> Column:
    """Row of powers of x, from the highest down unless ``increasing``; 0 to the power of 0 is 1."""
    return F.array(*[F.pow(x.cast("double"), F.lit(float(k))) for k in (range(n) if increasing else reversed(range(n)))])


# Generated frames.
#: Columns of a strip of a triangle's indices, and cells of a square of which one task makes its part, about.
WIDE, CELLS = 256, 1 << 26


def indices(spark, shape: tuple[int, int]) -> DataFrame:
    """All index pairs (indices, mgrid, ndindex, ix_, ogrid joined)."""
    rows, columns = shape
    return spark.range(rows * columns).select(F.floor(F.col("id") / columns).alias("i"), (F.col("id") % columns).alias("j"))


def triangle_indices(spark, n: int, k: int = 0, lower: bool = True) -> DataFrame:
    """tril_indices and triu_indices: pieces of rows of up to WIDE cells, one strip of columns after the other.

    Only cells of the triangle are made. Columns repeat every WIDE cells and rows stay, so what is written packs to a small part of a byte a cell.
    """
    wide = -(-n // WIDE)
    strip, i = F.expr(f"id div {max(n, 1)}") * WIDE, F.col("id") % max(n, 1)
    first = strip if lower else F.greatest(strip, i + k)
    last = F.least(strip + (WIDE - 1), i + k if lower else F.lit(n - 1), F.lit(n - 1))
    pieces = spark.range(0, n * wide, 1, max(spark.sparkContext.defaultParallelism, n * n // CELLS)).select(i.alias("i"), first.alias("first"), last.alias("last"))
    return pieces.filter("first <= last").select("i", F.explode(F.sequence("first", "last")).alias("j"))


def diag_indices(spark, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"))


def tri(spark, rows: int, columns: int, k: int = 0) -> DataFrame:
    return indices(spark, (rows, columns)).withColumn("x", F.when(F.col("j") - F.col("i") <= k, 1.0).otherwise(0.0))


def geomspace(spark, start: float, stop: float, count: int) -> DataFrame:
    step = F.pow(F.lit(stop / start), F.lit(1.0 / (count - 1)))
    return spark.range(count).select(F.col("id").alias("pos"), F.when(F.col("id") == count - 1, F.lit(stop)).otherwise(F.lit(start) * F.pow(step, F.col("id"))).alias("x"))


def fftfreq(spark, n: int, d: float = 1.0) -> DataFrame:
    k = F.col("id")
    return spark.range(n).select(k.alias("pos"), (F.when(k < (n + 1) // 2, k).otherwise(k - n) / (n * d)).alias("x"))


def rfftfreq(spark, n: int, d: float = 1.0) -> DataFrame:
    return spark.range(n // 2 + 1).select(F.col("id").alias("pos"), (F.col("id") / (n * d)).alias("x"))


def full_like(frame: DataFrame, value: float, x: str = "x") -> DataFrame:
    """zeros_like, ones_like, empty_like and full_like: the same cells, one value."""
    return frame.withColumn(x, F.lit(value).cast(frame.schema[x].dataType))


# Products of rows.
def vecdot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def matvec(m: Column, v: Column) -> Column:
    """Matrix (array of rows) times vector."""
    return F.transform(m, lambda row: vecdot(row, v))


def vecmat(v: Column, m: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(F.get(m, F.lit(0))) - 1), lambda j: F.aggregate(F.zip_with(v, m, lambda x, row: x * F.get(row, j)), F.lit(0.0), lambda acc, x: acc + x))


def matrix_product(a: Column, b: Column) -> Column:
    """multi_dot is a fold of it."""
    return F.transform(a, lambda row: F.transform(F.sequence(F.lit(0), F.size(F.get(b, F.lit(0))) - 1), lambda j: F.aggregate(F.zip_with(row, b, lambda x, other: x * F.get(other, j)), F.lit(0.0), lambda acc, x: acc + x)))


def matrix_power(m: Column, power: int) -> Column:
    """By squaring; power is 1 or more."""
    step = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    if power == 1:
        return m
    half = step(matrix_power(m, power // 2), lambda h: matrix_product(h, h))
    return matrix_product(half, m) if power % 2 else half


def solve2(m: Column, b: Column) -> Column:
    """Two equations by Cramer's rule; NULL where the matrix is singular."""
    at = lambda i, j: F.get(F.get(m, F.lit(i)), F.lit(j))
    det = F.nullif(at(0, 0) * at(1, 1) - at(0, 1) * at(1, 0), F.lit(0.0))
    first, second = F.get(b, F.lit(0)), F.get(b, F.lit(1))
    found = F.array((first * at(1, 1) - at(0, 1) * second) / det, (at(0, 0) * second - first * at(1, 0)) / det)
    return F.when(det.isNotNull(), found)


def cross(a: Column, b: Column) -> Column:
    """Product of vectors of three numbers, or of two (then its third part, as one number in an array)."""
    at = lambda v, k: F.get(v, F.lit(k))
    turn = lambda i, j: at(a, i) * at(b, j) - at(a, j) * at(b, i)
    three = (F.size(a) == 3) & (F.size(b) == 3)
    return F.when(three, F.array(turn(1, 2), turn(2, 0), turn(0, 1))).when((F.size(a) == 2) & (F.size(b) == 2), F.array(turn(0, 1)))


def ediff1d(frame: DataFrame, order: Sequence[str], x: str, to_begin: Sequence[float] = (), to_end: Sequence[float] = ()) -> DataFrame:
    """(pos, x): differences of neighbours in an order over the whole frame, with numbers set before and after.

    Rows are numbered by ranges; each meets its neighbour by number.
    """
    numbered = with_positions(frame.select(*dict.fromkeys([*order, x])), list(order))
    now = numbered.select("pos", F.col(x).alias("a"))
    after = numbered.select((F.col("pos") - 1).alias("pos"), F.col(x).alias("b"))
    apart = now.join(after, "pos").select((F.col("pos") + len(to_begin)).alias("pos"), (F.col("b") - F.col("a")).cast("double").alias("x"))
    ends = [(k, float(v)) for k, v in enumerate(to_begin)]
    if to_end:
        last = max(frame.count() - 1, 0) + len(to_begin)
        ends += [(last + k, float(v)) for k, v in enumerate(to_end)]
    return apart.union(frame.sparkSession.createDataFrame(ends, "pos long, x double")) if ends else apart


def sort_complex(frame: DataFrame, z: str) -> DataFrame:
    """(pos, z) by real part, then by imaginary part."""
    split = frame.select(F.col(z).alias("z"), F.col(z)["re"].alias("re"), F.col(z)["im"].alias("im"))
    return with_positions(split, ["re", "im"]).select("pos", "z")
