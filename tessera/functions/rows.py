"""Kernels on row vectors (array columns) as expressions: nothing leaves the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column, order: float = 2) -> Column:
    if order == float("inf"):
        return F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    return F.pow(_sum(F.transform(v, lambda x: F.pow(F.abs(x.cast("double")), F.lit(float(order))))), F.lit(1.0 / order))


def axpy(alpha: float, x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a.cast("double") * alpha + b.cast("double"))


def row_logsumexp(v: Column) -> Column:
    top = F.array_max(v).cast("double")
    return top + F.log(_sum(F.transform(v, lambda x: F.exp(x.cast("double") - top))))


def softmax(v: Column) -> Column:
    total = row_logsumexp(v)
    return F.transform(v, lambda x: F.exp(x.cast("double") - total))


def cross(a: Column, b: Column) -> Column:
    at = lambda v, i: F.get(v, F.lit(i)).cast("double")
    return F.array(*[at(a, i) * at(b, j) - at(a, j) * at(b, i) for i, j in ((1, 2), (2, 0), (0, 1))])


def argmax(v: Column) -> Column:
    return F.array_position(v, F.array_max(v)) - 1


def vander(x: Column, n: int) -> Column:
    return F.array(*[F.pow(x.cast("double"), F.lit(float(n - 1 - k))) for k in range(n)])


def sliding_window_view(v: Column, width: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(v) - width + 1), lambda i: F.slice(v, i, F.lit(width)))


def packbits(bits: Column) -> Column:
    """Bytes of 8 bits each, first bit highest, as numbers; the last byte is filled up with zeros."""
    byte = lambda i: F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0), lambda acc, k: acc * 2 + F.coalesce(F.get(bits, i * 8 + k), F.lit(0)).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(bits) / 8).cast("int") - 1), byte)


def unpackbits(bytes_: Column) -> Column:
    return F.flatten(F.transform(bytes_, lambda b: F.transform(F.sequence(F.lit(7), F.lit(0), F.lit(-1)), lambda k: (F.floor(b / F.pow(F.lit(2.0), k)) % 2).cast("int"))))


def binary_repr(x: Column, width: int) -> Column:
    """Two's complement in ``width`` bits."""
    whole = F.when(x < 0, x + 2**width).otherwise(x).cast("bigint")
    return F.lpad(F.bin(whole), width, "0")


def base_repr(x: Column, base: int) -> Column:
    sign = F.when(x < 0, "-").otherwise("")
    return F.concat(sign, F.upper(F.conv(F.abs(x).cast("string"), 10, base)))


def gather(frame: DataFrame, key: str, wanted: DataFrame, index: str) -> DataFrame:
    """Rows of an embedding table by id, as often as asked for."""
    return wanted.join(frame, wanted[index] == frame[key])


def scatter_add(updates: DataFrame, key: str, vector: str, out: str = "v") -> DataFrame:
    """Sum of the vectors of each id: one row an element before the shuffle, summed in part in each task."""
    cells = updates.select(key, F.posexplode(vector).alias("__j", "__x")).groupBy(key, "__j").agg(F.sum(F.col("__x").cast("double")).alias("__x"))
    rows = cells.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__j", "__x"))).alias("__cells"))
    return rows.select(key, F.transform("__cells", lambda c: c["__x"]).alias(out))


def matmul_rows(frame: DataFrame, vector: str, matrix: Sequence[Sequence[float]], out: str = "y") -> DataFrame:
    """Each row vector times a small constant matrix, in one projection."""
    columns = [F.array(*[F.lit(float(row[j])) for row in matrix]) for j in range(len(matrix[0]))]
    return frame.withColumn(out, F.array(*[dot(F.col(vector), c) for c in columns]))
