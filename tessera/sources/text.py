"""Delimited text as row vectors, and ranges as vector frames."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.window import with_positions


def load_text(spark: SparkSession, path: str, delimiter: str | None = None, comment: str = "#", missing: float = float("nan")) -> DataFrame:
    """One row a line: ``v`` is its numbers; what follows ``comment`` is left out, empty fields are ``missing``."""
    line = F.trim(F.substring_index(F.col("value"), comment, 1)) if comment else F.trim("value")
    fields = F.split(line, r"\s+" if delimiter is None else "\\Q" + delimiter + "\\E", -1)
    numbers = F.transform(fields, lambda f: F.when(F.trim(f) == "", F.lit(missing)).otherwise(F.trim(f).try_cast("double")))
    return spark.read.text(path).filter(line != "").select(numbers.alias("v"))


def save_text(frame: DataFrame, path: str, vector: str = "v", delimiter: str = " ") -> None:
    frame.select(F.array_join(F.transform(vector, lambda x: x.cast("string")), delimiter).alias("value")).write.text(path)


def arange(spark: SparkSession, start: float, stop: float, step: float = 1.0) -> DataFrame:
    """(pos, x) from start in steps, before stop; positions are made in parallel."""
    size = max(0, math.ceil((stop - start) / step))
    return spark.range(size).select(F.col("id").alias("pos"), (F.lit(float(start)) + F.col("id") * float(step)).alias("x"))


def linspace(spark: SparkSession, start: float, stop: float, num: int = 50, endpoint: bool = True) -> DataFrame:
    parts = num - 1 if endpoint else num
    step = (stop - start) / parts if parts else 0.0
    x = F.when(F.lit(endpoint) & (F.col("id") == num - 1) & (F.lit(num) > 1), F.lit(float(stop))).otherwise(F.lit(float(start)) + F.col("id") * step)
    return spark.range(num).select(F.col("id").alias("pos"), x.alias("x"))


def logspace(spark: SparkSession, start: float, stop: float, num: int = 50, base: float = 10.0) -> DataFrame:
    return linspace(spark, start, stop, num).select("pos", F.pow(F.lit(float(base)), "x").alias("x"))


def eye(spark: SparkSession, n: int, k: int = 0) -> DataFrame:
    """Coordinates of the identity matrix; missing cells are 0."""
    return spark.range(n).select(F.col("id").alias("i"), (F.col("id") + k).alias("j"), F.lit(1.0).alias("x")).filter((F.col("j") >= 0) & (F.col("j") < n))


def full(spark: SparkSession, shape: tuple[int, int], value: float) -> DataFrame:
    rows, columns = shape
    return spark.range(rows * columns).select(F.expr(f"id div {columns}").alias("i"), F.expr(f"id % {columns}").alias("j"), F.lit(value).alias("x"))


def fromfunction(spark: SparkSession, function: Callable[..., Column], shape: Sequence[int]) -> DataFrame:
    """(i0, i1, ..., x): an expression of the places of a grid, made in parallel."""
    size, names = math.prod(shape), [f"i{k}" for k in range(len(shape))]
    steps = [math.prod(shape[k + 1 :]) for k in range(len(shape))]
    places = spark.range(size).select(*[F.expr(f"id div {step} % {count}").alias(n) for n, step, count in zip(names, steps, shape)])
    return places.withColumn("x", function(*[F.col(n) for n in names]))


def zeros(spark: SparkSession, shape: Sequence[int]) -> DataFrame:
    return fromfunction(spark, lambda *_: F.lit(0.0), shape)


def ones(spark: SparkSession, shape: Sequence[int]) -> DataFrame:
    return fromfunction(spark, lambda *_: F.lit(1.0), shape)


def empty(spark: SparkSession, shape: Sequence[int]) -> DataFrame:
    """Places without values: NULL."""
    return fromfunction(spark, lambda *_: F.lit(None).cast("double"), shape)


def mgrid(spark: SparkSession, axes: Sequence[tuple[float, float, float]]) -> DataFrame:
    """(i0, i1, ..., x0, x1, ...): coordinates of the points of a grid; axes are (start, stop, step)."""
    places = fromfunction(spark, lambda *_: F.lit(0), [max(0, math.ceil((stop - start) / step)) for start, stop, step in axes]).drop("x")
    return places.select("*", *[(F.lit(float(start)) + F.col(f"i{k}") * float(step)).alias(f"x{k}") for k, (start, _, step) in enumerate(axes)])


def ix_(frame: DataFrame, positions: Sequence[str], chosen: Sequence[DataFrame]) -> DataFrame:
    """Cells at the products of chosen places, one one-column frame of distinct places an axis: a join an axis, no product is made.

    Cells come back with their place among the chosen ones, which are taken in ascending order.
    """
    for name, places in zip(positions, chosen):
        numbered = with_positions(places.select(F.col(places.columns[0]).alias(name)), [name], "__new")
        frame = frame.join(numbered, name).drop(name).withColumnRenamed("__new", name)
    return frame


def fromregex(spark: SparkSession, path: str, pattern: str, fields: Sequence[tuple[str, str]]) -> DataFrame:
    """A row for each match within a line, its groups as columns of the (name, type) given; what isn't of the type is NULL."""
    found = spark.read.text(path).select(F.explode(F.regexp_extract_all("value", F.lit(pattern), 0)).alias("__m"))
    return found.select(*[F.regexp_extract("__m", pattern, k + 1).try_cast(kind).alias(name) for k, (name, kind) in enumerate(fields)])
