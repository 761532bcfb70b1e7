"""Complex numbers as struct<re, im>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def make(re: Column, im: Column) -> Column:
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def real(z: Column) -> Column:
    return z["re"]


def imag(z: Column) -> Column:
    return z["im"]


def conj(z: Column) -> Column:
    return make(z["re"], -z["im"])


def absolute(z: Column) -> Column:
    return F.hypot(z["re"], z["im"])


def angle(z: Column, deg: bool = False) -> Column:
    radians = F.atan2(z["im"], z["re"])
    return F.degrees(radians) if deg else radians


def add(a: Column, b: Column) -> Column:
    return make(a["re"] + b["re"], a["im"] + b["im"])


def multiply(a: Column, b: Column) -> Column:
    return make(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def divide(a: Column, b: Column) -> Column:
    size = F.nullif(b["re"] * b["re"] + b["im"] * b["im"], F.lit(0.0))
    top = multiply(a, conj(b))
    return make(F.coalesce(top["re"] / size, F.lit(float("nan"))), F.coalesce(top["im"] / size, F.lit(float("nan"))))


def exp(z: Column) -> Column:
    return make(F.exp(z["re"]) * F.cos(z["im"]), F.exp(z["re"]) * F.sin(z["im"]))


def log(z: Column) -> Column:
    return make(F.log(absolute(z)), angle(z))


def sqrt_signed(x: Column) -> Column:
    """Square root of a real number, imaginary for negative ones."""
    root = F.sqrt(F.abs(x.cast("double")))
    return make(F.when(x < 0, 0.0).otherwise(root), F.when(x < 0, root).otherwise(0.0))
