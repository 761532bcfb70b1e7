"""Window shapes, phase unwrapping, and limits of the number types."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

#: Coefficients of the cosine terms.
COSINES = {"hanning": (0.5, -0.5), "hamming": (0.54, -0.46), "blackman": (0.42, -0.5, 0.08)}


def shape(spark: SparkSession, name: str, n: int) -> DataFrame:
    """(pos, x) of a window of n points: hanning, hamming, blackman or bartlett."""
    pos = F.col("id")
    if n == 1:
        x = F.lit(1.0)
    elif name == "bartlett":
        x = 1 - F.abs(2.0 * pos / (n - 1) - 1)
    else:
        x = sum(F.cos(pos * (2 * math.pi * k / (n - 1))) * c for k, c in enumerate(COSINES[name]))
    return spark.range(n).select(pos.alias("pos"), x.alias("x"))


def unwrap(x: Column, over: WindowSpec, period: float = 2 * math.pi) -> Column:
    """Phases without jumps of more than half a period along an order."""
    jump = x - F.lag(x).over(over)
    wrapped = jump + period / 2 - F.floor((jump + period / 2) / period) * period - period / 2
    wrapped = F.when((wrapped == -period / 2) & (jump > 0), period / 2).otherwise(wrapped)
    # Nested windows need the correction as a column of its own; callers add its running sum to x.
    return F.when(F.abs(jump) < period / 2, 0.0).otherwise(F.coalesce(wrapped - jump, F.lit(0.0)))


LIMITS = {
    "int8": (-(2**7), 2**7 - 1), "int16": (-(2**15), 2**15 - 1), "int32": (-(2**31), 2**31 - 1), "int64": (-(2**63), 2**63 - 1),
    "uint8": (0, 2**8 - 1), "uint16": (0, 2**16 - 1), "uint32": (0, 2**32 - 1), "uint64": (0, 2**64 - 1),
}


def iinfo(dtype: str) -> dict[str, int]:
    low, high = LIMITS[dtype]
    return {"bits": (high - low).bit_length(), "min": low, "max": high}


def finfo(dtype: str) -> dict[str, float]:
    bits = {"float32": (23, 8), "float64": (52, 11)}[dtype]
    eps, most = 2.0 ** -bits[0], 2 ** (bits[1] - 1)
    return {"eps": eps, "max": (2 - eps) * 2.0 ** (most - 1), "tiny": 2.0 ** (2 - most), "nmant": bits[0]}
