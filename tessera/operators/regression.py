"""Least squares from moments: one pass of sums, and a small system solved on the driver."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gram(frame: DataFrame, columns: Sequence[str], target: str | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Products of the columns with each other and with the target: k * (k + 3) / 2 sums, whatever the rows."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    sums = [F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"g{i}_{j}") for i, j in pairs]
    sums += [F.sum(F.col(c) * F.col(target)).alias(f"t{i}") for i, c in enumerate(columns)] if target else []
    row = frame.agg(*sums).first()
    out = np.zeros((len(columns), len(columns)))
    for i, j in pairs:
        out[i, j] = out[j, i] = row[f"g{i}_{j}"] or 0.0
    return out, np.array([row[f"t{i}"] or 0.0 for i in range(len(columns))]) if target else None


def lstsq(frame: DataFrame, columns: Sequence[str], target: str) -> np.ndarray:
    """Coefficients that minimise the squared error of the columns' combination; the least norm where many do."""
    a, b = gram(frame, columns, target)
    return np.linalg.lstsq(a, b, rcond=None)[0]


def polyfit(frame: DataFrame, x: str, y: str, degree: int) -> np.ndarray:
    """Coefficients, lowest degree first. The variable is centred and scaled while fitting."""
    low, high = frame.agg(F.min(x), F.max(x)).first()
    middle, half = (low + high) / 2, (high - low) / 2 or 1.0
    powers = frame.select(*[F.pow((F.col(x) - middle) / half, F.lit(float(k))).alias(f"p{k}") for k in range(degree + 1)], F.col(y).alias("__y"))
    scaled = lstsq(powers, [f"p{k}" for k in range(degree + 1)], "__y")
    return np.polynomial.Polynomial(scaled, domain=[low, high]).convert().coef
