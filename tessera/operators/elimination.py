"""Linear equations, inverses and determinants of a matrix in each row, of any size, by elimination with pivoting.

Matrices of one size in a batch are eliminated side by side: a step works on the same column of all of them. Matrices are
arrays of rows; a matrix that isn't square, or that holds NULL, gives NULL, and so does a singular one (a pivot of no more than
its rounding) where there is nothing to give.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def eliminate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Solutions of a x = b, signs and logarithms of determinants, and whether each matrix is singular.

    ``a`` is (matrices, n, n), ``b`` (matrices, n, sides). Gauss-Jordan steps with the largest pivot of each column.
    """
    a, b = a.astype(float).copy(), b.astype(float).copy()
    count, n, _ = a.shape
    every = np.arange(count)
    size = np.abs(a).max(axis=(1, 2), initial=0.0)
    sign, logarithm, singular = np.ones(count), np.zeros(count), np.zeros(count, dtype=bool)
    with np.errstate(all="ignore"):
        for k in range(n):
            best = k + np.abs(a[:, k:, k]).argmax(axis=1)
            sign = np.where(best != k, -sign, sign)
            for m in (a, b):
                top = m[:, k].copy()
                m[:, k] = m[every, best]
                m[every, best] = top
            pivot = a[:, k, k].copy()
            singular |= ~(np.abs(pivot) > n * np.finfo(float).eps * size)
            sign *= np.sign(pivot)
            logarithm += np.log(np.abs(pivot))
            a[:, k] /= pivot[:, None]
            b[:, k] /= pivot[:, None]
            factor = a[:, :, k].copy()
            factor[:, k] = 0
            a -= factor[:, :, None] * a[:, None, k]
            b -= factor[:, :, None] * b[:, None, k]
    return b, np.where(singular, 0.0, sign), np.where(singular, -np.inf, logarithm), singular


def _applied(frame: DataFrame, matrix: str, side: str | None, kinds: dict[str, str], finish) -> DataFrame:
    """``frame`` with columns that ``finish`` makes from what elimination gives for the batch's matrices of one size."""
    names = [n for n in frame.columns if n not in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrices = batch.column("__m").to_pylist()
            sides = batch.column("__s").to_pylist() if side else [None] * len(matrices)
            made: dict[str, list] = {n: [None] * len(matrices) for n in kinds}
            sizes: dict[int, list[int]] = {}
            for i, (m, s) in enumerate(zip(matrices, sides)):
                n = len(m) if m is not None else 0
                whole = m is not None and all(r is not None and len(r) == n and None not in r for r in m)
                if whole and (side is None or s is not None and len(s) == n and None not in s):
                    sizes.setdefault(n, []).append(i)
            for n, at in sizes.items():
                a = np.array([matrices[i] for i in at], dtype=float).reshape(len(at), n, n)
                b = np.array([sides[i] for i in at], dtype=float)[:, :, None] if side else np.broadcast_to(np.eye(n), a.shape)
                for name, values in finish(*eliminate(a, b)).items():
                    for i, v in zip(at, values):
                        made[name][i] = v
            yield pa.RecordBatch.from_arrays([*(batch.column(f"__c{i}") for i in range(len(names))), *(pa.array(made[n], TYPES[k]) for n, k in kinds.items())], names=[*names, *kinds])

    given = [F.col(f"`{n}`").alias(f"__c{i}") for i, n in enumerate(names)] + [F.col(f"`{matrix}`").cast("array<array<double>>").alias("__m")]
    given += [F.col(f"`{side}`").cast("array<double>").alias("__s")] if side else []
    schema = ", ".join([*(f"`{n}` {frame.schema[n].dataType.simpleString()}" for n in names), *(f"`{n}` {k}" for n, k in kinds.items())])
    return frame.select(*given).mapInArrow(run, schema)


TYPES = {"double": pa.float64(), "array<double>": pa.list_(pa.float64()), "array<array<double>>": pa.list_(pa.list_(pa.float64()))}


def solve(frame: DataFrame, matrix: str, side: str, out: str = "x") -> DataFrame:
    """``frame`` with the solution of each row's equations; NULL where the matrix is singular."""
    finish = lambda x, sign, log, singular: {out: [None if s else v[:, 0].tolist() for v, s in zip(x, singular)]}
    return _applied(frame, matrix, side, {out: "array<double>"}, finish)


def inv(frame: DataFrame, matrix: str, out: str = "inverse") -> DataFrame:
    """``frame`` with each row's inverse; NULL where the matrix is singular."""
    finish = lambda x, sign, log, singular: {out: [None if s else v.tolist() for v, s in zip(x, singular)]}
    return _applied(frame, matrix, None, {out: "array<array<double>>"}, finish)


def slogdet(frame: DataFrame, matrix: str, sign: str = "sign", logarithm: str = "logabsdet") -> DataFrame:
    """``frame`` with the sign of each row's determinant and the logarithm of its size: 0 and -inf of a singular matrix."""
    return _applied(frame, matrix, None, {sign: "double", logarithm: "double"}, lambda x, s, log, singular: {sign: s.tolist(), logarithm: log.tolist()})


def det(frame: DataFrame, matrix: str, out: str = "det") -> DataFrame:
    return _applied(frame, matrix, None, {out: "double"}, lambda x, s, log, singular: {out: np.where(singular, 0.0, s * np.exp(log)).tolist()})
