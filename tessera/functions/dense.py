"""Dense kernels on row vectors and small matrices: numpy on Arrow batches, one column in, one out.

These are what Spark has no expression for. A row is one vector (or one matrix in row-major order with its width), so
work is split by rows and nothing is gathered; rows of one batch and length go through one numpy call.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

VECTOR = T.ArrayType(T.DoubleType())
COMPLEX = T.ArrayType(T.StructType([T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())]))
_ARROW = {"vector": pa.list_(pa.float64()), "complex": pa.list_(pa.struct([("re", pa.float64()), ("im", pa.float64())])), "scalar": pa.float64()}
_SPARK = {"vector": VECTOR, "complex": COMPLEX, "scalar": T.DoubleType()}


def apply_rows(frame: DataFrame, value: str, kernel: Callable[[np.ndarray], np.ndarray], kind: str = "vector", out: str = "y") -> DataFrame:
    """``frame`` with ``kernel`` of each row's vector; kernels take (rows, length) arrays. NULL gives NULL."""
    kept = [c for c in frame.columns if c != out]
    schema = T.StructType([frame.schema[c] for c in kept] + [T.StructField(out, _SPARK[kind])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(value).to_pylist()
            results: list = [None] * len(vectors)
            by_length: dict[int, list[int]] = {}
            for i, v in enumerate(vectors):
                if v is not None:
                    by_length.setdefault(len(v), []).append(i)
            for rows in by_length.values():
                got = kernel(np.array([vectors[i] for i in rows], dtype=np.float64))
                for i, y in zip(rows, got):
                    results[i] = [{"re": z.real, "im": z.imag} for z in y] if kind == "complex" else y.tolist() if kind == "vector" else float(y)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(results, _ARROW[kind])], names=[*kept, out])

    return frame.mapInArrow(run, schema)


def _square(v: np.ndarray) -> np.ndarray:
    n = round(v.shape[1] ** 0.5)
    return v.reshape(len(v), n, n)


def _flat(m: np.ndarray) -> np.ndarray:
    return m.reshape(len(m), -1)


#: name -> (kernel over (rows, length) arrays, kind of result). Matrices are square, row-major.
KERNELS: dict[str, tuple[Callable[[np.ndarray], np.ndarray], str]] = {
    "fft": (lambda v: np.fft.fft(v, axis=1), "complex"),
    "ifft": (lambda v: np.fft.ifft(v, axis=1), "complex"),
    "rfft": (lambda v: np.fft.rfft(v, axis=1), "complex"),
    "fftshift": (lambda v: np.fft.fftshift(v, axes=1), "vector"),
    "ifftshift": (lambda v: np.fft.ifftshift(v, axes=1), "vector"),
    "power_spectrum": (lambda v: np.abs(np.fft.rfft(v, axis=1)) ** 2, "vector"),
    "det": (lambda v: np.linalg.det(_square(v)), "scalar"),
    "inv": (lambda v: _flat(np.linalg.inv(_square(v))), "vector"),
    "pinv": (lambda v: _flat(np.linalg.pinv(_square(v))), "vector"),
    "cholesky": (lambda v: _flat(np.linalg.cholesky(_square(v))), "vector"),
    "eigvalsh": (lambda v: np.linalg.eigvalsh(_square(v)), "vector"),
    "eigvals": (lambda v: np.linalg.eigvals(_square(v)).astype(complex), "complex"),
    "svdvals": (lambda v: np.linalg.svd(_square(v), compute_uv=False), "vector"),
    "matrix_rank": (lambda v: np.linalg.matrix_rank(_square(v)).astype(float), "scalar"),
    "matrix_norm": (lambda v: np.linalg.norm(_square(v), axis=(1, 2)), "scalar"),
    "cond": (lambda v: np.linalg.cond(_square(v)), "scalar"),
    "slogdet": (lambda v: np.linalg.slogdet(_square(v))[1], "scalar"),
    # Factors one after another, each row-major: Q, R; eigenvalues, vectors; U, singular values, V transposed.
    "qr": (lambda v: np.concatenate([_flat(m) for m in np.linalg.qr(_square(v))], axis=1), "vector"),
    "eigh": (lambda v: np.concatenate([_flat(m) for m in np.linalg.eigh(_square(v))], axis=1), "vector"),
    "eig": (lambda v: np.concatenate([_flat(m).astype(complex) for m in np.linalg.eig(_square(v))], axis=1), "complex"),
    "svd": (lambda v: np.concatenate([_flat(m) for m in np.linalg.svd(_square(v))], axis=1), "vector"),
    "norm_fro": (lambda v: np.linalg.norm(_square(v), "fro", axis=(1, 2)), "scalar"),
    "norm_nuc": (lambda v: np.linalg.norm(_square(v), "nuc", axis=(1, 2)), "scalar"),
    "norm_2": (lambda v: np.linalg.norm(_square(v), 2, axis=(1, 2)), "scalar"),
    "norm_-2": (lambda v: np.linalg.norm(_square(v), -2, axis=(1, 2)), "scalar"),
    "norm_1": (lambda v: np.linalg.norm(_square(v), 1, axis=(1, 2)), "scalar"),
    "norm_-1": (lambda v: np.linalg.norm(_square(v), -1, axis=(1, 2)), "scalar"),
    "norm_inf": (lambda v: np.linalg.norm(_square(v), np.inf, axis=(1, 2)), "scalar"),
    "norm_-inf": (lambda v: np.linalg.norm(_square(v), -np.inf, axis=(1, 2)), "scalar"),
    "slogdet_sign": (lambda v: np.linalg.slogdet(_square(v))[0], "scalar"),
    "vector_norm": (lambda v: np.linalg.norm(v, axis=1), "scalar"),
    "sort": (lambda v: np.sort(v, axis=1), "vector"),
    "argsort": (lambda v: np.argsort(v, axis=1, kind="stable").astype(float), "vector"),
    "cumsum": (lambda v: np.cumsum(v, axis=1), "vector"),
    "polyroots": (lambda v: np.array([np.polynomial.polynomial.polyroots(r).astype(complex) for r in v]), "complex"),
    "chebroots": (lambda v: np.array([np.polynomial.chebyshev.chebroots(r).astype(complex) for r in v]), "complex"),
    "poly2cheb": (lambda v: np.array([np.polynomial.chebyshev.poly2cheb(r) for r in v]), "vector"),
    "poly2herm": (lambda v: np.array([np.polynomial.hermite.poly2herm(r) for r in v]), "vector"),
    "poly2leg": (lambda v: np.array([np.polynomial.legendre.poly2leg(r) for r in v]), "vector"),
    "poly2lag": (lambda v: np.array([np.polynomial.laguerre.poly2lag(r) for r in v]), "vector"),
    "polyder": (lambda v: np.polynomial.polynomial.polyder(v.T).T, "vector"),
    "polyint": (lambda v: np.polynomial.polynomial.polyint(v.T).T, "vector"),
}


def kernel(frame: DataFrame, name: str, value: str, out: str = "y") -> DataFrame:
    """A kernel by name: transforms, decompositions, roots and changes of basis of each row's vector or matrix."""
    function, kind = KERNELS[name]
    return apply_rows(frame, value, function, kind, out)


def random_rows(frame: DataFrame, key: str, distribution: str, seed: int, *args: float, out: str = "y") -> DataFrame:
    """One draw for each row by numpy's generator of (seed, key): the same in every run, however rows are split."""
    schema = T.StructType([*frame.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = [float(getattr(np.random.default_rng([seed, int(k) & (1 << 63) - 1]), distribution)(*args)) for k in batch.column(key).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(drawn, pa.float64())], names=[*batch.schema.names, out])

    return frame.mapInArrow(run, schema)
