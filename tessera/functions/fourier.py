"""Discrete Fourier transforms of row vectors: one and more axes, real and Hermitian forms, three norms.

A row is one vector, or one array in row-major order with its shape; numbers are doubles or (re, im) structs. Rows of one
length in a batch go through one call on views of the Arrow buffers, so rows are neither boxed nor gathered.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.functions.dense import COMPLEX, VECTOR

#: Transforms over one axis, the last two and all; those after the bar give real numbers.
ONE = ("fft", "ifft", "rfft", "ihfft", "irfft", "hfft")
MANY = ("fft2", "ifft2", "rfft2", "irfft2", "fftn", "ifftn", "rfftn", "irfftn")
REAL = ("irfft", "hfft", "irfft2", "irfftn")
NORMS = ("backward", "ortho", "forward")


def transform(frame: DataFrame, name: str, value: str, shape: Sequence[int] | None = None, norm: str = "backward", out: str = "y") -> DataFrame:
    """``frame`` with the transform of each row's array; for REAL ones of many axes, ``shape`` is that of the result.

    NULL gives NULL, and so does an empty vector; a NULL element counts as NaN. A row whose length doesn't fit the shape is an error.
    """
    if name not in ONE + MANY or norm not in NORMS:
        raise ValueError(f"unknown transform or norm: {name}, {norm}")
    if name in MANY and not shape:
        raise ValueError(f"{name} needs a shape")
    kept = [c for c in frame.columns if c != out]
    schema = T.StructType([frame.schema[c] for c in kept] + [T.StructField(out, VECTOR if name in REAL else COMPLEX)])
    function = getattr(np.fft, name)
    axes = (-2, -1) if name.endswith("2") else tuple(range(-len(shape or ()), 0))

    def call(x: np.ndarray) -> np.ndarray:
        if name in ONE:
            return function(x, axis=1, norm=norm)
        given = (*shape[:-1], shape[-1] // 2 + 1) if name in REAL else tuple(shape)
        if x.shape[1] != math.prod(given):
            raise ValueError(f"{x.shape[1]} elements are no array of shape {given}")
        extra = {"s": [shape[a] for a in axes]} if name in REAL else {}
        return function(x.reshape(len(x), *given), axes=axes, norm=norm, **extra).reshape(len(x), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), by_length(batch.column(value), call)], names=[*kept, out])

    return frame.mapInArrow(run, schema)


def _numbers(flat: pa.Array) -> np.ndarray:
    if pa.types.is_struct(flat.type):
        re, im = (pc.cast(pc.struct_field(flat, n), pa.float64()).to_numpy(zero_copy_only=False) for n in ("re", "im"))
        return re + 1j * im
    return pc.cast(flat, pa.float64()).to_numpy(zero_copy_only=False)


def by_length(column: pa.Array, call: Callable[[np.ndarray], np.ndarray]) -> pa.Array:
    """Lists of ``call`` over (rows, length) arrays of the lists of one length each, in the order of the column."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    flat, begins = _numbers(column.flatten()), np.cumsum(lengths) - lengths
    parts, sizes, order = [], [], []
    for length in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == length)
        got = call(flat[begins[rows][:, None] + np.arange(length)])
        parts.append(got.ravel())
        sizes += [got.shape[1]] * len(rows)
        order.append(rows)
    whole = np.concatenate(parts) if parts else np.zeros(0)
    values = pa.StructArray.from_arrays([pa.array(whole.real), pa.array(whole.imag)], names=["re", "im"]) if np.iscomplexobj(whole) else pa.array(whole)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)
    place = np.full(len(lengths), -1)
    if order:
        place[np.concatenate(order)] = np.arange(len(sizes))
    return lists.take(pa.array(place, mask=place < 0))
