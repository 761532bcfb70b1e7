"""Running folds over a whole frame or over keys of any size, by an associative scan in two levels.

Rows are dealt into ranges of (keys, order). First every range is folded to one element; these, one row a range, are scanned
on the driver, so that each range knows what comes before it; then ranges are scanned by themselves from there. No task sees
more than its range: a key that holds most rows is split like a whole frame is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Fold:
    """An associative operation on tuples of columns; ``whole`` where it works on integers. ``start`` is its neutral element."""

    combine: Callable[[tuple, tuple], tuple]
    start: tuple
    whole: bool = False


FOLDS = {
    "add": Fold(lambda a, b: (a[0] + b[0],), (0.0,)),
    "multiply": Fold(lambda a, b: (a[0] * b[0],), (1.0,)),
    "maximum": Fold(lambda a, b: (np.maximum(a[0], b[0]),), (-np.inf,)),
    "minimum": Fold(lambda a, b: (np.minimum(a[0], b[0]),), (np.inf,)),
    "logaddexp": Fold(lambda a, b: (np.logaddexp(a[0], b[0]),), (-np.inf,)),
    "add_integer": Fold(lambda a, b: (a[0] + b[0],), (0,), True),
    "maximum_integer": Fold(lambda a, b: (np.maximum(a[0], b[0]),), (-(1 << 63),), True),
    "minimum_integer": Fold(lambda a, b: (np.minimum(a[0], b[0]),), ((1 << 63) - 1,), True),
    "bitwise_and": Fold(lambda a, b: (a[0] & b[0],), (-1,), True),
    "bitwise_or": Fold(lambda a, b: (a[0] | b[0],), (0,), True),
    "bitwise_xor": Fold(lambda a, b: (a[0] ^ b[0],), (0,), True),
    # h -> a * h + b: what comes later is applied to what came before.
    "affine": Fold(lambda f, g: (g[0] * f[0], g[0] * f[1] + g[1]), (1.0, 0.0)),
}


def _segmented(fold: Fold, columns: list[np.ndarray], starts: np.ndarray) -> list[np.ndarray]:
    """Inclusive scan by doubling distances; a true start begins anew."""
    columns, begun, step = [c.copy() for c in columns], starts.copy(), 1
    with np.errstate(all="ignore"):
        while step < len(begun):
            joined = fold.combine(tuple(c[:-step] for c in columns), tuple(c[step:] for c in columns))
            columns = [np.concatenate([c[:step], np.where(begun[step:], c[step:], j)]) for c, j in zip(columns, joined)]
            begun = np.concatenate([begun[:step], begun[step:] | begun[:-step]])
            step *= 2
    return columns


def _changes(batch: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """Whether a row's key differs from the row's before it; false for the first."""
    changed = np.zeros(batch.num_rows, dtype=bool)
    for name in keys:
        column = batch.column(name)
        now, before = column.slice(1), column.slice(0, max(len(column) - 1, 0))
        differs = pc.fill_null(pc.not_equal(now, before), False).to_numpy(zero_copy_only=False) | (pc.is_null(now).to_numpy(zero_copy_only=False) != pc.is_null(before).to_numpy(zero_copy_only=False))
        changed[1:] |= differs
    return changed


def scan(frame: DataFrame, operation: str, columns: Sequence[Column], order: Sequence[str], keys: Sequence[str] = (), out: str = "y") -> DataFrame:
    """``frame`` with the running fold of ``columns`` (one; two of ``affine``: h = a * h + b from h = 0) in an order, anew for each key.

    Rows that agree in keys and order count in any order. A NULL element changes nothing. An empty frame gives an empty one.
    """
    fold = FOLDS[operation]
    kind, array = ("long", np.int64) if fold.whole else ("double", np.float64)
    kept = [n for n in frame.columns if n != out]
    parts = [f"__e{i}" for i in range(len(columns))]
    tests = [f"__k{i}" for i in range(len(keys))]
    orders = [f"__o{i}" for i in range(len(order))]
    quoted = lambda names: [F.col(f"`{n}`") for n in names]
    numbered = [f"__c{i}" for i in range(len(kept))]  # mapInArrow can't take dotted names
    given = frame.select(
        *[c.alias(n) for c, n in zip(quoted(kept), numbered)],
        *[F.coalesce(c.cast(kind), F.lit(s).cast(kind)).alias(p) for c, s, p in zip(columns, fold.start, parts)],
        *[c.alias(t) for c, t in zip(quoted(keys), tests)],
        *[c.alias(o) for c, o in zip(quoted(order), orders)],
    )
    by = [*tests, *orders]
    ranged = given.repartitionByRange(*by).withColumn("__range", F.spark_partition_id()).persist()
    sorted_ = ranged.sortWithinPartitions(*by)

    def scanned(batches: Iterator[pa.RecordBatch], begin: Callable[[int], tuple]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
        state, last = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = _changes(batch, tests)
            if last is not None:
                edge = pa.RecordBatch.from_arrays([pa.concat_arrays([last.column(t), batch.column(t).slice(0, 1)]) for t in tests], names=tests) if tests else None
                starts[0] = bool(_changes(edge, tests)[1]) if tests else False
            else:
                state = begin(batch.column("__range")[0].as_py())
            values = [batch.column(p).to_numpy(zero_copy_only=False).astype(array) for p in parts]
            with np.errstate(all="ignore"):
                first = tuple(v[0] for v in values) if starts[0] else fold.combine(state, tuple(v[:1] for v in values))
            for v, f in zip(values, first):
                v[0] = f if np.ndim(f) == 0 else f[0]
            result = _segmented(fold, values, starts)
            state = tuple(r[-1:] for r in result)
            last = batch.slice(batch.num_rows - 1, 1)
            yield batch, result

    def neutral(_: int) -> tuple:
        return tuple(np.array([s], dtype=array) for s in fold.start)

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = end = None
        for batch, result in scanned(batches, neutral):
            first = first if first is not None else batch.slice(0, 1)
            end = (batch.slice(batch.num_rows - 1, 1), [r[-1:] for r in result])
        if end:
            names = ["__range", *[f"{t}_first" for t in tests], *[f"{t}_last" for t in tests], *parts]
            arrays = [end[0].column("__range"), *(first.column(t) for t in tests), *(end[0].column(t) for t in tests), *(pa.array(r) for r in end[1])]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    key_types = [given.schema[t].dataType for t in tests]
    fields = [T.StructField("__range", T.IntegerType())] + [T.StructField(f"{t}_{s}", k) for s in ("first", "last") for t, k in zip(tests, key_types)]
    fields += [T.StructField(p, T.LongType() if fold.whole else T.DoubleType()) for p in parts]
    totals = sorted(sorted_.mapInArrow(folded, T.StructType(fields)).collect(), key=lambda r: r["__range"])
    carried, state, last = {}, tuple(fold.start), None
    for row in totals:
        begins, ends = tuple(row[f"{t}_first"] for t in tests), tuple(row[f"{t}_last"] for t in tests)
        state = state if last is None or begins == last else tuple(fold.start)
        carried[row["__range"]] = state
        own = tuple(np.array([row[p]], dtype=array) for p in parts)
        with np.errstate(all="ignore"):
            # A range of several keys ends with a fold that began inside it.
            joined = own if begins != ends else fold.combine(tuple(np.array([s], dtype=array) for s in state), own)
        state, last = tuple(j[0].item() for j in joined), ends

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin = lambda r: tuple(np.array([s], dtype=array) for s in carried.get(r, fold.start))
        for batch, result in scanned(batches, begin):
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in numbered), pa.array(result[-1])], names=[*kept, out])

    schema = T.StructType([frame.schema[n] for n in kept] + [T.StructField(out, T.LongType() if fold.whole else T.DoubleType())])
    return sorted_.mapInArrow(applied, schema)
