"""Sums of long vectors, one from each task, in slots that executors add up: the driver gets one vector whatever the number of tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLOTS = 512
KIND = "slot int, x binary, n long"


def slots_of(sums: dict[int, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x, _ in sums.values()], pa.binary()), pa.array([n for _, n in sums.values()], pa.int64())],
        names=["slot", "x", "n"],
    )


def cut(vector: np.ndarray, n: int) -> pa.RecordBatch:
    """A vector, which stands for ``n`` rows, as rows of KIND."""
    return slots_of({k: [x, n] for k, x in enumerate(np.array_split(vector.astype(np.float64), SLOTS))})


def summed(parts: DataFrame) -> tuple[np.ndarray, int]:
    """The sum of all vectors that were cut into ``parts``, and of what they stand for; (empty, 0) for none."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for slot, x, n in zip(*(batch.column(c).to_pylist() for c in ("slot", "x", "n"))):
                known = sums.setdefault(slot, [0.0, 0])
                known[0], known[1] = known[0] + np.frombuffer(x), known[1] + n
        yield slots_of(sums)

    # Sorted, so that sums of the same parts agree to the last bit.
    found = sorted(parts.repartition("slot").sortWithinPartitions("slot", "n", "x").mapInArrow(add, KIND).collect(), key=lambda r: r.slot)
    return (np.concatenate([np.frombuffer(bytes(r.x)) for r in found]), found[0].n) if found else (np.zeros(0), 0)
