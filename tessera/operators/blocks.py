"""Products of large matrices by blocks, and tall-skinny QR with the least squares that come from it.

A block frame has one row for each block: (bi, bj, block), the block's numbers row by row, and edge blocks padded with zeros.
Blocks meet in one join on the inner block index; a task multiplies the pairs that it gets and sums products of one output
block before they are shuffled, so what travels is one block for each output block and task, never one row for each cell.
Where the product is too large for a task to sum up (an outer product of tall matrices has the square of their rows), tasks get
strips of both sides instead and finish their tile of the product: what travels is a few copies of the operands, and no product.

The QR of a tall frame of row vectors keeps one triangle for each task (own Householder steps, some rows at a time); triangles
are merged in a tree, so no task sees more than FAN of them. Nothing is squared: a condition number stays what it is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Output blocks that a task sums up at a time, or blocks of both sides of a tile, bytes at most.
HELD = 64 << 20
#: Tiles for each core, about.
TILES = 4
#: Triangles merged by one task.
FAN = 16


@dataclass(frozen=True)
class Blocks:
    frame: DataFrame  # bi, bj, block
    shape: tuple[int, int]
    size: int

    @property
    def T(self) -> Blocks:
        size = self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                turned = _numbers(batch.column("block"), size).transpose(0, 2, 1)
                yield pa.RecordBatch.from_arrays([batch.column("bj"), batch.column("bi"), _lists(turned)], names=["bi", "bj", "block"])

        return Blocks(self.frame.mapInArrow(run, SCHEMA), self.shape[::-1], size)


SCHEMA = "bi long, bj long, block array<double>"


def _numbers(column: pa.ListArray, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size, size)


def _lists(blocks: np.ndarray) -> pa.ListArray:
    width = int(np.prod(blocks.shape[1:]))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(blocks) + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(blocks).ravel()))


def from_rows(frame: DataFrame, row: str, vector: str, shape: tuple[int, int], size: int = 128) -> Blocks:
    """Row vectors (place from 0, array) as blocks. Rows that are missing count as zeros, and NULL entries too."""
    wide = -(-shape[1] // size)
    pieces = F.transform(F.sequence(F.lit(0), F.lit(wide - 1)), lambda b: F.slice(F.col("v"), b * size + 1, size))
    cut = frame.select(F.col(row).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v")).select("i", F.posexplode(pieces).alias("bj", "piece"))
    keyed = cut.select(F.expr(f"i div {size}").alias("bi"), F.col("bj").cast("long").alias("bj"), (F.col("i") % size).cast("int").alias("r"), "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, None
        for batch in batches:
            for bi, bj, r, piece in zip(batch.column("bi").to_pylist(), batch.column("bj").to_pylist(), batch.column("r").to_pylist(), batch.column("piece")):
                if (bi, bj) != now:
                    if now:
                        yield pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]]), _lists(block[None])], names=["bi", "bj", "block"])
                    now, block = (bi, bj), np.zeros((size, size))
                values = piece.values.to_numpy(zero_copy_only=False)
                block[r, : len(values)] = np.nan_to_num(values, nan=0.0) if piece.values.null_count else values
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]]), _lists(block[None])], names=["bi", "bj", "block"])

    dealt = keyed.repartition("bi", "bj").sortWithinPartitions("bi", "bj")
    return Blocks(dealt.mapInArrow(run, SCHEMA), shape, size)


def to_coordinates(blocks: Blocks) -> DataFrame:
    """(i, j, x) of all cells within the shape."""
    rows, columns = blocks.shape
    size = blocks.size
    lines = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda r: F.slice("block", r * size + 1, size))
    cut = blocks.frame.select("bi", "bj", F.posexplode(lines).alias("r", "line")).select((F.col("bi") * size + F.col("r")).alias("i"), (F.col("bj") * size).alias("first"), "line")
    cells = cut.filter(F.col("i") < rows).select("i", "first", F.posexplode("line").alias("at", "x"))
    return cells.select("i", (F.col("first") + F.col("at")).alias("j"), "x").filter(F.col("j") < columns)


def _summed(frame: DataFrame, size: int) -> DataFrame:
    """Blocks of one place added up, as they come in order of places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            for bi, bj, block in zip(batch.column("bi").to_pylist(), batch.column("bj").to_pylist(), _numbers(batch.column("block"), size)):
                if (bi, bj) == now:
                    total += block
                    continue
                if now:
                    yield pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]]), _lists(total[None])], names=["bi", "bj", "block"])
                now, total = (bi, bj), block.copy()
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]]), _lists(total[None])], names=["bi", "bj", "block"])

    return frame.repartition("bi", "bj").sortWithinPartitions("bi", "bj").mapInArrow(run, SCHEMA)


def matmul(a: Blocks, b: Blocks) -> Blocks:
    if a.shape[1] != b.shape[0] or a.size != b.size:
        raise ValueError(f"shapes {a.shape} and {b.shape} in blocks of {a.size} and {b.size} don't fit")
    size = a.size
    rows, inner, columns = (-(-n // size) for n in (a.shape[0], a.shape[1], b.shape[1]))
    if rows * columns * size * size * 8 > HELD:
        tall, wide = strips(rows, inner, columns, size, a.frame.sparkSession.sparkContext.defaultParallelism)
        if rows * wide + columns * tall < rows * columns:
            return _tiled(a, b, rows, columns, tall, wide)
    left = a.frame.select(F.col("bi"), F.col("bj").alias("k"), F.col("block").alias("a"))
    right = b.frame.select(F.col("bi").alias("k"), F.col("bj"), F.col("block").alias("b"))
    pairs = left.join(right, "k").select("bi", "bj", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums]), pa.array([k[1] for k in sums]), _lists(np.stack(list(sums.values())))], names=["bi", "bj", "block"])
            sums.clear()
            return made

        for batch in batches:
            for bi, bj, x, y in zip(batch.column("bi").to_pylist(), batch.column("bj").to_pylist(), _numbers(batch.column("a"), size), _numbers(batch.column("b"), size)):
                if (bi, bj) in sums:
                    sums[bi, bj] += x @ y
                else:
                    sums[bi, bj] = x @ y
                    if len(sums) * size * size * 8 > HELD:
                        yield flush()
        if sums:
            yield flush()

    return Blocks(_summed(pairs.mapInArrow(run, SCHEMA), size), (a.shape[0], b.shape[1]), size)


def strips(rows: int, inner: int, columns: int, size: int, cores: int) -> tuple[int, int]:
    """Into how many strips the block rows of the left side and the block columns of the right one are cut."""
    most = max(1, HELD // (2 * inner * size * size * 8))
    tasks = TILES * cores
    tall = min(rows, max(math.isqrt(tasks), -(-rows // most)))
    wide = min(columns, max(-(-tasks // tall), -(-columns // most)))
    return min(rows, max(tall, -(-tasks // wide))), wide


def _tiled(a: Blocks, b: Blocks, rows: int, columns: int, tall: int, wide: int) -> Blocks:
    """The product tile by tile: strip i of the left side with strip j of the right side in task i * wide + j."""
    size = a.size
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = a.frame.select(F.expr(f"bi * {tall} div {rows}").alias("i"), every(wide).alias("j"), F.lit(0).alias("side"), F.col("bi").alias("at"), F.col("bj").alias("k"), "block")
    right = b.frame.select(every(tall).alias("i"), F.expr(f"bj * {wide} div {columns}").alias("j"), F.lit(1).alias("side"), F.col("bj").alias("at"), F.col("bi").alias("k"), "block")
    dealt = left.union(right).select((F.col("i") * wide + F.col("j")).cast("int").alias("tile"), "side", "at", "k", "block").repartitionById(tall * wide, F.col("tile"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lefts: dict[int, dict[int, np.ndarray]] = {}
        rights: dict[int, dict[int, np.ndarray]] = {}
        for batch in batches:
            for side, at, k, block in zip(batch.column("side").to_pylist(), batch.column("at").to_pylist(), batch.column("k").to_pylist(), _numbers(batch.column("block"), size)):
                held = rights.setdefault(k, {}) if side else lefts.setdefault(at, {})
                held[at if side else k] = block.copy()
        beside = {}
        for k in list(rights):
            beside[k] = np.array(sorted(rights[k])), np.hstack([rights[k][at] for at in sorted(rights[k])])
            del rights[k]
        for bi in sorted(lefts):
            shared = sorted(lefts[bi].keys() & beside.keys())
            if not shared:
                continue
            places = np.unique(np.concatenate([beside[k][0] for k in shared]))
            sums = np.zeros((size, len(places), size))
            for k in shared:
                at, row = beside[k]
                sums[:, np.searchsorted(places, at)] += (lefts[bi][k] @ row).reshape(size, len(at), size)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(places), bi)), pa.array(places), _lists(sums.transpose(1, 0, 2))], names=["bi", "bj", "block"])

    return Blocks(dealt.mapInArrow(run, SCHEMA), (a.shape[0], b.shape[1]), size)


# Tall-skinny QR.
def triangle(rows: np.ndarray) -> np.ndarray:
    """R of a matrix, d x d with a diagonal that isn't negative, by Householder reflections."""
    r = np.array(rows, dtype=float)
    count, d = r.shape
    for j in range(min(count, d)):
        x = r[j:, j]
        norm = np.linalg.norm(x)
        if norm == 0:
            continue
        v = x.copy()
        v[0] += norm if x[0] >= 0 else -norm
        v /= np.linalg.norm(v)
        r[j:, j:] -= 2 * np.outer(v, v @ r[j:, j:])
    out = np.zeros((d, d))
    out[: min(count, d)] = np.triu(r[:d])
    return out * np.where(np.diag(out) < 0, -1.0, 1.0)[:, None]


def tall_r(frame: DataFrame, vector: str) -> np.ndarray | None:
    """R of all row vectors (of one length); None of an empty frame. Vectors that are NULL or hold NULL are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            column = batch.column("v")
            for at in range(0, len(column), 4096):
                part = column.slice(at, 4096)
                values = part.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(part[0]))
                held = triangle(values if held is None else np.vstack([held, values]))
        if held is not None:
            yield pa.RecordBatch.from_arrays([_lists(held[:, None, :])], names=["v"])

    vectors = frame.select(F.col(vector).cast("array<double>").alias("v")).filter("v is not null and not exists(v, x -> x is null)")
    now, parts = vectors.mapInArrow(run, "v array<double>"), vectors.rdd.getNumPartitions()
    while parts > FAN:
        parts = -(-parts // FAN)
        now = now.coalesce(parts).mapInArrow(run, "v array<double>")
    found = [np.array(r.v) for r in now.collect()]  # d rows from each of FAN tasks at most
    return triangle(np.array(found)) if found else None


def least_squares(frame: DataFrame, vector: str, target: str, rcond: float | None = None) -> tuple[np.ndarray, float, int, np.ndarray] | None:
    """Solution of least norm, sum of squared residuals, rank and singular values of the rows against ``target``.

    All come from R of the rows with the target as their last entry.
    """
    rows = frame.filter(F.col(vector).isNotNull()).select(F.concat(F.col(vector).cast("array<double>"), F.array(F.col(target).cast("double"))).alias("v"))
    r = tall_r(rows, "v")
    if r is None:
        return None
    d = len(r) - 1
    u, s, vt = np.linalg.svd(r[:d, :d])
    keep = s > (rcond if rcond is not None else np.finfo(float).eps * max(d, 1)) * (s[0] if d else 0)
    coordinates = u.T @ r[:d, d]
    solution = vt[keep].T @ (coordinates[keep] / s[keep])
    return solution, float(r[d, d] ** 2 + (coordinates[~keep] ** 2).sum()), int(keep.sum()), s


def tall_q(frame: DataFrame, vector: str, r: np.ndarray, out: str = "q") -> DataFrame:
    """``frame`` with each row's row of Q, by back substitution against an R of full rank."""
    names = [n for n in frame.columns if n != out]
    width = len(r)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("__v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            q = np.zeros_like(x)
            for j in range(width):
                q[:, j] = (x[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
            yield pa.RecordBatch.from_arrays([*(batch.column(f"__c{i}") for i in range(len(names))), _lists(q[:, None, :])], names=[*names, out])

    given = frame.select(*[F.col(f"`{n}`").alias(f"__c{i}") for i, n in enumerate(names)], F.col(vector).cast("array<double>").alias("__v"))
    kinds = ", ".join(f"`{n}` {frame.schema[n].dataType.simpleString()}" for n in names)
    return given.filter("__v is not null").mapInArrow(run, f"{kinds}, `{out}` array<double>")


# Orders of contraction.
def contraction_path(inputs: Sequence[str], output: str, sizes: dict[str, int]) -> tuple[list[tuple[int, int]], int]:
    """Pairs of operands to contract, as places in the list that each step's result is put at the end of, and the products made.

    The order with the fewest products is found over all subsets, for a dozen operands at most.
    """
    full = (1 << len(inputs)) - 1
    labels = {}

    def left(group: int) -> frozenset[str]:
        if group not in labels:
            inside = set().union(*(inputs[k] for k in range(len(inputs)) if group >> k & 1))
            outside = set(output).union(*(inputs[k] for k in range(len(inputs)) if not group >> k & 1))
            labels[group] = frozenset(inside & outside) if group & (group - 1) else frozenset(inputs[group.bit_length() - 1])
        return labels[group]

    def cost(a: int, b: int) -> int:
        return int(np.prod([sizes[c] for c in left(a) | left(b)], dtype=object))

    best: dict[int, tuple[int, tuple[int, int] | None]] = {1 << k: (0, None) for k in range(len(inputs))}
    for group in sorted(range(1, full + 1), key=lambda g: g.bit_count()):
        if group in best:
            continue
        options, part = [], (group - 1) & group
        while part:
            other = group ^ part
            if part < other:
                options.append((best[part][0] + best[other][0] + cost(part, other), (part, other)))
            part = (part - 1) & group
        best[group] = min(options)
    path, places = [], [1 << k for k in range(len(inputs))]

    def steps(group: int) -> None:
        pair = best[group][1]
        if pair:
            for side in pair:
                steps(side)
            at = sorted(places.index(side) for side in pair)
            path.append(tuple(at))
            for k in reversed(at):
                places.pop(k)
            places.append(group)

    steps(full)
    return path, best[full][0]


def label_sizes(spark: SparkSession, inputs: Sequence[str], operands: Sequence[tuple[DataFrame, Sequence[str], str]]) -> dict[str, int]:
    """How many places each label has, counted: one more than the largest in any operand."""
    sizes: dict[str, int] = {}
    for held, (frame, index, _) in zip(inputs, operands):
        tops = frame.agg(*[F.max(F.col(c)).alias(f"m{k}") for k, c in enumerate(index)]).first()
        for label, top in zip(held, tops):
            sizes[label] = max(sizes.get(label, 1), 1 if top is None else int(top) + 1)
    return sizes
