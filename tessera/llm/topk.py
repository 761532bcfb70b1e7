"""Exact top-k search by inner product: a Voronoi join of queries and data.

Vectors are grouped by their nearest pivot. With M the largest length of any vector, the data point x stands for
(x, sqrt(M * M - x.x)) and the query q for (q, 0): then squared distance is q.q + M * M - 2 q.x, so nearest means largest
inner product and the triangle inequality holds. Summaries of each cell (its radius, and its smallest distances to the
pivot, and how many of its vectors lie how far from it) bound, for each query cell, how far the k-th best of any of its
queries can be; a data vector goes to a query cell only if its distance to its pivot leaves room for it within that bound.
Near query cells are put together in groups, which get a vector once, but only while that makes fewer copies by the
summaries. Groups and cells are dealt out in blocks of bounded size, each is solved by matrix products, and the best k
of a query's blocks are merged. Where the bounds leave out little (many dimensions, vectors of like length), a group
takes up to GROUP queries, so a vector is copied once for so many.

Scores are exact integers: the bounds only decide where vectors go, and leave room for rounding.

Defined cases: vectors that are null, or hold null or non-finite components, and rows without an id take no part;
missing trailing components count as 0; equal scores go to the smaller id; identical rows count as one; components are
floor(scale * x), and their products must stay within 63 bits; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.shared import materialize

#: Pivots at most; they and their summaries are all that is collected.
PIVOTS = 256
#: Queries of a group, about, and vectors of a block.
GROUP = 8192
BLOCK = 4096
#: Queries whose scores with a block are held at a time, and steps of distance in a cell's summary.
SLICE = 256
STEPS = 64


def _matrix(values: list[list[int]], width: int) -> np.ndarray:
    out = np.zeros((len(values), width), dtype=np.int64)
    for i, value in enumerate(values):
        out[i, : len(value)] = value
    return out


def products(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point where all sums stay below 2 ** 53, else in integers."""
    most = int(np.abs(queries).max(initial=0)) * int(np.abs(data).max(initial=0)) * queries.shape[1]
    if most < 1 << 53:
        return (queries.astype(np.float64) @ data.T.astype(np.float64)).astype(np.int64)
    return queries @ data.T


def _usable(frame: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """Ids and integer vectors of the rows that take part."""
    whole = F.transform(F.col("v"), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    finite = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (
        frame.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
        .filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)))
        .select("vec_id", whole.alias("x"))
    )


class Cells:
    """Pivots in the space where nearest means largest inner product."""

    def __init__(self, pivots: np.ndarray, longest: float):
        self.pivots, self.longest = pivots.astype(np.float64), longest

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        x = x.astype(np.float64)
        last = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.longest**2 - (x * x).sum(axis=1), 0))
        return np.column_stack([x, last])

    def nearest(self, x: np.ndarray, query: bool) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's cell and its distance to the cell's pivot."""
        lifted = self.lift(x, query)
        square = (lifted * lifted).sum(axis=1)[:, None] + (self.pivots * self.pivots).sum(axis=1) - 2 * lifted @ self.pivots.T
        cell = np.argmin(square, axis=1)
        return cell, np.sqrt(np.maximum(((lifted - self.pivots[cell]) ** 2).sum(axis=1), 0))


def _assign(frame: DataFrame, cells: Cells, width: int, query: bool) -> DataFrame:
    handle = frame.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, distance = handle.value.nearest(_matrix(batch.column("x").to_pylist(), width), query)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), pa.array(cell.astype(np.int32)), pa.array(distance)], names=["vec_id", "x", "cell", "d"])

    return frame.mapInArrow(run, "vec_id long, x array<long>, cell int, d double")


def plan_groups(sizes: dict[int, int], rooms: dict[int, np.ndarray], pivots: np.ndarray, counts: np.ndarray, edges: np.ndarray) -> list[tuple[list[int], np.ndarray, int]]:
    """Query cells put together, each with the least distance to its pivot that a vector of a cell needs, and the copies that makes.

    ``counts[j, s]`` vectors of cell j are at most edges[s] from its pivot. Near cells join while a group has less than
    GROUP queries and the copies of the whole are fewer than those of its parts.
    """

    def copies(room: np.ndarray) -> int:
        return int(counts[edges[None, :] >= room[:, None]].sum())

    left, groups = sorted(sizes), []
    while left:
        first = left.pop(0)
        group, size, room, cost = [first], sizes[first], rooms[first], copies(rooms[first])
        while left and size < GROUP:
            near = min(left, key=lambda c: (float(((pivots[c] - pivots[first]) ** 2).sum()), c))
            both = np.minimum(room, rooms[near])
            together = copies(both)
            if together >= cost + copies(rooms[near]):
                break
            left.remove(near)
            group, size, room, cost = [*group, near], size + sizes[near], both, together
        groups.append((group, room, cost))
    return groups


def top_k(frame: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best rows of ``frame`` whose id is not its own."""
    data = materialize(_usable(frame, id_col, vector_col, scale).distinct())
    asked = materialize(_usable(queries, id_col, vector_col, scale).distinct())
    square = F.aggregate("x", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    count, width, longest = data.agg(F.count("*"), F.max(F.size("x")), F.max(square)).first()
    more = asked.agg(F.max(F.size("x"))).first()[0]
    schema = "query_id long, rank int, vec_id long, score long"
    if not count or more is None:
        return frame.sparkSession.createDataFrame([], schema)
    width = max(width, more)
    # Pivots are data vectors chosen by hash, so the same in every run.
    wanted = min(PIVOTS, max(1, math.isqrt(count)))
    chosen = data.orderBy(F.xxhash64("vec_id"), "vec_id").select("x").limit(wanted).collect()
    longest = math.sqrt(longest)
    cells = Cells(np.zeros((1, width + 1)), longest)
    cells.pivots = cells.lift(_matrix([r.x for r in chosen], width), query=False)
    placed = materialize(_assign(data, cells, width, query=False))
    sought = materialize(_assign(asked, cells, width, query=True))

    # A query's own row is no candidate, so the bound needs k + 1 vectors.
    nearest = Window.partitionBy("cell").orderBy("d")
    closest = {}
    for r in placed.select("cell", "d").withColumn("n", F.row_number().over(nearest)).filter(F.col("n") <= k + 1).collect():
        closest.setdefault(r.cell, []).append(r.d)
    query_cells = {r.cell: (r.n, r.u) for r in sought.groupBy("cell").agg(F.count("*").alias("n"), F.max("d").alias("u")).collect()}
    between = np.sqrt(np.maximum(((cells.pivots[:, None, :] - cells.pivots[None, :, :]) ** 2).sum(axis=2), 0))
    slack = 1e-6 * (longest + 1)
    step = max(2.0 * longest, 1.0) / STEPS
    counts = np.zeros((len(cells.pivots), STEPS), dtype=np.int64)
    for r in placed.groupBy("cell", F.least(F.floor(F.col("d") / step), F.lit(STEPS - 1)).alias("s")).count().collect():
        counts[r.cell, r.s] = r["count"]
    edges = step * np.arange(1, STEPS + 1)
    edges[-1] = math.inf
    there = sorted(closest)
    rooms = {}
    for cell, (_, reach) in query_cells.items():
        upper = sorted(reach + between[cell, j] + d for j, near in closest.items() for d in near)
        bound = upper[k] if len(upper) > k else math.inf
        # x may be among the best only if d(x, its pivot) >= between - reach - bound, by the triangle inequality.
        rooms[cell] = between[cell] - reach - bound - slack
    within = []
    for number, (group, room, _) in enumerate(plan_groups({c: n for c, (n, _) in query_cells.items()}, rooms, cells.pivots, counts, edges)):
        within.append((number, group, sum(query_cells[c][0] for c in group), {j: float(room[j]) for j in there}))
    spark = frame.sparkSession
    to_group = spark.createDataFrame([(c, g, max(1, -(-size // GROUP))) for g, group, size, _ in within for c in group], "cell int, g int, parts int")
    reached = spark.createDataFrame([(j, g, float(max(least, -1.0)), max(1, -(-size // GROUP))) for g, _, size, room in within for j, least in room.items()], "cell int, g int, least double, parts int")

    routed = placed.join(F.broadcast(reached), "cell").filter(F.col("d") >= F.col("least"))
    sizes = {r.g: r.n for r in routed.groupBy("g").agg(F.count("*").alias("n")).collect()}
    chunks = F.create_map(*[F.lit(v) for g in sizes for v in (g, max(1, -(-sizes[g] // BLOCK)))]) if sizes else None
    if chunks is None:
        return spark.createDataFrame([], schema)
    own = lambda n: F.pmod(F.xxhash64("vec_id", "x"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n.cast("int") - 1))
    rows = routed.withColumn("c", own(F.element_at(chunks, F.col("g")))).withColumn("p", each(F.col("parts"))).select("g", "p", "c", F.lit(1).alias("side"), "vec_id", "x")
    ask = sought.join(F.broadcast(to_group), "cell").withColumn("p", own(F.col("parts"))).withColumn("c", each(F.element_at(chunks, F.col("g")))).select("g", "p", "c", F.lit(0).alias("side"), "vec_id", "x")
    blocks = rows.union(ask).withColumn("b", F.xxhash64("g", "p", "c")).repartition("b").sortWithinPartitions("b", "g", "p", "c", "side", "vec_id")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        held: dict[int, list] = {0: [], 1: []}

        def best() -> Iterator[pa.RecordBatch]:
            if not held[0] or not held[1]:
                return
            ids = np.array([r[0] for r in held[1]], dtype=np.int64)
            data, out = _matrix([r[1] for r in held[1]], width), []
            for at in range(0, len(held[0]), SLICE):
                asking = held[0][at : at + SLICE]
                for (query, vector), score in zip(asking, products(_matrix([r[1] for r in asking], width), data)):
                    mine = np.flatnonzero(ids != query)
                    if len(mine) > 4 * k:
                        mine = mine[score[mine] >= np.partition(score[mine], len(mine) - k)[len(mine) - k]]
                    order = mine[np.lexsort((ids[mine], -score[mine]))]
                    out += [(query, vector, int(ids[j]), int(score[j])) for j in order[:k]]
            yield pa.RecordBatch.from_arrays([pa.array([o[n] for o in out], kind) for n, kind in enumerate((pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64()))], names=["query_id", "q", "vec_id", "score"])

        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("g", "p", "c", "side", "vec_id", "x")]
            for g, p, c, side, vec_id, x in zip(*columns):
                if now != (g, p, c):
                    yield from best()
                    now, held = (g, p, c), {0: [], 1: []}
                held[side].append((vec_id, x))
        yield from best()

    merged = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return (
        blocks.mapInArrow(solve, "query_id long, q array<long>, vec_id long, score long")
        .withColumn("rank", F.row_number().over(merged))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
