"""Embedding whitening by column aggregates over the upper triangle.

1.  Vectors become whole numbers, x = floor(scale * c) + offset. The fit list is each distinct x once, written as a table.
2.  One aggregation gives its size n and the sums S of all dimensions; a second one is generated Spark SQL expressions: for
    every pair of dimensions i <= j the sum of (x_i - S_i / n) * (x_j - S_j / n). Each task sends one row of d (d + 1) / 2
    numbers, whatever the table's size; the driver puts V together and LAPACK (``eigh``) decomposes it.
3.  Rows are projected by one matrix product an Arrow batch: no shuffle. A last aggregation over the fit list takes the
    covariance of what was whitened and tells how far it is from the identity.

Beyond PAIRS pairs (more than 90 dimensions) step 2 takes several aggregations, as a plan's expressions are compiled.

Defined cases: vectors that are null, empty, or hold null, NaN or an infinity take no part; nor do those of another length
than most of the distinct vectors have (of two such lengths the longer counts). A component whose eigenvalue is below
FLAT times the largest has whitened null and is left out of identity_error, which is null if none is left; explained is
null where all vectors are one. An empty table gives an empty result. Null ids and repeated rows are rows like any other;
columns besides id and vector don't matter, whatever their names. Sums of a float kind are in double precision; the
deviation is whole numbers, and null where it exceeds a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import materialize

#: Sums in one aggregation.
PAIRS = 4096
#: Share of the largest eigenvalue below which a direction counts as flat: what is left there is rounding.
FLAT = 1e-11


@dataclass(frozen=True)
class Whitening:
    """A fitted transformation. ``axes`` holds a unit eigenvector a row, by falling eigenvalue."""

    count: int
    sums: tuple[int, ...]
    spread: int  # the largest distance between two entries of one dimension
    eigenvalues: np.ndarray
    axes: np.ndarray
    trace: float
    identity_error: float | None = None

    def usable(self, component: int) -> bool:
        return bool(self.eigenvalues[component] > FLAT * self.eigenvalues[0]) and bool(self.eigenvalues[0] > 0)


def whole_numbers(vector: Column, scale: int = 64, offset: int = 1_000_000) -> Column:
    """floor(scale * c) + offset of every entry; null for a vector that takes no part."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    moved = F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long") + F.lit(offset).cast("long"))
    return F.when((F.size(vector) > 0) & ~bad, moved)


def _totals(frame: DataFrame, expressions: list[str]) -> list:
    """One row of sums, in aggregations of PAIRS expressions at most."""
    found: list = []
    for at in range(0, len(expressions), PAIRS):
        found += frame.selectExpr(*[f"{e} AS s{i}" for i, e in enumerate(expressions[at : at + PAIRS])]).first()
    return found


def _centred(frame: DataFrame, count: int, sums: tuple[int, ...]) -> DataFrame:
    """The vectors less their mean as columns c0, c1, ... that are never NULL: sums of these are compiled without tests."""
    return frame.selectExpr(*[f"coalesce(CAST(x[{i}] AS DOUBLE) - {_number(s / count)}, 0D) AS c{i}" for i, s in enumerate(sums)])


def _number(value: float) -> str:
    return f"CAST('{value!r}' AS DOUBLE)"


def _projected(rows: DataFrame, model: Whitening, components: int) -> DataFrame:
    """(vec_id, deviation, white): whitened values of the first components as an array, by one matrix product a batch."""
    used = np.array([model.usable(k) for k in range(components)])
    weights = np.zeros((len(model.sums), components))
    weights[:, used] = (model.axes[:components][used] / np.sqrt(model.eigenvalues[:components][used])[:, None]).T
    small = len(model.sums) * (model.count * model.spread) ** 2 < 1 << 63
    means = np.array([s / model.count for s in model.sums])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.array(model.sums, dtype=np.int64 if small else object)
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(sums))
            apart = (x if small else x.astype(object)) * model.count - sums
            deviations = (apart * apart).sum(axis=1)
            white = ((x - means) @ weights).ravel()
            flat = np.tile(~used, batch.num_rows)
            offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * components
            columns = [batch.column("vec_id"), pa.array([int(v) if v < 1 << 63 else None for v in deviations], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(white, mask=flat))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "deviation", "white"])

    return rows.select("vec_id", "x").mapInArrow(run, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, deviation long, white array<double>")


def fit_whitening(fit: DataFrame, components: int = 16) -> Whitening | None:
    """The transformation of a table of distinct vectors ``x`` of one length; None of an empty one."""
    lengths = fit.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return None
    d = lengths.d
    fit = fit.filter(F.size("x") == d)
    first = _totals(fit, ["count(*)", *[f"{f}(x[{i}])" for i in range(d) for f in ("sum", "min", "max")]])
    count, sums = first[0], tuple(first[1::3])
    spread = max(high - low for low, high in zip(first[2::3], first[3::3]))
    pairs = list(combinations_with_replacement(range(d), 2))
    products = _totals(_centred(fit, count, sums), [f"sum(c{i} * c{j})" for i, j in pairs])
    covariance = np.zeros((d, d))
    for (i, j), total in zip(pairs, products):
        covariance[i, j] = covariance[j, i] = total / count
    values, vectors = np.linalg.eigh(covariance)
    model = Whitening(count, sums, spread, np.maximum(values[::-1], 0), vectors.T[::-1], float(np.trace(covariance)))
    return Whitening(**{**model.__dict__, "identity_error": _identity_error(fit, model, min(components, d))})


def _identity_error(fit: DataFrame, model: Whitening, components: int) -> float | None:
    """Largest entry of the whitened vectors' covariance less the identity (their mean is zero: x was centred)."""
    used = [k for k in range(components) if model.usable(k)]
    if not used:
        return None
    white = _projected(fit.withColumn("vec_id", F.lit(0)), model, components)
    pairs = list(combinations_with_replacement(used, 2))
    products = _totals(white, [f"sum(white[{i}] * white[{j}])" for i, j in pairs])
    return max(abs(total / model.count - (i == j)) for (i, j), total in zip(pairs, products))


def whiten(frame: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """One row per row that takes part and component (from 1): vec_id, component, n, deviation, whitened, explained, identity_error."""
    name = lambda column: F.col("`" + column.replace("`", "``") + "`")
    rows = frame.select(name(id_col).alias("vec_id"), whole_numbers(name(vector_col), scale, offset).alias("x")).filter("x is not null")
    model = fit_whitening(materialize(rows.select("x").distinct()), components)
    if model is None:
        none = "0 AS component, 0L AS n, 0L AS deviation, 0D AS whitened, 0D AS explained, 0D AS identity_error"
        return rows.selectExpr("vec_id", *none.split(", ")).limit(0)
    d = len(model.sums)
    kept = min(components, d)
    share = F.array(*[F.lit(float(e / model.trace) if model.trace > 0 else None).cast("double") for e in model.eigenvalues[:kept]])
    white = _projected(rows.filter(F.size("x") == d), model, kept)
    return white.select("vec_id", "deviation", F.posexplode("white").alias("at", "whitened")).select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.count).cast("long").alias("n"),
        "deviation",
        "whitened",
        share[F.col("at")].alias("explained"),
        F.lit(model.identity_error).cast("double").alias("identity_error"),
    )
