"""Products of coordinate frames: an einsum compiler and what it expresses.

A tensor of rank k is a frame of k index columns and a value; a missing cell is 0. Contraction is a join on shared
labels and a sum over the labels that the output lacks; labels that no later operand needs are summed before a join.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.blocks import contraction_path, label_sizes

#: Whole numbers of 64 bits, and of as many digits as Spark's decimals have.
LONG, DIGITS = (1 << 63) - 1, 10**38 - 1


def parse(subscripts: str) -> tuple[list[str], str]:
    """Inputs and output of "ij,jk->ik"; without an arrow the output is the labels that occur once, in order."""
    left, arrow, output = subscripts.replace(" ", "").partition("->")
    inputs = left.split(",")
    if not arrow:
        output = "".join(sorted(c for c in set(left) - {","} if left.count(c) == 1))
    return inputs, output


def expanded(subscripts: str, ranks: Sequence[int]) -> str:
    """Subscripts with an ellipsis written out by labels of its own, aligned at the last of its axes."""
    if "..." not in subscripts:
        return subscripts
    left, arrow, output = subscripts.replace(" ", "").partition("->")
    terms = left.split(",")
    counts = [rank - len(term.replace("...", "")) if "..." in term else 0 for term, rank in zip(terms, ranks)]
    free = [c for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if c not in subscripts][: max(counts)]
    written = [term.replace("...", "".join(free[len(free) - n :])) for term, n in zip(terms, counts)]
    if arrow:
        return ",".join(written) + "->" + output.replace("...", "".join(free))
    once = sorted(c for c in set("".join(terms)) - {"."} if "".join(terms).count(c) == 1)
    return ",".join(written) + "->" + "".join([*free, *once])


def einsum_path(subscripts: str, *operands: tuple[DataFrame, Sequence[str], str]) -> tuple[list[tuple[int, int]], int]:
    """The order of contractions with the fewest products at the labels' counted sizes, and how many products that is."""
    inputs, output = parse(expanded(subscripts, [len(o[1]) for o in operands]))
    return contraction_path(inputs, output, label_sizes(operands[0][0].sparkSession, inputs, operands))


def einsum(subscripts: str, *operands: tuple[DataFrame, Sequence[str], str], optimize: bool = False, exact: bool = False) -> DataFrame:
    """Operands are (frame, index columns, value column); the result has a column for each output label, and x.

    Operands are contracted from left to right, or where ``optimize`` is set in the order that ``einsum_path`` finds.
    With ``exact``, integers are kept whole: where a sum may leave 64 bits, decimals of 38 digits are contracted, and x stays
    one if the result has a number that a bigint doesn't hold.
    """
    inputs, output = parse(expanded(subscripts, [len(o[1]) for o in operands]))
    if exact and all(isinstance(frame.schema[value].dataType, T.IntegralType) for frame, _, value in operands):
        most = reach(inputs, output, operands)
        if most > DIGITS:
            raise OverflowError(f"sums of {subscripts} may reach {most}, which no decimal holds")
        if most > LONG:
            made = einsum(subscripts, *[(frame.withColumn(value, F.col(value).cast("decimal(38,0)")), index, value) for frame, index, value in operands], optimize=optimize)
            top = made.agg(F.max(F.abs("x"))).first()[0]
            return made if top is not None and top > LONG else made.withColumn("x", F.col("x").cast("bigint"))
    if optimize and len(operands) > 2:
        terms = list(zip(inputs, operands))
        for i, j in contraction_path(inputs, output, label_sizes(operands[0][0].sparkSession, inputs, operands))[0]:
            (b, right), (a, left) = terms.pop(j), terms.pop(i)
            later = set(output).union(*(term for term, _ in terms))
            kept = "".join(dict.fromkeys(c for c in a + b if c in later)) if terms else output
            made = _contracted([a, b], kept, [left, right])
            terms.append((kept, (made, list(kept), "x")))
        return terms[0][1][0]
    return _contracted(inputs, output, operands)


def reach(inputs: Sequence[str], output: str, operands: Sequence[tuple[DataFrame, Sequence[str], str]]) -> int:
    """A bound on all sums of products on the way to a result, whatever the order: the sum of one operand's sizes times the
    largest of each other one, times the places of the labels summed over that the first lacks; the least over the operands.

    Counted in one job. Cells occur once in an operand, as in any tensor.
    """

    def counted(n: int) -> DataFrame:
        frame, index, value = operands[n]
        size = F.abs(F.col(value).cast("decimal(38,0)"))
        return frame.agg(F.lit(n).alias("n"), F.max(size).alias("top"), F.sum(size).alias("total"), F.array(*[F.max(F.col(c)).cast("bigint") + 1 for c in index]).alias("places"))

    facts = sorted(reduce(DataFrame.union, map(counted, range(len(operands)))).collect())
    tops, totals = ([max(int(r[name] or 0), 1) for r in facts] for name in ("top", "total"))
    places: dict[str, int] = {}
    for labels, r in zip(inputs, facts):
        for label, size in zip(labels, r.places):
            places[label] = max(places.get(label, 1), size or 1)
    summed = set(places) - set(output)
    return min(total * math.prod(tops[:n] + tops[n + 1 :]) * math.prod(places[c] for c in summed - set(inputs[n])) for n, total in enumerate(totals))


def tensordot(a: tuple[DataFrame, Sequence[str], str], b: tuple[DataFrame, Sequence[str], str], axes: int | tuple[Sequence[int], Sequence[int]] = 2) -> DataFrame:
    """Sum over pairs of axes: the last ``axes`` of a with the first of b, or the named ones. Columns d0, d1, ... and x."""
    n, m = len(a[1]), len(b[1])
    mine, theirs = (range(n - axes, n), range(axes)) if isinstance(axes, int) else axes
    letters = iter("abcdefghijklmnopqrstuvwxyz")
    left = [next(letters) for _ in range(n)]
    right = [next(letters) for _ in range(m)]
    for i, j in zip(mine, theirs):
        right[j % m] = left[i % n]
    output = [c for k, c in enumerate(left) if k not in {i % n for i in mine}] + [c for k, c in enumerate(right) if k not in {j % m for j in theirs}]
    made = einsum(f"{''.join(left)},{''.join(right)}->{''.join(output)}", a, b)
    return made.select(*[F.col(c).alias(f"d{k}") for k, c in enumerate(output)], "x")


def _contracted(inputs: Sequence[str], output: str, operands: Sequence[tuple[DataFrame, Sequence[str], str]]) -> DataFrame:
    frames = []
    for labels, (frame, index, value) in zip(inputs, operands):
        named = frame.select(*[F.col(c).alias(f"__{k}") for k, c in enumerate(index)], F.col(value).alias("x"))
        first = {}
        for k, label in enumerate(labels):  # a label that occurs twice in an operand is its diagonal
            if label in first:
                named = named.filter(F.col(f"__{k}") == F.col(f"__{first[label]}"))
            first.setdefault(label, k)
        frames.append((list(first), named.select(*[F.col(f"__{k}").alias(label) for label, k in first.items()], "x")))
    labels, now = _sum_out(*frames[0], {*output, *(c for held, _ in frames[1:] for c in held)})
    for n, (held, frame) in enumerate(frames[1:], 2):
        later = {*output, *(c for more, _ in frames[n:] for c in more)}
        held, frame = _sum_out(held, frame, later | set(labels))
        shared = [c for c in labels if c in held]
        right = frame.withColumnRenamed("x", "__x")
        joined = now.join(right, shared) if shared else now.crossJoin(right)
        labels = labels + [c for c in held if c not in labels]
        labels, now = _sum_out(labels, joined.select(*labels, (F.col("x") * F.col("__x")).alias("x")), later)
    return now.select(*output, "x") if output else now.agg(F.sum("x").alias("x"))


def _sum_out(labels: list[str], frame: DataFrame, needed: set[str]) -> tuple[list[str], DataFrame]:
    kept = [c for c in labels if c in needed]
    return (labels, frame) if kept == labels else (kept, frame.groupBy(*kept).agg(F.sum("x").alias("x")))


def matmul(a: DataFrame, b: DataFrame, index: Sequence[str] = ("i", "j"), value: str = "x") -> DataFrame:
    return einsum("ij,jk->ik", (a, index, value), (b, index, value))


def outer(a: DataFrame, b: DataFrame, index: str = "i", value: str = "x") -> DataFrame:
    return einsum("i,j->ij", (a, [index], value), (b, [index], value))


def inner(a: DataFrame, b: DataFrame, index: str = "i", value: str = "x") -> DataFrame:
    return einsum("i,i->", (a, [index], value), (b, [index], value))


def trace(a: DataFrame, index: Sequence[str] = ("i", "j"), value: str = "x", offset: int = 0) -> DataFrame:
    return a.filter(F.col(index[1]) - F.col(index[0]) == offset).agg(F.coalesce(F.sum(value), F.lit(0)).alias("x"))


def transpose(a: DataFrame, index: Sequence[str], axes: Sequence[int]) -> DataFrame:
    return a.select(*[F.col(index[axis]).alias(index[k]) for k, axis in enumerate(axes)], *[c for c in a.columns if c not in index])


def triangle(a: DataFrame, index: Sequence[str] = ("i", "j"), k: int = 0, lower: bool = True) -> DataFrame:
    """tril and triu."""
    over = F.col(index[1]) - F.col(index[0])
    return a.filter(over <= k if lower else over >= k)


def kron(a: DataFrame, b: DataFrame, shape: tuple[int, int], index: Sequence[str] = ("i", "j"), value: str = "x") -> DataFrame:
    """Kronecker product; ``shape`` is that of b."""
    product = einsum("ij,kl->ijkl", (a, index, value), (b, index, value))
    return product.select((F.col("i") * shape[0] + F.col("k")).alias("i"), (F.col("j") * shape[1] + F.col("l")).alias("j"), "x")


def rows_to_coordinates(frame: DataFrame, row: str, vector: str) -> DataFrame:
    """Row vectors (id, array) as coordinates (i, j, x)."""
    return frame.select(F.col(row).alias("i"), F.posexplode(vector).alias("j", "x"))
