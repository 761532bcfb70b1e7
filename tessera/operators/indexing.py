"""Indexing, assignment and broadcasting of coordinate frames.

A ``Tensor`` is a frame with one column for each axis, a value column and a shape. A missing cell stays missing. An index is
compiled to one plan:

- integers and slices (negative steps too) become filters and arithmetic on index columns, with no join or shuffle;
- new axes are constants, an ellipsis stands for as many full slices as are left;
- integer arrays broadcast against each other and become one frame of picks (its own axes, and a place on every axis that it
  indexes), which meets the cells in one join; a boolean mask is the integer arrays of its true cells, numbered by ranges;
- the picks' axes take the place of the indexed axes if those stand side by side, else they come first.

Operands of different shapes meet by a join on the axes that both have at full length; an axis of length one is left out of the
join, and where an operand is repeated by itself, by a range in its own row. Two operands without a shared axis are an
outer product: every pair of cells is a cell of the result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.window import with_positions


@dataclass(frozen=True)
class Tensor:
    """``index`` names the axes' columns in order; ``value`` that of the elements."""

    frame: DataFrame
    shape: tuple[int, ...]
    index: tuple[str, ...]
    value: str = "x"

    def __post_init__(self):
        if len(self.shape) != len(self.index):
            raise ValueError(f"{len(self.index)} index columns for shape {self.shape}")

    @property
    def ndim(self) -> int:
        return len(self.shape)

    def plain(self) -> Tensor:
        """The same with columns d0, d1, ... and x alone."""
        names = tuple(f"d{k}" for k in range(self.ndim))
        columns = [F.col(f"`{c}`").cast("long").alias(n) for c, n in zip(self.index, names)]
        return Tensor(self.frame.select(*columns, F.col(f"`{self.value}`").alias("x")), self.shape, names)

    def map(self, function: Callable[[Column], Column]) -> Tensor:
        """A function of every element; comparisons make masks."""
        own = self.plain()
        return replace(own, frame=own.frame.select(*own.index, function(F.col("x")).alias("x")))

    def __getitem__(self, items) -> Tensor:
        return get(self, *(items if isinstance(items, tuple) else (items,)))


def constant(spark: SparkSession, values) -> Tensor:
    """A tensor of a few values given in Python."""
    array = np.asarray(values)
    kind = {"b": "boolean", "i": "long", "u": "long", "f": "double"}[array.dtype.kind]
    names = tuple(f"d{k}" for k in range(array.ndim))
    rows = [(*map(int, place), v.item()) for place, v in np.ndenumerate(array)]
    return Tensor(spark.createDataFrame(rows, ", ".join([*(f"{n} long" for n in names), f"x {kind}"])), array.shape, names)


# Shapes.
def broadcast_shapes(*shapes: Sequence[int]) -> tuple[int, ...]:
    """The shape that all broadcast to."""
    rank = max((len(s) for s in shapes), default=0)
    found = []
    for axis in range(rank):
        sizes = {s[axis - rank + len(s)] for s in shapes if axis - rank + len(s) >= 0} - {1}
        if len(sizes) > 1:
            raise ValueError(f"shapes {', '.join(map(str, map(tuple, shapes)))} can't be broadcast together")
        found.append(sizes.pop() if sizes else 1)
    return tuple(found)


def _aligned(t: Tensor, shape: Sequence[int]) -> list[Column | None]:
    """For each axis of ``shape`` the column of ``t`` that gives the place on it; None where t is repeated."""
    own, lead = t.plain(), len(shape) - t.ndim
    return [None if axis < lead or t.shape[axis - lead] == 1 and shape[axis] != 1 else F.col(own.index[axis - lead]) for axis in range(len(shape))]


def broadcast_to(t: Tensor, shape: Sequence[int]) -> Tensor:
    """``t`` repeated along axes of length one and new ones: each row makes its own copies from ranges."""
    if broadcast_shapes(t.shape, shape) != tuple(shape):
        raise ValueError(f"shape {t.shape} can't be broadcast to {tuple(shape)}")
    frame = t.plain().frame
    for axis, place in enumerate(_aligned(t, shape)):
        if place is not None:
            made = place
        elif shape[axis]:
            made = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shape[axis] - 1).cast("long")))
        else:
            made, frame = F.lit(0).cast("long"), frame.limit(0)
        frame = frame.withColumn(f"o{axis}", made)
    names = [f"d{axis}" for axis in range(len(shape))]
    return Tensor(frame.select(*[F.col(f"o{axis}").alias(n) for axis, n in enumerate(names)], "x"), tuple(shape), tuple(names))


def broadcast_arrays(*tensors: Tensor) -> list[Tensor]:
    shape = broadcast_shapes(*(t.shape for t in tensors))
    return [broadcast_to(t, shape) for t in tensors]


def broadcast(*tensors: Tensor) -> tuple[DataFrame, tuple[int, ...]]:
    """One frame of all operands side by side (d0, d1, ..., x0, x1, ...) and its shape; a cell that one lacks is lacking."""
    shape = broadcast_shapes(*(t.shape for t in tensors))
    now, held = None, [None] * len(shape)
    for n, t in enumerate(tensors):
        places = _aligned(t, shape)
        used = [axis for axis, place in enumerate(places) if place is not None]
        frame = t.plain().frame.select(*[places[axis].alias(f"p{n}_{axis}") for axis in used], F.col("x").alias(f"x{n}"))
        if now is None:
            now = frame
        else:
            # A column of length one on both sides is always 0 and tells nothing.
            shared = [axis for axis in used if held[axis] is not None and shape[axis] != 1]
            met = [F.col(held[axis]) == F.col(f"p{n}_{axis}") for axis in shared]
            condition = None
            for m in met:
                condition = m if condition is None else condition & m
            now = now.join(frame, condition) if met else now.crossJoin(frame)
        for axis in used:
            held[axis] = held[axis] or f"p{n}_{axis}"
    columns = [(F.col(c) if c else F.lit(0).cast("long")).alias(f"d{axis}") for axis, c in enumerate(held)]
    return now.select(*columns, *[f"x{n}" for n in range(len(tensors))]), shape


def apply(function: Callable[..., Column], *tensors: Tensor) -> Tensor:
    """An elementwise function of tensors of any shapes that broadcast together."""
    frame, shape = broadcast(*tensors)
    names = tuple(f"d{axis}" for axis in range(len(shape)))
    return Tensor(frame.select(*names, function(*[F.col(f"x{n}") for n in range(len(tensors))]).alias("x")), shape, names)


def outer(function: Callable[[Column, Column], Column], a: Tensor, b: Tensor) -> Tensor:
    """The function of every pair of elements; the result has the axes of a, then those of b."""
    a, b = a.plain(), b.plain()
    spread = Tensor(a.frame.select(*a.index, *[F.lit(0).cast("long").alias(f"e{k}") for k in range(b.ndim)], "x"), (*a.shape, *[1] * b.ndim), (*a.index, *[f"e{k}" for k in range(b.ndim)]))
    return apply(function, spread, b)


def iterate(*tensors: Tensor) -> DataFrame:
    """Tuples of elements in C order: pos, x0, x1, ... Numbers come from ranges, so no task orders all."""
    frame, shape = broadcast(*tensors)
    return with_positions(frame, [f"d{axis}" for axis in range(len(shape))]).select("pos", *[f"x{n}" for n in range(len(tensors))])


# The index compiler.
@dataclass(frozen=True)
class _Slice:
    """Places start, start + step, ... on one axis."""

    axis: int
    start: int
    step: int
    size: int

    @classmethod
    def of(cls, axis: int, given: slice, size: int) -> _Slice:
        places = range(*given.indices(size))
        return cls(axis, places.start, places.step, len(places))

    def place(self) -> Column:
        """Where the cell's place on the axis is in the slice; NULL outside."""
        away = F.col(f"d{self.axis}") - F.lit(self.start).cast("long")
        found = F.call_function("div", away, F.lit(self.step).cast("long"))
        return F.when((away % self.step == 0) & (found >= 0) & (found < self.size), found)


@dataclass(frozen=True)
class _Plan:
    """What an index says: the parts of the result in order, integers on axes, and the picks of integer arrays."""

    parts: tuple  # _Slice, None for a new axis, or "picks" where the picks' axes stand
    fixed: tuple[tuple[int, int], ...]
    picks: DataFrame | None = None  # b0, b1, ... and a<axis> for each indexed axis
    picks_shape: tuple[int, ...] = ()
    picked: tuple[int, ...] = ()

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(n for part in self.parts for n in (self.picks_shape if part == "picks" else (1 if part is None else part.size,)))

    def places(self) -> list[Column]:
        found = []
        for part in self.parts:
            if part == "picks":
                found += [F.col(f"b{k}") for k in range(len(self.picks_shape))]
            else:
                found.append(F.lit(0).cast("long") if part is None else part.place())
        return found

    def inside(self) -> Column:
        """Whether a cell meets the integers and slices."""
        tests = [F.col(f"d{axis}") == at for axis, at in self.fixed] + [part.place().isNotNull() for part in self.parts if isinstance(part, _Slice)]
        held = F.lit(True)
        for test in tests:
            held = held & test
        return held


def _integer(at: int, size: int, axis: int) -> int:
    if not -size <= at < size:
        raise IndexError(f"index {at} is out of bounds for axis {axis} with size {size}")
    return at % size


def _wrapped(t: Tensor, size: int, axis: int) -> Tensor:
    """Places counted from the end become places from the start; others outside raise when they are read."""
    message = F.concat(F.lit("index "), F.col("x").cast("string"), F.lit(f" is out of bounds for axis {axis} with size {size}"))
    checked = F.when((F.col("x") >= -size) & (F.col("x") < size), F.pmod(F.col("x").cast("long"), F.lit(size).cast("long"))).otherwise(F.raise_error(message).cast("long"))
    own = t.plain()
    return replace(own, frame=own.frame.select(*own.index, checked.alias("x")))


def compile_index(t: Tensor, items: Sequence) -> _Plan:
    """Items are integers, slices, None, Ellipsis, (nested) lists or arrays of integers or booleans, and tensors of these."""
    spark = t.frame.sparkSession
    given = []
    for item in items:
        if isinstance(item, (list, np.ndarray)):
            item = constant(spark, item if np.asarray(item).size else np.zeros(np.shape(item), dtype=np.int64))
        given.append(item)
    mask = lambda item: isinstance(item, Tensor) and item.frame.schema[item.value].dataType.simpleString() == "boolean"
    takes = sum(item.ndim if mask(item) else 1 for item in given if item is not None and item is not Ellipsis)
    if takes > t.ndim:
        raise IndexError(f"too many indices: the tensor has {t.ndim} axes, {takes} were indexed")
    if sum(item is Ellipsis for item in given) > 1:
        raise IndexError("an index can have only one ellipsis")
    if not any(item is Ellipsis for item in given):
        given.append(Ellipsis)
    arrays = any(isinstance(item, Tensor) for item in given)
    parts, fixed, advanced, axis = [], [], [], 0
    for item in given:
        if item is None:
            parts.append(None)
        elif item is Ellipsis:
            for _ in range(t.ndim - takes):
                parts.append(_Slice.of(axis, slice(None), t.shape[axis]))
                axis += 1
        elif isinstance(item, slice):
            parts.append(_Slice.of(axis, item, t.shape[axis]))
            axis += 1
        elif isinstance(item, Tensor):
            count = item.ndim if mask(item) else 1
            if mask(item) and item.shape != t.shape[axis : axis + count]:
                raise IndexError(f"a mask of shape {item.shape} doesn't match {t.shape[axis:axis + count]}")
            advanced.append((axis, item))
            parts.append("picks")
            axis += count
        else:
            at = _integer(int(item), t.shape[axis], axis)
            fixed.append((axis, at))
            if arrays:  # beside arrays an integer is one of them: it counts for where the picks stand
                parts.append("picks")
            axis += 1
    if not arrays:
        return _Plan(tuple(parts), tuple(fixed))
    where = [k for k, part in enumerate(parts) if isinstance(part, str)]
    rest = [part for part in parts if not isinstance(part, str)]
    at = where[0] if where[-1] - where[0] == len(where) - 1 else 0
    joined, shape, picked = _picks(t, advanced, mask)
    return _Plan((*rest[:at], "picks", *rest[at:]), tuple(fixed), joined, shape, picked)


def _picks(t: Tensor, advanced: list[tuple[int, Tensor]], mask: Callable) -> tuple[DataFrame, tuple[int, ...], tuple[int, ...]]:
    """All integer arrays side by side, one row for each of their broadcast cells."""
    arrays: list[Tensor] = []
    axes: list[int] = []
    for axis, item in advanced:
        if not mask(item):
            arrays.append(_wrapped(item, t.shape[axis], axis))
            axes.append(axis)
            continue
        own = item.plain()
        true = with_positions(own.frame.filter("x"), list(own.index))
        if len(advanced) == 1:  # as it is: no need to join the mask's own columns again
            count = true.count()
            places = [F.col(c).alias(f"a{axis + k}") for k, c in enumerate(own.index)]
            return true.select(F.col("pos").cast("long").alias("b0"), *places), (count,), tuple(range(axis, axis + own.ndim))
        count = true.count()
        for k, c in enumerate(own.index):
            arrays.append(Tensor(true.select(F.col("pos").alias("d0"), F.col(c).alias("x")), (count,), ("d0",)))
            axes.append(axis + k)
    frame, shape = broadcast(*arrays)
    columns = [F.col(f"d{k}").alias(f"b{k}") for k in range(len(shape))] + [F.col(f"x{n}").alias(f"a{axis}") for n, axis in enumerate(axes)]
    return frame.select(*columns), shape, tuple(axes)


def _met(cells: DataFrame, plan: _Plan, how: str = "inner") -> DataFrame:
    if plan.picks is None:
        return cells
    condition = F.lit(True)
    for axis in plan.picked:
        condition = condition & (F.col(f"d{axis}") == F.col(f"a{axis}"))
    return cells.join(plan.picks, condition, how)


def get(t: Tensor, *items) -> Tensor:
    """The cells that an index selects, at their places in the result."""
    plan, own = compile_index(t, items), t.plain()
    chosen = _met(own.frame.filter(plan.inside()), plan)
    names = tuple(f"d{k}" for k in range(len(plan.shape)))
    return Tensor(chosen.select(*[p.alias(n) for p, n in zip(plan.places(), names)], "x"), plan.shape, names)


def put(t: Tensor, items: Sequence | object, value) -> Tensor:
    """``t`` with ``value`` (a number, a column of the frame's cells, or a tensor that broadcasts to the selection) where the index selects.

    A place that integer arrays name more than once gets its last value in C order. Cells that ``t`` lacks aren't made; cells
    that a given tensor lacks keep their value.
    """
    plan, own = compile_index(t, items if isinstance(items, tuple) else (items,)), t.plain()
    kind = own.frame.schema["x"].dataType
    if plan.picks is not None:
        last = F.max(F.struct(*[f"b{k}" for k in range(len(plan.picks_shape))])) if plan.picks_shape else F.lit(None)
        names = [f"a{axis}" for axis in plan.picked]
        latest = plan.picks.groupBy(*names).agg(last.alias("last"), F.lit(True).alias("hit"))
        plan = replace(plan, picks=latest.select(*names, "hit", *[F.col(f"last.b{k}").alias(f"b{k}") for k in range(len(plan.picks_shape))]))
    met = _met(own.frame, plan, "left")
    chosen = plan.inside() & (F.lit(True) if plan.picks is None else F.coalesce("hit", F.lit(False)))
    if not isinstance(value, Tensor):
        given = value if isinstance(value, Column) else F.lit(value)
        return replace(own, frame=met.select(*own.index, F.when(chosen, given.cast(kind)).otherwise(F.col("x")).alias("x")))
    if broadcast_shapes(value.shape, plan.shape) != plan.shape:
        raise ValueError(f"shape {value.shape} can't be broadcast to {plan.shape}")
    places = _aligned(value, plan.shape)
    used = [k for k, place in enumerate(places) if place is not None]
    new = value.plain().frame.select(*[places[k].alias(f"v{k}") for k in used], F.col("x").cast(kind).alias("new"), F.lit(True).alias("there"))
    at = plan.places()
    placed = met.select(*own.index, "x", chosen.alias("chosen"), *[at[k].alias(f"w{k}") for k in used])
    condition = F.col("chosen")
    for k in used:
        condition = condition & (F.col(f"w{k}") == F.col(f"v{k}"))
    final = F.when(F.coalesce("there", F.lit(False)), F.col("new")).otherwise(F.col("x"))
    return replace(own, frame=placed.join(new, condition, "left").select(*own.index, final.alias("x")))


def concatenate(*tensors: Tensor) -> Tensor:
    """Along the first axis, masked elements (NULL) kept; single elements count as vectors of one."""
    pieces = [t[None] if t.ndim == 0 else t for t in tensors]
    if len({t.shape[1:] for t in pieces}) > 1:
        raise ValueError("all axes but the first must have the same lengths")
    frame, at = None, 0
    for t in map(Tensor.plain, pieces):
        moved = t.frame.withColumn("d0", F.col("d0") + F.lit(at).cast("long"))
        frame, at = moved if frame is None else frame.unionByName(moved), at + t.shape[0]
    return Tensor(frame, (at, *pieces[0].shape[1:]), pieces[0].plain().index)
