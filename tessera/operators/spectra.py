"""Fourier transforms of a vector frame longer than a task can hold, in four steps.

A vector of n = rows * columns elements is a matrix whose columns are transformed first, each by itself; then every element is
turned by its twiddle factor, one shuffle makes rows of what were columns, and rows are transformed. A task holds one column
or row at a time, about the square root of n elements. Where n has no divisor near its root, the transform is written as a
convolution with a chirp, which transforms of the next power of two make.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = "pos long, re double, im double"
#: How far the smaller side may be from the root of n before a chirp is used.
LOPSIDED = 16


def _sides(n: int) -> tuple[int, int]:
    """Rows and columns: the largest divisor up to the root of n, and what it leaves."""
    rows = next(d for d in range(math.isqrt(n), 0, -1) if n % d == 0)
    return rows, n // rows


def _turn(product: Column, n: int, sign: int) -> tuple[Column, Column]:
    """Real and imaginary part of exp(sign * 2 pi i * product / n); the product is taken modulo n first."""
    angle = F.pmod(product.cast("long"), F.lit(n).cast("long")) * (sign * 2 * math.pi / n)
    return F.cos(angle), F.sin(angle)


def _times(re: Column, im: Column, other: tuple[Column, Column]) -> tuple[Column, Column]:
    return re * other[0] - im * other[1], re * other[1] + im * other[0]


def _lines(frame: DataFrame, size: int, sign: int) -> DataFrame:
    """Transform every line of ``size`` places; cells are (line, at, re, im), and missing ones are 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cells = None, np.zeros(size, dtype=complex)

        def done() -> pa.RecordBatch:
            made = np.fft.fft(cells) if sign < 0 else np.fft.ifft(cells) * size
            return pa.RecordBatch.from_arrays([pa.array(np.full(size, now)), pa.array(np.arange(size)), pa.array(made.real.copy()), pa.array(made.imag.copy())], names=["line", "at", "re", "im"])

        for batch in batches:
            line, at, re, im = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("line", "at", "re", "im"))
            bounds = [0, *(np.flatnonzero(np.diff(line)) + 1).tolist(), len(line)]
            for begin, end in zip(bounds, bounds[1:]):
                if begin == end:
                    continue
                if now is not None and line[begin] != now:
                    yield done()
                    cells[:] = 0
                now = line[begin]
                cells[at[begin:end]] = re[begin:end] + 1j * im[begin:end]
        if now is not None:
            yield done()

    dealt = frame.select("line", "at", "re", "im").repartition("line").sortWithinPartitions("line")
    return dealt.mapInArrow(run, "line long, at long, re double, im double")


def _direct(cells: DataFrame, n: int, sign: int) -> DataFrame:
    rows, columns = _sides(n)
    first = cells.select((F.col("pos") % columns).alias("line"), F.expr(f"pos div {columns}").alias("at"), "re", "im")
    turned = _lines(first, rows, sign)
    re, im = _times(F.col("re"), F.col("im"), _turn(F.col("line") * F.col("at"), n, sign))
    second = _lines(turned.select(F.col("at").alias("line"), F.col("line").alias("at"), re.alias("re"), im.alias("im")), columns, sign)
    return second.select((F.col("at") * rows + F.col("line")).alias("pos"), "re", "im")


def _chirped(cells: DataFrame, n: int, sign: int) -> DataFrame:
    """A transform of any length as a convolution: 2 j k = j * j + k * k - (k - j) * (k - j)."""
    size = 1 << (2 * n - 1).bit_length()
    square = lambda p: F.pmod(p * p, F.lit(2 * n).cast("long"))  # noqa: E731  places are below 2 ** 31 here
    re, im = _times(F.col("re"), F.col("im"), _turn(square(F.col("pos")), 2 * n, sign))
    spectrum = _direct(cells.select("pos", re.alias("re"), im.alias("im")), size, -1)
    places = cells.sparkSession.range(-(n - 1), n).select("id")
    c, s = _turn(square(F.col("id")), 2 * n, -sign)
    chirp = _direct(places.select(F.pmod("id", F.lit(size).cast("long")).alias("pos"), c.alias("re"), s.alias("im")), size, -1)
    joined = spectrum.join(chirp.select("pos", F.col("re").alias("c"), F.col("im").alias("s")), "pos")
    re, im = _times(F.col("re"), F.col("im"), (F.col("c"), F.col("s")))
    back = _direct(joined.select("pos", (re / size).alias("re"), (im / size).alias("im")), size, 1).filter(F.col("pos") < n)
    re, im = _times(F.col("re"), F.col("im"), _turn(square(F.col("pos")), 2 * n, sign))
    return back.select("pos", re.alias("re"), im.alias("im"))


def _scaled(cells: DataFrame, n: int, inverse: bool, norm: str) -> DataFrame:
    by = {"backward": 1 / n if inverse else 1.0, "forward": 1.0 if inverse else 1 / n, "ortho": 1 / math.sqrt(n)}[norm]
    return cells.select("pos", (F.col("re") * by).alias("re"), (F.col("im") * by).alias("im"))


def transform(frame: DataFrame, re: Column, im: Column | None = None, pos: str = "pos", n: int | None = None, inverse: bool = False, norm: str = "backward") -> DataFrame:
    """fft and ifft of a whole vector: (pos, re, im). Places from 0; missing places and NULL are 0.

    ``n`` cuts the vector or fills it up with zeros; by default it ends with the last place. An empty vector gives no rows.
    """
    part = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    cells = frame.select(F.col(f"`{pos}`").cast("long").alias("pos"), part(re).alias("re"), (part(im) if im is not None else F.lit(0.0)).alias("im"))
    if n is None:
        top = cells.agg(F.max("pos")).first()[0]
        n = 0 if top is None else top + 1
    if n < 1:
        return cells.limit(0)
    sign = 1 if inverse else -1
    cells = cells.filter(F.col("pos") < n)
    rows, columns = _sides(n)
    made = _chirped(cells, n, sign) if columns > LOPSIDED * rows and n > 4096 else _direct(cells, n, sign)
    return _scaled(made, n, inverse, norm)


def rfft(frame: DataFrame, x: Column, pos: str = "pos", n: int | None = None, norm: str = "backward") -> DataFrame:
    """The first half of the transform of real numbers; the other half is its mirror image."""
    if n is None:
        top = frame.agg(F.max(F.col(f"`{pos}`"))).first()[0]
        n = 0 if top is None else top + 1
    return transform(frame, x, None, pos, n, norm=norm).filter(F.col("pos") <= n // 2)


def irfft(half: DataFrame, n: int, norm: str = "backward") -> DataFrame:
    """(pos, x): the n real numbers that have this half of a transform."""
    mirrored = half.filter((F.col("pos") > 0) & (F.col("pos") < n - F.col("pos"))).select((n - F.col("pos")).alias("pos"), "re", (-F.col("im")).alias("im"))
    whole = half.select("pos", "re", "im").union(mirrored)
    return transform(whole, F.col("re"), F.col("im"), n=n, inverse=True, norm=norm).select("pos", F.col("re").alias("x"))
