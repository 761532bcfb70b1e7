"""Series in six polynomial bases whose coefficients are array columns, lowest degree first, as expressions.

A basis is stated by its recurrence x * P_k = up(k) * P_{k+1} + same(k) * P_k + down(k) * P_{k-1}; values, products,
powers, roots and matrices of values follow from it. Derivatives and integrals have closed forms by coefficient. A series
may be empty (zero); NULL gives NULL.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.dense import kernel
from tessera.operators.regression import lstsq

_Weight = Callable[[Column], Column]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is written, and worked out, once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _at(c: Column, k: Column) -> Column:
    """Coefficient k, zero beyond both ends."""
    return F.when((k >= 0) & (k < F.size(c)), F.get(c, k)).otherwise(0.0)


def _sum(c: Column, term: Callable[[Column], Column], begin: Column, step: int = 1) -> Column:
    """Sum of term(j) for j = begin, begin + step, ... below the size of c."""
    last = F.size(c) - 1
    places = F.when(begin <= last, F.sequence(begin, last, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.lit(0.0), lambda acc, j: acc + term(j))


@dataclass(frozen=True)
class Basis:
    name: str
    up: _Weight
    same: _Weight
    down: _Weight
    derivative: Callable[[Column, Column], Column]
    integral: Callable[[Column, Column], Column]
    domain: tuple[float, float]
    weight: Callable[[Column], Column]
    #: Coefficients of x.
    linear: tuple[float, float]

    def mulx(self, c: Column) -> Column:
        """Coefficients of x times the series."""
        term = lambda c, d: _at(c, d - 1) * self.up(d - 1) + _at(c, d) * self.same(d) + _at(c, d + 1) * self.down(d + 1)
        return _let(c, lambda c: F.transform(F.sequence(F.lit(0), F.size(c)), lambda d: term(c, d)))

    def add(self, a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))

    def sub(self, a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0)))

    def scale(self, c: Column, by: float | Column) -> Column:
        return F.transform(c, lambda x: x * by)

    def val(self, x: Column, c: Column, terms: int) -> Column:
        """Value of a series of up to ``terms`` coefficients."""
        values = self.values(x, terms)
        return _let(c, lambda c: sum((value * _at(c, F.lit(k)) for k, value in enumerate(values[1:], 1)), _at(c, F.lit(0))))

    def values(self, x: Column, terms: int) -> list[Column]:
        """P_0(x), P_1(x), ..., by the recurrence."""
        out = [F.lit(1.0)]
        while len(out) < terms:
            k = F.lit(len(out) - 1)
            before = out[-2] * self.down(k) if len(out) > 1 else F.lit(0.0)
            out.append((x * out[-1] - out[-1] * self.same(k) - before) / self.up(k))
        return out[:terms]

    def vander(self, x: Column, degree: int) -> Column:
        return F.array(*self.values(x, degree + 1))

    def vander2d(self, x: Column, y: Column, degrees: tuple[int, int]) -> Column:
        return F.array(*[a * b for a in self.values(x, degrees[0] + 1) for b in self.values(y, degrees[1] + 1)])

    def vander3d(self, x: Column, y: Column, z: Column, degrees: tuple[int, int, int]) -> Column:
        x, y, z = (self.values(v, d + 1) for v, d in zip((x, y, z), degrees))
        return F.array(*[a * b * c for a in x for b in y for c in z])

    def val2d(self, x: Column, y: Column, c: Sequence[Sequence[float]]) -> Column:
        """Sum of c[i][j] * P_i(x) * P_j(y)."""
        total = F.lit(0.0)
        for a, row in zip(self.values(x, len(c)), c):
            for b, weight in zip(self.values(y, len(row)), row):
                total = total + a * b * float(weight)
        return total

    def val3d(self, x: Column, y: Column, z: Column, c: Sequence[Sequence[Sequence[float]]]) -> Column:
        total = F.lit(0.0)
        for a, plane in zip(self.values(x, len(c)), c):
            total = total + a * self.val2d(y, z, plane)
        return total

    def mul(self, a: Sequence[float], c: Column) -> Column:
        """Product of a constant series with a column: its terms follow from the recurrence, with c in place of 1."""
        factors = F.array(*[F.lit(float(v)) for v in a])

        def step(acc: Column, k: Column) -> Column:
            now, before = acc["now"], acc["before"]
            rest = self.sub(self.sub(self.mulx(now), self.scale(now, self.same(k - 1))), self.scale(before, self.down(k - 1)))
            following = self.scale(rest, 1.0 / self.up(k - 1))
            return _let(following, lambda f: F.struct(now.alias("before"), f.alias("now"), self.add(acc["total"], self.scale(f, F.get(factors, k))).alias("total")))

        begin = _let(c, lambda c: F.struct(F.array().cast("array<double>").alias("before"), c.alias("now"), self.scale(c, float(a[0])).alias("total")))
        places = F.sequence(F.lit(1), F.lit(len(a) - 1)) if len(a) > 1 else F.array().cast("array<int>")
        return F.aggregate(places, begin, step, lambda acc: acc["total"])

    def pow(self, a: Sequence[float], power: int) -> Column:
        out = F.array(F.lit(1.0))
        for _ in range(power):
            out = self.mul(a, out)
        return out

    def fromroots(self, roots: Sequence[Column]) -> Column:
        """The product of x - r."""
        out = F.array(F.lit(1.0))
        for root in roots:
            out = self._without(out, root)
        return out

    def _without(self, c: Column, root: Column) -> Column:
        return _let(c, lambda c: self.sub(self.mulx(c), self.scale(c, root)))

    def line(self, offset: Column, slope: Column) -> Column:
        return F.array(offset + slope * self.linear[0], slope * self.linear[1])

    def der(self, c: Column) -> Column:
        return F.when(F.size(c) > 1, F.transform(F.sequence(F.lit(0), F.size(c) - 2), lambda k: self.derivative(c, k))).otherwise(F.array(F.lit(0.0)))

    def int(self, c: Column, terms: int) -> Column:
        """The integral that is 0 at 0, of up to ``terms`` coefficients."""
        raw = F.transform(F.sequence(F.lit(0), F.size(c)), lambda k: F.when(k == 0, 0.0).otherwise(self.integral(c, k)))
        return _let(raw, lambda raw: F.transform(raw, lambda x, k: F.when(k == 0, -self.val(F.lit(0.0), raw, terms + 1)).otherwise(x)))

    def convert(self, c: Column, to: Basis) -> Column:
        """The same polynomial as a series in another basis: this one's recurrence, run on coefficients of the other."""

        def step(acc: Column, k: Column) -> Column:
            now, before, c = acc["now"], acc["before"], acc["c"]
            rest = self.sub(self.sub(to.mulx(now), self.scale(now, self.same(k - 1))), self.scale(before, self.down(k - 1)))
            following = self.scale(rest, 1.0 / self.up(k - 1))
            return _let(following, lambda f: F.struct(now.alias("before"), f.alias("now"), self.add(acc["total"], self.scale(f, F.get(c, k))).alias("total"), c.alias("c")))

        begin = F.struct(F.array().cast("array<double>").alias("before"), F.array(F.lit(1.0)).alias("now"), F.slice(c, 1, 1).alias("total"), c.alias("c"))
        places = F.when(F.size(c) > 1, F.sequence(F.lit(1), F.size(c) - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(places, begin, step, lambda acc: acc["total"])

    def divmod(self, c: Column, by: Sequence[float]) -> tuple[Column, Column]:
        """Quotient and remainder of a series by a constant one in the same basis, whose last coefficient isn't 0.

        Both are brought to powers, divided from the highest degree down, and brought back.
        """
        powers = BASES["poly"]
        divisor = F.get(F.transform(F.array(F.array(*[F.lit(float(v)) for v in by])), lambda d: self.convert(d, powers)), F.lit(0))
        m = len(by) - 1

        def step(acc: Column, k: Column) -> Column:
            rem, d = acc["rem"], acc["d"]
            share = _at(rem, k + m) / F.get(d, F.lit(m))
            return _let(share, lambda q: F.struct(F.transform(rem, lambda x, i: x - q * _at(d, i - k)).alias("rem"), F.concat(F.array(q), acc["quo"]).alias("quo"), d.alias("d")))

        begin = F.struct(self.convert(c, powers).alias("rem"), F.array().cast("array<double>").alias("quo"), divisor.alias("d"))
        places = F.when(F.size(c) > m, F.reverse(F.sequence(F.lit(0), F.size(c) - 1 - m))).otherwise(F.array().cast("array<int>"))
        done = F.aggregate(places, begin, step)
        quotient = F.when(F.size(done["quo"]) > 0, done["quo"]).otherwise(F.array(F.lit(0.0)))
        remainder = F.when(F.lit(m == 0), F.array(F.lit(0.0))).otherwise(F.slice(done["rem"], 1, max(m, 1)))
        return powers.convert(quotient, self), powers.convert(remainder, self)

    def fit(self, frame: DataFrame, x: str, y: str, degree: int) -> list[float]:
        """Coefficients of least squares over all rows, from sums of products of values."""
        values = frame.select(*[v.alias(f"p{k}") for k, v in enumerate(self.values(F.col(x), degree + 1))], F.col(y).cast("double").alias("__y"))
        return [float(v) for v in lstsq(values, [f"p{k}" for k in range(degree + 1)], "__y")]

    def roots(self, frame: DataFrame, c: str, out: str = "y") -> DataFrame:
        """``frame`` with the complex roots of each row's series, by its powers."""
        return kernel(frame.withColumn("__powers", self.convert(F.col(c), BASES["poly"])), "polyroots", "__powers", out).drop("__powers")

    @property
    def zero(self) -> Column:
        return F.array(F.lit(0.0))

    @property
    def one(self) -> Column:
        return F.array(F.lit(1.0))

    @property
    def x(self) -> Column:
        return F.array(*[F.lit(v) for v in self.linear])

    def mapparms(self, domain: tuple[float, float]) -> tuple[float, float]:
        """Offset and scale that take ``domain`` to the basis's own."""
        (a, b), (low, high) = domain, self.domain
        scale = (high - low) / (b - a)
        return low - a * scale, scale

    def trim(self, c: Column, tolerance: float = 0.0) -> Column:
        """Without small coefficients at the end; one stays."""
        last = F.array_max(F.transform(c, lambda x, k: F.when(F.abs(x) > tolerance, k + 1).otherwise(1)))
        return F.slice(c, F.lit(1), last)


_one = lambda k: F.lit(1.0)
_none = lambda k: F.lit(0.0)

BASES: dict[str, Basis] = {
    "poly": Basis("poly", _one, _none, _none, lambda c, k: _at(c, k + 1) * (k + 1), lambda c, k: _at(c, k - 1) / k, (-1.0, 1.0), lambda x: F.lit(1.0), (0.0, 1.0)),
    "cheb": Basis(
        "cheb",
        lambda k: F.when(k == 0, 1.0).otherwise(0.5),
        _none,
        lambda k: F.lit(0.5),
        lambda c, k: _sum(c, lambda j: _at(c, j) * j, k + 1, 2) * F.when(k == 0, 1.0).otherwise(2.0),
        lambda c, k: (_at(c, k - 1) * F.when(k == 1, 2.0).otherwise(1.0) - _at(c, k + 1)) / (2 * k),
        (-1.0, 1.0),
        lambda x: 1 / (F.sqrt(1 + x) * F.sqrt(1 - x)),
        (0.0, 1.0),
    ),
    "leg": Basis(
        "leg",
        lambda k: (k + 1) / (2 * k + 1),
        _none,
        lambda k: k / (2 * k + 1),
        lambda c, k: _sum(c, lambda j: _at(c, j), k + 1, 2) * (2 * k + 1),
        lambda c, k: _at(c, k - 1) / (2 * k - 1) - _at(c, k + 1) / (2 * k + 3),
        (-1.0, 1.0),
        lambda x: F.lit(1.0),
        (0.0, 1.0),
    ),
    "herm": Basis("herm", lambda k: F.lit(0.5), _none, lambda k: k.cast("double"), lambda c, k: _at(c, k + 1) * 2 * (k + 1), lambda c, k: _at(c, k - 1) / (2 * k), (-1.0, 1.0), lambda x: F.exp(-x * x), (0.0, 0.5)),
    "herme": Basis("herme", _one, _none, lambda k: k.cast("double"), lambda c, k: _at(c, k + 1) * (k + 1), lambda c, k: _at(c, k - 1) / k, (-1.0, 1.0), lambda x: F.exp(-x * x / 2), (0.0, 1.0)),
    "lag": Basis(
        "lag",
        lambda k: -(k + 1.0),
        lambda k: 2.0 * k + 1,
        lambda k: -k.cast("double"),
        lambda c, k: -_sum(c, lambda j: _at(c, j), k + 1),
        lambda c, k: _at(c, k) - _at(c, k - 1),
        (0.0, 1.0),
        lambda x: F.exp(-x),
        (1.0, -1.0),
    ),
}
