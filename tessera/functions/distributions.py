"""Random draws as expressions: a row's key, a seed and a stream number give its uniforms, whatever the partitions.

A uniform is 52 bits of md5 over seed, stream and key, put in the middle of its cell, so it is never 0 or 1. Continuous
distributions invert their distribution function or combine normals (two uniforms each); where that has no closed form,
the first accepted one of TRIES proposals counts. Discrete ones count the cells of their distribution function below the
uniform; the table ends where doubles can't tell it from 1. Everything stays in expressions, so draws need no shuffle and no state,
reruns and retried tasks agree, and a NULL key gives NULL. Rows with one key draw the same.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TRIES = 32
CELLS = float(1 << 52)


def _once(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)``, with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


class Draws:
    """Distributions of one key column; every uniform of an expression has a stream number of its own."""

    def __init__(self, key: Column, seed: int = 0):
        self.key, self.seed = key.cast("string"), seed

    def spawn(self, child: int) -> Draws:
        """Draws independent of these: the child's number is part of the key."""
        return Draws(F.concat(self.key, F.lit(f"/{child}")), self.seed)

    def random(self, stream: int | Column = 0) -> Column:
        number = stream.cast("string") if isinstance(stream, Column) else F.lit(str(stream))
        digest = F.md5(F.concat(F.lit(f"{self.seed}|"), number, F.lit("|"), self.key))
        return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / CELLS

    def uniform(self, low: float = 0.0, high: float = 1.0) -> Column:
        return F.lit(low) + (high - low) * self.random()

    def integers(self, low: int, high: int, closed: bool = False) -> Column:
        """Whole numbers of [low, high), or up to high where ``closed``."""
        return (F.floor(self.random() * (high - low + closed)) + low).cast("bigint")

    def bytes(self, length: int) -> Column:
        blocks = [F.md5(F.concat(F.lit(f"{self.seed}|b{k}|"), self.key)) for k in range(-(-length // 16))]
        return F.unhex(F.substring(F.concat(*blocks), 1, 2 * length))

    def exponential(self, scale: float = 1.0) -> Column:
        return -F.log(self.random()) * scale

    def normal(self, loc: float = 0.0, scale: float = 1.0, stream: int | Column = 0) -> Column:
        """Of the streams ``stream`` and ``stream`` + 1."""
        return F.sqrt(-2 * F.log(self.random(stream))) * F.cos(2 * math.pi * self.random(stream + 1)) * scale + loc

    def lognormal(self, mean: float = 0.0, sigma: float = 1.0) -> Column:
        return F.exp(self.normal(mean, sigma))

    def standard_cauchy(self) -> Column:
        return F.tan(math.pi * (self.random() - 0.5))

    def laplace(self, loc: float = 0.0, scale: float = 1.0) -> Column:
        u = self.random() - 0.5
        return F.lit(loc) - scale * F.signum(u) * F.log(1 - 2 * F.abs(u))

    def logistic(self, loc: float = 0.0, scale: float = 1.0) -> Column:
        u = self.random()
        return F.lit(loc) + scale * F.log(u / (1 - u))

    def gumbel(self, loc: float = 0.0, scale: float = 1.0) -> Column:
        return F.lit(loc) - scale * F.log(-F.log(self.random()))

    def pareto(self, a: float) -> Column:
        return F.pow(self.random(), F.lit(-1 / a)) - 1

    def power(self, a: float) -> Column:
        return F.pow(self.random(), F.lit(1 / a))

    def weibull(self, a: float) -> Column:
        return F.pow(-F.log(self.random()), F.lit(1 / a))

    def rayleigh(self, scale: float = 1.0) -> Column:
        return F.sqrt(-2 * F.log(self.random())) * scale

    def triangular(self, left: float, mode: float, right: float) -> Column:
        u, width = self.random(), right - left
        rising = F.lit(left) + F.sqrt(u * width * (mode - left))
        return F.when(u < (mode - left) / width, rising).otherwise(F.lit(right) - F.sqrt((1 - u) * width * (right - mode)))

    def wald(self, mean: float, scale: float) -> Column:
        """The smaller root of the transformed normal, or the larger one with the complementary chance."""
        y = F.pow(self.normal(), F.lit(2.0)) * mean
        x = F.lit(mean) + mean / (2 * scale) * (y - F.sqrt(4 * scale * y + y * y))
        return F.when(self.random(2) <= mean / (mean + x), x).otherwise(mean * mean / x)

    def _first(self, propose: Callable[[Column], Column], kind: str = "double") -> Column:
        """The first proposal that isn't NULL, of TRIES; those after it are not worked out."""
        return F.aggregate(F.sequence(F.lit(0), F.lit(TRIES - 1)), F.lit(None).cast(kind), lambda found, k: F.coalesce(found, propose(k)))

    def standard_gamma(self, shape: float, stream: int = 0) -> Column:
        """Cubes of shifted normals, accepted by a uniform; shapes below 1 are lifted by 1 and scaled back."""
        lifted = shape if shape >= 1 else shape + 1
        d = lifted - 1 / 3
        c = 1 / math.sqrt(9 * d)

        def propose(k: Column) -> Column:
            at = F.lit(1000 + 100 * stream) + 3 * k
            of = lambda z, v: F.when((v > 0) & (F.log(self.random(at + 2)) < z * z / 2 + d - d * v + d * F.log(v)), d * v)
            return _once(self.normal(stream=at), lambda z: _once(F.pow(1 + c * z, F.lit(3.0)), lambda v: of(z, v)))

        drawn = self._first(propose)
        return drawn if shape >= 1 else drawn * F.pow(self.random(900 + stream), F.lit(1 / shape))

    def gamma(self, shape: float, scale: float = 1.0) -> Column:
        return self.standard_gamma(shape) * scale

    def chisquare(self, df: float, stream: int = 0) -> Column:
        return self.standard_gamma(df / 2, stream) * 2

    def beta(self, a: float, b: float) -> Column:
        return _once(self.standard_gamma(a), lambda x: x / (x + self.standard_gamma(b, 1)))

    def f(self, dfnum: float, dfden: float) -> Column:
        return (self.chisquare(dfnum) / dfnum) / (self.chisquare(dfden, 1) / dfden)

    def standard_t(self, df: float) -> Column:
        return self.normal() / F.sqrt(self.chisquare(df) / df)

    def noncentral_chisquare(self, df: float, nonc: float) -> Column:
        """For more than one degree of freedom: one of them carries the shift."""
        return F.pow(self.normal() + math.sqrt(nonc), F.lit(2.0)) + self.chisquare(df - 1)

    def noncentral_f(self, dfnum: float, dfden: float, nonc: float) -> Column:
        return (self.noncentral_chisquare(dfnum, nonc) / dfnum) / (self.chisquare(dfden, 1) / dfden)

    def dirichlet(self, alpha: Sequence[float]) -> Column:
        parts = F.array(*[self.standard_gamma(a, k) for k, a in enumerate(alpha)])
        total = lambda p: F.aggregate(p, F.lit(0.0), lambda acc, x: acc + x)
        return F.get(F.transform(F.array(parts), lambda p: F.transform(p, lambda x: x / total(p))), F.lit(0))

    def multivariate_normal(self, mean: Sequence[float], root: Sequence[Sequence[float]]) -> Column:
        """``root`` is the lower triangular root of the covariance."""
        z = [self.normal(stream=2 * k) for k in range(len(mean))]
        return F.array(*[sum((z[j] * float(w) for j, w in enumerate(row)), F.lit(float(m))) for m, row in zip(mean, root)])

    def vonmises(self, mu: float, kappa: float) -> Column:
        """Angles of wrapped Cauchy proposals, accepted by a uniform."""
        tau = 1 + math.sqrt(1 + 4 * kappa * kappa)
        rho = (tau - math.sqrt(2 * tau)) / (2 * kappa)
        r = (1 + rho * rho) / (2 * rho)

        def propose(k: Column) -> Column:
            at = F.lit(1000) + 3 * k
            z = F.cos(math.pi * self.random(at))
            w = (1 + r * z) / (r + z)
            y, u = kappa * (r - w), self.random(at + 1)
            return F.when((y * (2 - y) >= u) | (F.log(y / u) + 1 - y >= 0), F.signum(self.random(at + 2) - 0.5) * F.acos(w))

        angle = self._first(propose) + mu
        return F.pmod(angle + math.pi, F.lit(2 * math.pi)) - math.pi

    def cells(self, probabilities: Sequence[float], stream: int | Column = 0) -> Column:
        """Number of the cell of a distribution in which a uniform falls, from 0."""
        bounds, total = [], 0.0
        for p in probabilities[:-1]:
            total += p
            bounds.append(F.lit(total))
        u = self.random(stream)
        return F.get(F.transform(F.array(u), lambda v: F.size(F.filter(F.array(*bounds), lambda b: b < v))), F.lit(0)) if bounds else F.lit(0)

    def poisson(self, lam: float) -> Column:
        return self.cells([math.exp(k * math.log(lam) - lam - math.lgamma(k + 1)) for k in range(int(lam + 12 * math.sqrt(lam) + 25))])

    def binomial(self, n: int, p: float) -> Column:
        return self.cells(binomial_cells(n, p))

    def negative_binomial(self, n: float, p: float) -> Column:
        mean, spread = n * (1 - p) / p, math.sqrt(n * (1 - p)) / p
        last = int(mean + 20 * spread + 40 / p)
        return self.cells([math.exp(math.lgamma(k + n) - math.lgamma(n) - math.lgamma(k + 1) + n * math.log(p) + k * math.log1p(-p)) for k in range(last)])

    def geometric(self, p: float) -> Column:
        return F.greatest(F.ceil(F.log(self.random()) / math.log1p(-p)), F.lit(1)).cast("int")

    def hypergeometric(self, good: int, bad: int, draws: int) -> Column:
        first = max(0, draws - bad)
        ways = math.comb(good + bad, draws)
        return self.cells([math.comb(good, k) * math.comb(bad, draws - k) / ways for k in range(first, min(good, draws) + 1)]) + first

    def logseries(self, p: float) -> Column:
        """By two uniforms, whole numbers whose chance falls as p^k / k."""
        q = 1 - F.pow(F.lit(1 - p), self.random())
        return F.when(self.random(1) >= p, F.lit(1)).otherwise(F.floor(1 + F.log(self.random(1)) / F.log(q))).cast("bigint")

    def zipf(self, a: float) -> Column:
        """Rounded powers of uniforms, accepted by their ratio to the chance wanted."""
        b = 2 ** (a - 1)

        def propose(k: Column) -> Column:
            at = F.lit(1000) + 2 * k
            x = F.floor(F.pow(self.random(at), F.lit(-1 / (a - 1))))
            t = F.pow(1 + 1 / x, F.lit(a - 1))
            return F.when(self.random(at + 1) * x * (t - 1) / (b - 1) <= t / b, x)

        return self._first(propose, "bigint")

    def multinomial(self, n: int, probabilities: Sequence[float]) -> Column:
        """How many of n draws fall in each cell."""
        drawn = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: self.cells(probabilities, k))
        return F.get(F.transform(F.array(drawn), lambda d: F.array(*[_places_of(d, F.lit(c)) for c in range(len(probabilities))])), F.lit(0))

    def multivariate_hypergeometric(self, colors: Sequence[int], draws: int) -> Column:
        """How many of each colour are among the ``draws`` smallest uniforms of an urn."""
        urn = F.array(*[F.lit(c) for c, n in enumerate(colors) for _ in range(n)])
        ranked = F.array_sort(F.transform(urn, lambda c, k: F.struct(self.random(k).alias("u"), c.alias("c"))))
        return F.get(F.transform(F.array(F.transform(F.slice(ranked, 1, draws), lambda x: x["c"])), lambda d: F.array(*[_places_of(d, F.lit(c)) for c in range(len(colors))])), F.lit(0))


def _places_of(values: Column, value: Column) -> Column:
    return F.size(F.filter(values, lambda x: x == value))


def binomial_cells(n: int, p: float) -> list[float]:
    """Chances of 0 to n, by logarithms, so that none underflows on the way."""
    if p in (0.0, 1.0):
        return [float(k == n * p) for k in range(n + 1)]
    return [math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)) for k in range(n + 1)]


def choice(frame: DataFrame, key: str, size: int, seed: int = 0) -> DataFrame:
    """``size`` rows without replacement, by the smallest uniforms (ties to the smaller key): partial tops, then one merge."""
    return frame.orderBy(Draws(F.col(key), seed).random(), key).limit(size)


def permuted(frame: DataFrame, key: str, keys: Sequence[str], seed: int = 0, out: str = "pos") -> DataFrame:
    """Rows with their place, from 0, in a random order within each group of ``keys``."""
    over = Window.partitionBy(*keys).orderBy("__u", key)
    return frame.withColumn("__u", Draws(F.col(key), seed).random()).withColumn(out, F.row_number().over(over) - 1).drop("__u")


def permutation(frame: DataFrame, key: str, seed: int = 0, out: str = "pos") -> DataFrame:
    """Rows with their place, from 0, in a random order of the whole frame; ranges of the uniforms are numbered side by side."""
    from tessera.operators.window import with_positions

    return with_positions(frame.withColumn("__u", Draws(F.col(key), seed).random()), ["__u", key], out).drop("__u")
