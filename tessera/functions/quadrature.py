"""Gauss quadrature of five weights, Chebyshev points and interpolation, and values from roots, as expressions of columns.

Nodes are the eigenvalues of the weight's symmetric tridiagonal matrix, found by implicit shifts; a node's weight is the
squared first component of its eigenvector times the weight's integral. Nodes and weights are a few numbers of a rule's
degree; what is integrated are expressions of each row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def tridiagonal(diagonal: Sequence[float], beside: Sequence[float]) -> tuple[list[float], list[float]]:
    """Ascending eigenvalues of a symmetric tridiagonal matrix, and the first component of each one's unit eigenvector."""
    d, e = [float(v) for v in diagonal], [*map(float, beside), 0.0]
    n = len(d)
    first = [1.0, *[0.0] * (n - 1)]
    for low in range(n):
        for _ in range(60 * n):
            high = low
            while high < n - 1 and abs(e[high]) > 1e-17 * (abs(d[high]) + abs(d[high + 1])):
                high += 1
            if high == low:
                break
            # The shift is the eigenvalue of the leading two rows that lies nearer to the first.
            g = (d[low + 1] - d[low]) / (2 * e[low])
            g = d[high] - d[low] + e[low] / (g + math.copysign(math.hypot(g, 1.0), g))
            sine = cosine = 1.0
            less = 0.0
            for i in range(high - 1, low - 1, -1):
                f, b = sine * e[i], cosine * e[i]
                r = math.hypot(f, g)
                e[i + 1] = r
                if r == 0:
                    d[i + 1] -= less
                    e[high] = 0.0
                    break
                sine, cosine = f / r, g / r
                g = d[i + 1] - less
                r = (d[i] - g) * sine + 2 * cosine * b
                less = sine * r
                d[i + 1] = g + less
                g = cosine * r - b
                first[i + 1], first[i] = sine * first[i] + cosine * first[i + 1], cosine * first[i] - sine * first[i + 1]
            else:
                d[low] -= less
                e[low], e[high] = g, 0.0
    order = sorted(range(n), key=d.__getitem__)
    return [d[k] for k in order], [first[k] for k in order]


#: By basis: the tridiagonal matrix's diagonal and the squares beside it, and the integral of the weight.
_JACOBI: dict[str, tuple[Callable[[int], float], Callable[[int], float], float]] = {
    "leg": (lambda k: 0.0, lambda k: k * k / (4 * k * k - 1), 2.0),
    "herm": (lambda k: 0.0, lambda k: k / 2, math.sqrt(math.pi)),
    "herme": (lambda k: 0.0, lambda k: float(k), math.sqrt(2 * math.pi)),
    "lag": (lambda k: 2.0 * k + 1, lambda k: float(k * k), 1.0),
}


def gauss(basis: str, degree: int) -> tuple[list[float], list[float]]:
    """Nodes and weights of leggauss, chebgauss, hermgauss, hermegauss and laggauss: exact up to degree 2 * ``degree`` - 1."""
    if degree < 1:
        raise ValueError("a rule has a node at least")
    if basis == "cheb":
        return [math.cos(math.pi * (2 * k - 1) / (2 * degree)) for k in range(1, degree + 1)], [math.pi / degree] * degree
    diagonal, beside, whole = _JACOBI[basis]
    nodes, first = tridiagonal([diagonal(k) for k in range(degree)], [math.sqrt(beside(k)) for k in range(1, degree)])
    if basis != "lag":  # the rules are symmetric
        nodes = [(a - b) / 2 for a, b in zip(nodes, reversed(nodes))]
        first = [math.sqrt((a * a + b * b) / 2) for a, b in zip(first, reversed(first))]
    return nodes, [whole * c * c for c in first]


def integrate(function: Callable[[Column], Column], basis: str, degree: int) -> Column:
    """The integral of an expression times the basis's weight over its range."""
    rule = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(w).alias("w")) for x, w in zip(*gauss(basis, degree))])
    return F.aggregate(rule, F.lit(0.0), lambda total, p: total + p["w"] * function(p["x"]))


def chebyshev_points(n: int, ends: bool = False) -> list[float]:
    """chebpts1, and chebpts2 with the ends: ascending."""
    if ends:
        return [math.sin(math.pi * (2 * k - (n - 1)) / (2 * (n - 1))) for k in range(n)]
    return [math.sin(math.pi * (2 * k - (n - 1)) / (2 * n)) for k in range(n)]


def chebyshev_interpolate(function: Callable[[Column], Column], degree: int) -> Column:
    """Coefficients of the Chebyshev series that meets an expression at the points of the first kind: a discrete cosine sum."""
    n = degree + 1
    points = chebyshev_points(n)
    terms = [[math.cos(k * math.acos(max(-1.0, min(1.0, x)))) * (1 if k == 0 else 2) / n for x in points] for k in range(n)]
    values = F.transform(F.array(*[F.lit(x) for x in points]), function)
    dot = lambda row: F.aggregate(F.zip_with(values, F.array(*[F.lit(t) for t in row]), lambda a, b: a * b), F.lit(0.0), lambda total, v: total + v)
    return F.array(*[dot(row) for row in terms])


def value_from_roots(x: Column, roots: Column) -> Column:
    """polyvalfromroots: the product of x - root over an array of roots; 1 without roots."""
    return F.aggregate(roots.cast("array<double>"), F.lit(1.0), lambda total, r: total * (x - r))


def companion(c: Sequence[Column]) -> Column:
    """The matrix whose eigenvalues are the roots of a power series (coefficients from the lowest), as an array of rows."""
    n = len(c) - 1
    return F.array(*[F.array(*[(F.lit(1.0) if i == j + 1 else F.lit(0.0)) - (c[i] / c[n] if j == n - 1 else F.lit(0.0)) for j in range(n)]) for i in range(n)])
