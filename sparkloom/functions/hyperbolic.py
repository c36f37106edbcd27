"""SCA5: hyperbolic geometry as column expressions over arrays of doubles.

A point of the Lorentz model is (x0, x1, ..., xd) with <x, x> = -1, where <x, y> = -x0 y0 + x1 y1 + ... + xd yd.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Guards against leaving the domain of a function.
EPS, MAX_TANGENT, MAX_NORM = 1e-7, 50.0, 1 - 1e-5


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def dot(x: Column, y: Column) -> Column:
    return _sum(F.zip_with(x, y, lambda a, b: a * b))


def scaled(x: Column, by: Column) -> Column:
    return F.transform(x, lambda v: v * by)


def plus(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a + b)


def inner(x: Column, y: Column) -> Column:
    """<x, y>."""
    return dot(x, y) - 2 * x[0] * y[0]


def distance(x: Column, y: Column) -> Column:
    """acosh(-<x, y>), with the argument held to 1 + EPS at least."""
    return F.acosh(F.greatest(-inner(x, y), F.lit(1 + EPS)))


def norm(v: Column) -> Column:
    """The length of a tangent vector."""
    return F.sqrt(F.greatest(inner(v, v), F.lit(EPS)))


def origin(dim: int) -> Column:
    return F.array(F.lit(1.0), *([F.lit(0.0)] * dim))


def exp_map(v: Column, base: Column) -> Column:
    """The point at which the geodesic from base along v arrives."""
    n = F.least(norm(v), F.lit(MAX_TANGENT))
    return project(plus(scaled(base, F.cosh(n)), scaled(v, F.sinh(n) / n)))


def log_map(x: Column, base: Column) -> Column:
    """The tangent vector at base that leads to x."""
    c = F.greatest(-inner(base, x), F.lit(1 + EPS))
    return scaled(plus(x, scaled(base, -c)), F.acosh(c) / F.sqrt(c * c - 1))


def transport(v: Column, source: Column, target: Column) -> Column:
    """v moved along the geodesic from source to target."""
    factor = inner(target, v) / F.greatest(1 - inner(source, target), F.lit(EPS))
    return plus(v, scaled(plus(source, target), factor))


def project(x: Column) -> Column:
    """x with its first coordinate set so that <x, x> = -1."""
    rest = F.slice(x, F.lit(2), F.size(x) - 1)
    return F.concat(F.array(F.sqrt(1 + dot(rest, rest))), rest)


def lift(x: Column) -> Column:
    """The Lorentz point over a vector of the space beneath."""
    return F.concat(F.array(F.sqrt(1 + dot(x, x))), x)


def to_ball(x: Column) -> Column:
    """From the Lorentz model to the Poincare ball."""
    return F.transform(F.slice(x, F.lit(2), F.size(x) - 1), lambda v: v / (x[0] + 1))


def from_ball(p: Column) -> Column:
    """From the Poincare ball to the Lorentz model."""
    s = dot(p, p)
    return F.concat(F.array((1 + s) / F.greatest(1 - s, F.lit(EPS))), F.transform(p, lambda v: 2 * v / F.greatest(1 - s, F.lit(EPS))))


def into_ball(p: Column) -> Column:
    """p moved inside the ball where it is not."""
    n = F.sqrt(dot(p, p))
    return F.transform(p, lambda v: F.when(n > MAX_NORM, v / n * MAX_NORM).otherwise(v))


def ball_distance(p: Column, q: Column) -> Column:
    """The Poincare distance."""
    gap = _sum(F.zip_with(p, q, lambda a, b: (a - b) * (a - b)))
    below = F.greatest((1 - dot(p, p)) * (1 - dot(q, q)), F.lit(EPS))
    return F.acosh(F.greatest(1 + 2 * gap / below, F.lit(1 + EPS)))


def mobius_add(p: Column, q: Column) -> Column:
    """The Moebius sum of two points of the ball."""
    pp, qq, pq = dot(p, p), dot(q, q), dot(p, q)
    below = F.greatest(1 + 2 * pq + pp * qq, F.lit(EPS))
    return F.zip_with(p, q, lambda a, b: ((1 + 2 * pq + qq) * a + (1 - pp) * b) / below)
