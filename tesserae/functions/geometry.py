"""Vectors and rigid motions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def minus(a: Vector, b: Vector) -> Vector:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def _clamped(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0))


def angle(origin: Vector, a: Vector, b: Vector) -> Column:
    """The angle at the origin between a and b, from 0 to pi."""
    p, q = minus(a, origin), minus(b, origin)
    return F.acos(_clamped(dot(p, q) / (F.sqrt(dot(p, p)) * F.sqrt(dot(q, q)) + 1e-6)))


def signed_angle(origin: Vector, a: Vector, b: Vector, normal: Vector) -> Column:
    """The angle from a to b seen along the normal, from 0 to 2 pi."""
    p, q = minus(a, origin), minus(b, origin)
    scale = (F.sqrt(dot(p, p)) + 1e-6) * (F.sqrt(dot(q, q)) + 1e-6)
    c = cross(p, q)
    size = F.atan2(F.sqrt(dot(c, c)) / scale, _clamped(dot(p, q) / scale))
    return F.when(dot(c, normal) < 0, 2 * F.pi() - size).otherwise(size)


def rigid(point: Vector, matrix: list[float]) -> Vector:
    """A point under a 4 x 4 matrix, row by row."""
    return tuple(point[0] * matrix[4 * r] + point[1] * matrix[4 * r + 1] + point[2] * matrix[4 * r + 2] + matrix[4 * r + 3] for r in range(3))
