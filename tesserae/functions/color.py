"""Colour conversions as column expressions, so that they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sRGB to XYZ matrix (D65), its inverse, the white point, and the limits of the two curves.
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
FROM_XYZ = ((3.2406, -1.5372, -0.4986), (-0.9689, 1.8758, 0.0415), (0.0557, -0.2040, 1.0570))
WHITE = (0.950456, 1.0, 1.088754)
EPSILON, KAPPA = 0.008856, 903.3


def rescale(c: Column, scale: float = 255.0) -> Column:
    return c / F.lit(scale)


def linear(c: Column) -> Column:
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def gamma(c: Column) -> Column:
    return F.when(c <= 0.0031308, c * 12.92).otherwise(F.pow(c, F.lit(1 / 2.4)) * 1.055 - 0.055)


def _dot(row: tuple, columns: list[Column]) -> Column:
    return sum(c * F.lit(k) for k, c in zip(row, columns, strict=True))


def lab_curve(t: Column) -> Column:
    return F.when(t > EPSILON, F.cbrt(t)).otherwise((t * KAPPA + 16) / 116)


def rgb_to_lab(r: Column, g: Column, b: Column, order: str = "rgb") -> list[Column]:
    """L / -100, a / 100 and b / 100 of colours in [0, 1]. order says which channel comes first."""
    if order not in ("rgb", "bgr"):
        raise ValueError("order is rgb or bgr")
    channels = [linear(c) for c in ((r, g, b) if order == "rgb" else (b, g, r))]
    x, y, z = (lab_curve(_dot(row, channels) / F.lit(w)) for row, w in zip(TO_XYZ, WHITE, strict=True))
    return [(y * 116 - 16) / -100, (x - y) * 500 / 100, (y - z) * 200 / 100]


def lab_to_rgb(light: Column, a: Column, b: Column) -> list[Column]:
    """The inverse, clamped to [0, 1]."""
    y = (light * -100 + 16) / 116
    parts = [(a * 100 / 500 + y), y, (y - b * 100 / 200)]
    xyz = [F.when(p * p * p > EPSILON, p * p * p).otherwise((p - 16 / 116) / 7.787) * F.lit(w) for p, w in zip(parts, WHITE, strict=True)]
    return [F.least(F.greatest(gamma(F.greatest(_dot(row, xyz), F.lit(0.0))), F.lit(0.0)), F.lit(1.0)) for row in FROM_XYZ]


def luminance(r: Column, g: Column, b: Column) -> Column:
    return r * 0.2126 + g * 0.7152 + b * 0.0722
