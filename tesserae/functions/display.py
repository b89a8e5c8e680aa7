"""Palettes, background fill and table formats."""

from __future__ import annotations

import colorsys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def colour_wheel(n: int) -> list[tuple[float, float, float]]:
    """n colours at equal steps of hue, both ends included."""
    return [colorsys.hsv_to_rgb(i / (n - 1) if n > 1 else 0.0, 1.0, 1.0) for i in range(n)]


def brightness(colours: list[tuple[float, float, float]], factor: float) -> list[tuple[float, ...]]:
    return [tuple(min(1.0, max(0.0, c * factor)) for c in rgb) for rgb in colours]


def painted(df: DataFrame, label: str, palette: list[tuple[float, ...]]) -> DataFrame:
    """df with r, g, b of its label, taken from a constant palette in turn; null labels stay null."""
    colours = F.array(*(F.array(*(F.lit(float(c)) for c in rgb)) for rgb in palette))
    own = F.element_at(colours, F.col(label) % len(palette) + 1)
    return df.withColumns({n: F.element_at(own, i + 1) for i, n in enumerate("rgb")})


def with_background(label: str, value: Column, background: float) -> Column:
    return F.when(F.col(label).isNull(), F.lit(float(background))).otherwise(value)


def blend(a: Column, b: Column, alpha: float) -> Column:
    return a * (1 - alpha) + b * alpha


def formatted(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Columns whose names begin with a key are shown with so many digits."""
    out = {}
    for name in df.columns:
        for prefix, n in digits.items():
            if name.startswith(prefix):
                out[name] = F.format_string(f"%.{n}f", F.col(name).cast("double"))
    return df.withColumns(out) if out else df
