"""Neighbourhoods on the pixel grid: windows after one repartition by frame, so that all share its shuffle.

A frame is named by t, or by video and t where the table has a column video.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

AROUND = {"n": (-1, 0), "s": (1, 0), "w": (0, -1), "e": (0, 1), "nw": (-1, -1), "ne": (-1, 1), "sw": (1, -1), "se": (1, 1)}


def video_key(df: DataFrame) -> list[str]:
    return [c for c in ("video",) if c in df.columns]


def frame_key(df: DataFrame) -> list[str]:
    return [*video_key(df), "t"]


def by_frame(df: DataFrame) -> DataFrame:
    """One shuffle by frame; windows and sums on (t, ...) need no other."""
    return df.repartition(*frame_key(df))


def lines(df: DataFrame) -> tuple[Window, Window]:
    """Windows along the rows and along the columns of each frame."""
    key = frame_key(df)
    return Window.partitionBy(*key, "y").orderBy("x"), Window.partitionBy(*key, "x").orderBy("y")


def neighbours(df: DataFrame, column: str = "spix", diagonal: bool = True) -> DataFrame:
    """df with the column's value at each neighbour: n, s, w, e, and nw, ne, sw, se. Outside the frame: null.

    Rows must hold every pixel of the rectangle (missing labels as null), as windows step from row to row.
    """
    row, col = lines(df)
    c = F.col(column)
    out = by_frame(df).select("*", F.lag(c).over(row).alias("w"), F.lead(c).over(row).alias("e"))
    out = out.select("*", F.lag(c).over(col).alias("n"), F.lead(c).over(col).alias("s"), *([F.lag("w").over(col).alias("nw"), F.lag("e").over(col).alias("ne"), F.lead("w").over(col).alias("sw"), F.lead("e").over(col).alias("se")] if diagonal else []))
    return out


def border(df: DataFrame, column: str = "spix") -> DataFrame:
    """df with is_border: on the frame's edge, or one of the four neighbours differs."""
    out = neighbours(df, column, diagonal=False)
    differs = [F.col(d).isNull() | (F.col(d) != F.col(column)) for d in "nswe"]
    return out.withColumn("is_border", differs[0] | differs[1] | differs[2] | differs[3]).drop(*"nswe")


def border_one_sided(df: DataFrame, column: str = "spix") -> DataFrame:
    """df with is_border: the label is above that of one of the four neighbours, which gives lines of one pixel."""
    out = neighbours(df, column, diagonal=False)
    above = [F.coalesce(F.col(column) > F.col(d), F.lit(False)) for d in "nswe"]
    return out.withColumn("is_border", above[0] | above[1] | above[2] | above[3]).drop(*"nswe")


def simple_table() -> list[bool]:
    """For each code of eight same-label flags (nw, n, ne, w, e, sw, s, se from bit 0): may the centre change its label?

    It may if the same-label neighbours form exactly one 4-connected group that touches n, w, e or s, and so do the
    others.
    """
    ring = [(0, 0), (0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1), (2, 2)]
    cross = {(0, 1), (1, 0), (1, 2), (2, 1)}

    def groups(cells: set) -> int:
        rest, n = set(cells), 0
        while rest:
            todo, met = [rest.pop()], set()
            while todo:
                y, x = todo.pop()
                met.add((y, x))
                for step in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                    if step in rest:
                        rest.remove(step)
                        todo.append(step)
            n += bool(met & cross)
        return n

    return [groups({c for b, c in enumerate(ring) if code >> b & 1}) == 1 == groups({c for b, c in enumerate(ring) if not code >> b & 1}) for code in range(256)]


def same_code(column: str | Column = "spix") -> Column:
    """Code of the neighbours with the same label, those outside the frame counting as the same."""
    c = F.col(column) if isinstance(column, str) else column
    total = F.lit(0)
    for bit, d in enumerate(("nw", "n", "ne", "w", "e", "sw", "s", "se")):
        total = total + F.when(F.col(d).isNull() | (F.col(d) == c), 1 << bit).otherwise(0)
    return total


def simple_points(df: DataFrame, column: str = "spix") -> DataFrame:
    """df with code and is_simple, by a constant table of 256 flags."""
    flags = F.array(*(F.lit(b) for b in simple_table()))
    return neighbours(df, column).withColumn("code", same_code(column)).withColumn("is_simple", F.element_at(flags, F.col("code") + 1)).drop(*AROUND)


def dilate(df: DataFrame, flag: str, radius: int) -> DataFrame:
    """df with the flag set wherever it is set within a square of that radius: two separable windows."""
    row, col = (w.rowsBetween(-radius, radius) for w in lines(df))
    out = by_frame(df).withColumn(flag, F.max(flag).over(row))
    return out.withColumn(flag, F.max(flag).over(col))


def crop(df: DataFrame, y0: int, y1: int, x0: int, x1: int) -> DataFrame:
    return df.where(F.col("y").between(y0, y1 - 1) & F.col("x").between(x0, x1 - 1))


def overlay(df: DataFrame, colour: tuple[float, float, float] = (0.0, 0.0, 1.0), top: float = 1.0) -> DataFrame:
    """Colours clamped to [0, top], borders painted (df has is_border)."""
    return df.withColumns({f"c{i}": F.when(F.col("is_border"), F.lit(float(v))).otherwise(F.least(F.greatest(F.col(f"c{i}"), F.lit(0.0)), F.lit(float(top)))) for i, v in enumerate(colour)})


def gathered(places: DataFrame, seg: DataFrame, default: int = 0) -> DataFrame:
    """Each row of places (t, y, x, at) with the label of the pixel at (y, at), the default where there is none."""
    key = frame_key(seg)
    found = places.join(seg.select(*key, "y", F.col("x").alias("at"), "spix"), [*key, "y", "at"], "left")
    return found.select(*key, "y", "x", F.coalesce("spix", F.lit(default)).alias("spix"))


def unfold(df: DataFrame, column: str, radius: int = 1, outside: float = 0.0) -> DataFrame:
    """The frame, y, x and near: the column's values in the square of that radius around each pixel, row by row."""
    row, col = lines(df)
    empty = F.array(*(F.lit(float(outside)) for _ in range(2 * radius + 1)))

    def at(c: Column, k: int, window: Window, default: Column) -> Column:
        return F.coalesce((F.lag(c, -k) if k < 0 else F.lead(c, k)).over(window) if k else c, default)

    steps = range(-radius, radius + 1)
    out = by_frame(df).select(*frame_key(df), "y", "x", F.array(*(at(F.col(column).cast("double"), k, row, F.lit(float(outside))) for k in steps)).alias("line"))
    return out.select(*frame_key(df), "y", "x", F.flatten(F.array(*(at(F.col("line"), k, col, empty) for k in steps))).alias("near"))


def inside_blocks(spark: SparkSession, width: int, block: int = 8) -> DataFrame:
    """x: the columns that aren't the last of a block."""
    x = spark.range(width).select(F.col("id").cast("int").alias("x"))
    return x.exceptAll(x.where(F.col("x") % block == block - 1))
