"""Propagation: regions move along the motion field, and what they leave uncovered is filled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .regions import region_key
from .stencil import frame_key, neighbours


def mean_flow(flow: DataFrame) -> DataFrame:
    """Mean motion of each region."""
    return flow.where(F.col("spix").isNotNull()).groupBy(*region_key(flow)).agg(F.avg("fx").alias("fx"), F.avg("fy").alias("fy"))


def shifted_centres(centres: DataFrame, flow_means: DataFrame) -> DataFrame:
    return centres.join(flow_means, region_key(centres)).select(*region_key(centres), (F.col("mx") + F.col("fx")).alias("mx"), (F.col("my") + F.col("fy")).alias("my"))


def shift_labels(seg: DataFrame, flow_means: DataFrame, width: int, height: int, smaller_wins: bool = True) -> DataFrame:
    """Labels of frame t moved by their region's rounded mean motion: rows (t, y, x, spix) of frame t + 1.

    Where regions land on one pixel, the smaller (or larger) one wins, then the smaller id. Pixels that no region
    reaches have no row. Sizes and motion are one row per region, joined to its pixels.
    """
    frame, key = frame_key(seg), region_key(seg)
    size = seg.groupBy(*key).agg(F.count("*").alias("n")).join(flow_means, key)
    moved = seg.select(*frame, "y", "x", "spix").join(size, key).select(*frame[:-1], (F.col("t") + 1).alias("t"), (F.col("y") + F.round("fy")).cast("int").alias("y"), (F.col("x") + F.round("fx")).cast("int").alias("x"), "spix", "n")
    inside = moved.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))
    order = F.struct(F.col("n") if smaller_wins else -F.col("n"), F.col("spix"))
    return inside.groupBy(*frame, "y", "x").agg(F.min(order)["spix"].alias("spix"))


def on_grid(grid: DataFrame, shifted: DataFrame) -> DataFrame:
    """Every pixel of grid (t, y, x) with its label, null where none is."""
    key = [*frame_key(grid), "y", "x"]
    return grid.select(*key).join(shifted, key, "left")


def missing_border(seg: DataFrame) -> DataFrame:
    """Pixels without a label next to one with a label."""
    near = neighbours(seg, diagonal=False)
    return near.where(F.col("spix").isNull() & F.coalesce("n", "s", "w", "e").isNotNull()).select(*frame_key(seg), "y", "x")


def fill_once(seg: DataFrame, centres: DataFrame, width: int, height: int) -> DataFrame:
    """One pass of filling: a missing pixel takes the label among its four neighbours whose centre is nearest.

    Distances count frame widths and heights; of equally near ones the smaller id wins.
    """
    frame, near = frame_key(seg), neighbours(seg, diagonal=False)
    edge = near.where(F.col("spix").isNull()).select(*frame, "y", "x", F.explode(F.array_distinct(F.array_compact(F.array("n", "s", "w", "e")))).alias("label"))
    d = edge.join(centres.select(*frame, F.col("spix").alias("label"), "mx", "my"), [*frame, "label"])
    d2 = F.round(F.pow((F.col("x") - F.col("mx")) / width, F.lit(2)) + F.pow((F.col("y") - F.col("my")) / height, F.lit(2)), 9)
    best = d.groupBy(*frame, "y", "x").agg(F.min(F.struct(d2.alias("d"), "label"))["label"].alias("filled"))
    return seg.join(best, [*frame, "y", "x"], "left").withColumn("spix", F.coalesce("spix", "filled")).drop("filled")


def invalid_share(shifted: DataFrame) -> DataFrame:
    """Share of pixels without a label in each frame, and the iterations that it asks for (4, 8 or 12)."""
    share = F.count_if(F.col("spix").isNull()) / F.count("*")
    out = shifted.groupBy(*frame_key(shifted)).agg(share.alias("share"))
    return out.withColumn("rounds", F.when(F.col("share") < 0.01, 4).when(F.col("share") > 0.2, 12).otherwise(8))


def region_invalid_share(shifted: DataFrame, filled: DataFrame) -> DataFrame:
    """(filled - shifted) / (filled + 1e-8) of each region."""
    key = region_key(filled)
    before = shifted.where("spix IS NOT NULL").groupBy(*key).agg(F.count("*").alias("before"))
    after = filled.groupBy(*key).agg(F.count("*").alias("after"))
    return after.join(before, key, "left").select(*key, ((F.col("after") - F.coalesce("before", F.lit(0))) / (F.col("after") + 1e-8)).alias("icount"))


def scaled(flow: DataFrame, factors: list[float]) -> DataFrame:
    """The motion times each factor, with a column factor."""
    key = [*frame_key(flow), "y", "x"]
    out = flow.select(*key, "fx", "fy", F.explode(F.array(*(F.lit(float(k)) for k in factors))).alias("factor"))
    return out.select(*key, "factor", (F.col("fx") * F.col("factor")).alias("fx"), (F.col("fy") * F.col("factor")).alias("fy"))
