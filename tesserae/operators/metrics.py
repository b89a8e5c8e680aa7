"""Segmentation quality: each metric is a few aggregations over ([video,] t, y, x, spix, gt, c0-2).

Where there is a column video, scores of frames are by (video, t) and scores of videos by video.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .regions import pooled_video
from .stencil import by_frame, dilate, frame_key, lines, video_key


def beside(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """a with the columns of b, which has one row a video, or one row."""
    return a.join(F.broadcast(b), key) if key else a.crossJoin(F.broadcast(b))


def overlaps(seg: DataFrame) -> DataFrame:
    return seg.groupBy(*frame_key(seg), "spix", "gt").agg(F.count("*").alias("m"))


def asa(seg: DataFrame) -> DataFrame:
    """Share of pixels in the largest overlap of their region with a ground-truth label."""
    best = overlaps(seg).groupBy(*frame_key(seg), "spix").agg(F.max("m").alias("best"), F.sum("m").alias("n"))
    return best.groupBy(*frame_key(seg)).agg((F.sum("best") / F.sum("n")).alias("asa"))


def edge_map(seg: DataFrame, column: str) -> DataFrame:
    """t, y, x and edge on the grid that lacks the last row and column: a 2 x 2 block isn't of one label."""
    frame, (row, col) = frame_key(seg), lines(seg)
    c = F.col(column)
    out = by_frame(seg).select(*frame, "y", "x", c.alias("a"), F.lead(c).over(row).alias("b"))
    out = out.select("*", F.lead("a").over(col).alias("c"), F.lead("b").over(col).alias("d"))
    return out.where("d IS NOT NULL").select(*frame, "y", "x", F.expr("cast(a <> d OR b <> d OR c <> d AS int)").alias("edge"))


def boundary_scores(seg: DataFrame, radius: int = 1) -> DataFrame:
    """Boundary recall and precision of region edges, widened by radius, against ground-truth edges."""
    own = dilate(edge_map(seg, "spix"), "edge", radius).withColumnRenamed("edge", "sp")
    both = own.join(edge_map(seg, "gt").withColumnRenamed("edge", "truth"), [*frame_key(seg), "y", "x"])
    hit = F.sum(F.col("sp") * F.col("truth"))
    return both.groupBy(*frame_key(seg)).agg((hit / F.sum("truth")).alias("recall"), (hit / F.sum("sp")).alias("precision"))


def psnr(df: DataFrame, peak: float, a: str = "c", b: str = "m") -> DataFrame:
    """10 log10(peak^2 / mean squared error) of each frame, over three channels."""
    error = sum(F.pow(F.col(f"{a}{i}") - F.col(f"{b}{i}"), F.lit(2)) for i in range(3)) / 3
    return df.groupBy(*frame_key(df)).agg((10 * F.log10(F.lit(peak * peak) / F.avg(error))).alias("psnr"))


def pooling_psnr(seg: DataFrame, peak: float = 255.0) -> DataFrame:
    return psnr(pooled_video(seg), peak)


def ssim(df: DataFrame, a: str, b: str, peak: float = 255.0, radius: int = 3) -> DataFrame:
    """Mean structural similarity of each frame: uniform windows, sample covariance, borders of the radius left out."""
    frame, (row, col) = frame_key(df), (w.rowsBetween(-radius, radius) for w in lines(df))
    sums = {"a": F.col(a), "b": F.col(b), "aa": F.col(a) * F.col(a), "bb": F.col(b) * F.col(b), "ab": F.col(a) * F.col(b)}
    out = by_frame(df).select(*frame, "y", "x", F.count("*").over(row).alias("k"), *(F.sum(c).over(row).alias(n) for n, c in sums.items()))
    out = out.select(*frame, F.sum("k").over(col).alias("k"), *(F.sum(n).over(col).alias(n) for n in sums))
    full = (2 * radius + 1) ** 2
    out = out.where(F.col("k") == full)
    mean_a, mean_b, scale = F.col("a") / full, F.col("b") / full, full / (full - 1)
    va, vb, vab = (scale * (F.col(n) / full - p * q) for n, p, q in (("aa", mean_a, mean_a), ("bb", mean_b, mean_b), ("ab", mean_a, mean_b)))
    c1, c2 = (0.01 * peak) ** 2, (0.03 * peak) ** 2
    value = (2 * mean_a * mean_b + c1) * (2 * vab + c2) / ((mean_a * mean_a + mean_b * mean_b + c1) * (va + vb + c2))
    return out.groupBy(*frame).agg(F.avg(value).alias("ssim"))


def blocking_effect(df: DataFrame, column: str = "c0", block: int = 8) -> DataFrame:
    """Mean squared step at block edges, less that elsewhere where it is larger, by frame."""
    frame, (row, col) = frame_key(df), lines(df)
    out = by_frame(df).select(*frame, "y", "x", F.pow(F.lead(column).over(row) - F.col(column), F.lit(2)).alias("h"), F.pow(F.lead(column).over(col) - F.col(column), F.lit(2)).alias("v"))
    steps = out.select(*frame, F.expr(f"stack(2, h, x % {block} = {block - 1}, v, y % {block} = {block - 1}) AS (d, at_edge)")).where("d IS NOT NULL")
    both = steps.groupBy(*frame).agg(F.avg(F.when(F.col("at_edge"), F.col("d"))).alias("edge"), F.avg(F.when(~F.col("at_edge"), F.col("d"))).alias("inner"))
    return both.select(*frame, F.greatest(F.col("edge") - F.col("inner"), F.lit(0.0)).alias("bef"))


def rates(df: DataFrame, score: str, truth: str) -> DataFrame:
    """True positive and negative rates and the positive share, of logistic scores above one half."""
    hit = 1 / (1 + F.exp(-F.col(score))) > 0.5
    count = lambda c: F.count_if(c)
    t = F.col(truth) > 0
    return df.groupBy(*frame_key(df)).agg((count(hit & t) / count(t)).alias("tpr"), (count(~hit & ~t) / count(~t)).alias("tnr"), (count(t) / F.count("*")).alias("positive"))


def temporal_extent(seg: DataFrame) -> DataFrame:
    """Share of (frame, id) cells that have pixels, ids counting from 0."""
    cells = seg.select(*frame_key(seg), "spix").distinct()
    return cells.groupBy(*video_key(seg)).agg((F.count("*") / (F.countDistinct("t") * (F.max("spix") + 1))).alias("tex"))


def size_variation(seg: DataFrame) -> DataFrame:
    """Mean over regions of the sample deviation of their sizes, of those in two frames or more."""
    n = seg.groupBy(*frame_key(seg), "spix").agg(F.count("*").alias("n"))
    per = n.groupBy(*video_key(seg), "spix").agg(F.stddev_samp("n").alias("sd"), F.count("*").alias("k")).where("k > 1")
    return per.groupBy(*video_key(seg)).agg(F.avg("sd").alias("szv"))


def explained_variation(seg: DataFrame, over_time: bool = False, scale: float = 1.0) -> DataFrame:
    """Mean over frames and channels of the pooled colours' variation over that of the colours."""
    frame = frame_key(seg)
    w = Window.partitionBy(*frame)
    out = pooled_video(seg, over_time)
    parts = []
    for i in range(3):
        mu = F.avg(f"c{i}").over(w)
        parts += [(F.pow((F.col(f"m{i}") - mu) * scale, F.lit(2))).alias(f"p{i}"), (F.pow((F.col(f"c{i}") - mu) * scale, F.lit(2))).alias(f"q{i}")]
    out = out.select(*frame, *parts).groupBy(*frame).agg((sum(F.sum(f"p{i}") for i in range(3)) / (sum(F.sum(f"q{i}") for i in range(3)) + 1e-10)).alias("ev"))
    return out.groupBy(*video_key(seg)).agg(F.avg("ev").alias("ev"))


def _truth_cells(seg: DataFrame) -> DataFrame:
    """m and n (the region's size in the frame) of every overlap."""
    return overlaps(seg).withColumn("n", F.sum("m").over(Window.partitionBy(*frame_key(seg), "spix")))


def undersegmentation(seg: DataFrame, area: int) -> DataFrame:
    """Mean over all (frame, label) cells, empty ones too, of the smaller parts of the regions that touch the label."""
    video = video_key(seg)
    cells = _truth_cells(seg).groupBy(*video).agg(F.sum(F.least(F.col("n") - F.col("m"), F.col("m"))).alias("u"))
    count = seg.groupBy(*video).agg((F.countDistinct("t") * F.countDistinct("gt")).alias("k"))
    return beside(cells, count, video).select(*video, (F.col("u") / F.lit(area) / F.col("k")).alias("ue2d"))


def undersegmentation_3d(seg: DataFrame, area: int) -> DataFrame:
    """The same over time: outside pixels count in frames where region and label meet."""
    video = video_key(seg)
    pairs = _truth_cells(seg).groupBy(*video, "spix", "gt").agg(F.sum(F.col("n") - F.col("m")).alias("out"), F.sum("m").alias("m"))
    per = pairs.groupBy(*video, "gt").agg(F.sum(F.least("out", "m")).alias("u"))
    frames = seg.groupBy(*video).agg(F.countDistinct("t").alias("frames"))
    return beside(per.groupBy(*video).agg(F.avg("u").alias("u")), frames, video).select(*video, (F.col("u") / (F.col("frames") * area)).alias("ue3d"))


def accuracy(seg: DataFrame) -> DataFrame:
    """Share of each label but the first that regions at least half inside it hold, meant over its frames, then over labels."""
    video, cells = video_key(seg), _truth_cells(seg)
    per = cells.groupBy(*frame_key(seg), "gt").agg((F.sum(F.when(F.col("m") >= 0.5 * F.col("n"), F.col("m")).otherwise(0)) / F.sum("m")).alias("r"))
    labels = per.groupBy(*video, "gt").agg(F.avg("r").alias("r"))
    first = seg.groupBy(*video).agg(F.min("gt").alias("first"))
    return beside(labels, first, video).where("gt > first").groupBy(*video).agg(F.avg("r").alias("sa2d"))


def accuracy_3d(seg: DataFrame) -> DataFrame:
    """The same with counts summed over time."""
    video = video_key(seg)
    m = seg.groupBy(*video, "spix", "gt").agg(F.count("*").alias("m")).withColumn("n", F.sum("m").over(Window.partitionBy(*video, "spix")))
    labels = m.groupBy(*video, "gt").agg((F.sum(F.when(F.col("m") >= 0.5 * F.col("n"), F.col("m")).otherwise(0)) / F.sum("m")).alias("r"))
    first = seg.groupBy(*video).agg(F.min("gt").alias("first"))
    return beside(labels, first, video).where("gt > first").groupBy(*video).agg(F.avg("r").alias("sa3d"))


def count_stats(seg: DataFrame, reference: int | None = None) -> DataFrame:
    """Largest id + 1; mean and deviation over frames of living ids, and of their squared difference to a reference."""
    per = seg.groupBy(*frame_key(seg)).agg(F.countDistinct("spix").cast("double").alias("k"), F.max("spix").alias("top"))
    out = [(F.max("top") + 1).cast("long").alias("spnum"), F.avg("k").alias("ave_nsp"), F.stddev_samp("k").alias("std_nsp")]
    if reference is not None:
        d = F.pow(F.col("k") - reference, F.lit(2))
        out += [F.avg(d).alias("ave_delta_nsp"), F.stddev_samp(d).alias("std_delta_nsp")]
    return per.groupBy(*video_key(seg)).agg(*out)


def evaluate(seg: DataFrame, area: int, reference: int | None = None) -> DataFrame:
    """One row (one a video) with all scores of a segmentation: tex, szv, ev, ev3d, pooling, ue2d, sa2d, ue3d, sa3d, counts.

    Labels are taken from 0 on (their least is subtracted). Differences to a reference count are -1 where there is none,
    and so are the scores of the external video-quality tool.
    """
    video = video_key(seg)
    least = seg.groupBy(*video).agg(F.min("spix").alias("least"))
    seg = beside(seg, least, video).withColumn("spix", F.col("spix") - F.col("least")).drop("least")
    pooling = pooling_psnr(seg).groupBy(*video).agg(F.avg("psnr").alias("pooling"))
    parts = [temporal_extent(seg), size_variation(seg), explained_variation(seg), explained_variation(seg, over_time=True, scale=255.0).withColumnRenamed("ev", "ev3d"), pooling, undersegmentation(seg, area), accuracy(seg), undersegmentation_3d(seg, area), accuracy_3d(seg), count_stats(seg, reference)]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, video, "left") if video else out.crossJoin(F.broadcast(p))  # without videos each is one row
    for name in ("ave_delta_nsp", "std_delta_nsp", "strred0", "strred1"):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(-1.0))
    return out


def residual(seg: DataFrame) -> DataFrame:
    """The frame, y, x and residual: each pixel's squared error to its region's mean colour, over the frame's largest one."""
    frame = frame_key(seg)
    error = sum(F.pow(F.col(f"c{i}") - F.col(f"m{i}"), F.lit(2)) for i in range(3)) / 3
    out = pooled_video(seg).select(*frame, "y", "x", error.alias("e"))
    return out.select(*frame, "y", "x", (F.col("e") / F.max("e").over(Window.partitionBy(*frame))).alias("residual"))


def largest_cells(seg: DataFrame, k: int) -> DataFrame:
    """The k ground-truth labels of frames with the most pixels (t, gt and n), of equals the first."""
    key = [*frame_key(seg), "gt"]
    return seg.groupBy(*key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *key).limit(k)
