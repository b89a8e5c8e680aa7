"""Operators over several videos at once: frames are named by video and t, and videos don't mix."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, motion, regions, stencil
from ..sources.testdata import HEIGHT, SEG, WIDTH, segments
from . import pixels as of_pixels
from . import scores as of_scores

QUERIES: dict = {}
ORACLES: dict = {}

#: The second video has regions of other sizes and other ground truth.
_OTHER = SEG.replace("CAST((y // 5) * 10 + x // 5 AS INTEGER)", "CAST((y // 10) * 5 + x // 10 AS INTEGER)").replace("(x + y + t) // 8", "(x + 2 * y) // 9")


def two_videos(spark, d):
    first = segments(spark, d).withColumn("video", F.lit("a"))
    return first.union(segments(spark, d, 10).withColumns({"gt": F.expr("cast((x + 2 * y) div 9 AS int)"), "video": F.lit("b")}))


def register(name: str, sql: str):
    """sql: that of one video, which is run on either."""
    sql = f"SELECT 'a' AS video, * FROM ({sql}) UNION ALL SELECT 'b' AS video, * FROM ({sql.replace(SEG, _OTHER)})"

    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


def _scored(name: str, column: str, digits: int, score):
    """A score of metrics under its name in the catalogue of scores."""
    register(f"videos_{name}", of_scores.ORACLES[name])(lambda spark, d: score(two_videos(spark, d)).withColumn(column, F.round(column, digits)))


_scored("ue2d", "ue2d", 9, lambda s: metrics.undersegmentation(s, WIDTH * HEIGHT))
_scored("ue3d", "ue3d", 9, lambda s: metrics.undersegmentation_3d(s, WIDTH * HEIGHT))
_scored("sa2d", "sa2d", 6, metrics.accuracy)
_scored("sa3d", "sa3d", 6, metrics.accuracy_3d)
_scored("explained_variance", "ev", 6, metrics.explained_variation)
_scored("explained_variance_3d", "ev", 6, lambda s: metrics.explained_variation(s, over_time=True, scale=255.0))
_scored("pooling_psnr", "psnr", 6, metrics.pooling_psnr)
_scored("ssim", "ssim", 6, lambda s: metrics.ssim(regions.pooled_video(s), "c0", "m0"))


@register("videos_asa", of_scores.ORACLES["asa"])
def videos_asa(spark, d):
    return metrics.asa(two_videos(spark, d))


@register("videos_boundary_recall", of_scores.ORACLES["boundary_recall"])
def videos_boundary_recall(spark, d):
    return metrics.boundary_scores(two_videos(spark, d)).drop("precision")


@register("videos_evaluation", of_scores.ORACLES["evaluation"])
def videos_evaluation(spark, d):
    out = metrics.evaluate(two_videos(spark, d), WIDTH * HEIGHT)
    digits = {"szv": 6, "ev": 6, "ev3d": 6, "ue2d": 9, "ue3d": 9, "sa2d": 6, "sa3d": 6, "ave_nsp": 6, "std_nsp": 6, "pooling": 4}
    return out.withColumns({k: F.round(k, n) for k, n in digits.items()})


@register("videos_moments", of_scores.ORACLES["moments_color"])
def videos_moments(spark, d):
    return regions.moments(two_videos(spark, d), squares=True)


@register("videos_params", of_scores.ORACLES["params_update"])
def videos_params(spark, d):
    p = regions.parameters(regions.moments(two_videos(spark, d)), F.lit(25.0), 5)
    return p.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in ("ixx", "ixy", "iyy", "logdet")})


@register("videos_neighbors", of_pixels.ORACLES["neighbors8"])
def videos_neighbors(spark, d):
    return stencil.neighbours(two_videos(spark, d)).select("video", "t", "y", "x", "spix", "n", "s", "w", "e", "nw", "ne", "sw", "se")


@register("videos_merge_candidates", of_scores.ORACLES["merge_candidates"])
def videos_merge_candidates(spark, d):
    return regions.merge_candidates(two_videos(spark, d))


@register("videos_fill", of_pixels.ORACLES["fill_one_pass"])
def videos_fill(spark, d):
    seg = two_videos(spark, d).withColumn("spix", F.expr("IF(x BETWEEN 10 AND 20 AND y BETWEEN 7 AND 15, NULL, spix)"))
    centres = seg.where("spix IS NOT NULL").groupBy("video", "t", "spix").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    return motion.fill_once(seg, centres, WIDTH, HEIGHT).select("video", "t", "y", "x", "spix")


@register("videos_shift", of_pixels._shift_sql("n"))
def videos_shift(spark, d):
    """Both videos' motion is that of their own regions."""
    seg = two_videos(spark, d)
    fl = seg.withColumns({"fx": F.expr("cast(spix % 3 - 1 AS double)"), "fy": F.expr("cast(spix div 3 % 3 - 1 AS double)")})
    return motion.shift_labels(seg, motion.mean_flow(fl), WIDTH, HEIGHT)
