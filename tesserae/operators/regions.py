"""Regions: initial cells, sufficient statistics, parameters, pooling, numbering, identity, split and merge scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.algebra import inverse2, smooth
from .stencil import frame_key, neighbours, same_code, simple_table, video_key


def region_key(df: DataFrame) -> list[str]:
    """What names a region: its frame and its id."""
    return [*frame_key(df), "spix"]


def square_cells(pixels: DataFrame, side: int, width: int) -> DataFrame:
    return pixels.withColumn("spix", F.expr(f"cast((y div {side}) * {-(-width // side)} + x div {side} AS int)"))


def hex_geometry(side: int, width: int, height: int) -> tuple[float, float, int, int]:
    """Pitch of rows and columns of a hexagonal lattice of cells of side * side pixels, and how many there are."""
    radius = math.sqrt(side**2 / (1.5 * math.sqrt(3)))
    wide = math.sqrt(3) * radius
    return 1.5 * radius, wide, int(width / wide) + 2, int(height / (1.5 * radius)) + 2


def hex_cells(pixels: DataFrame, side: int, width: int, height: int) -> DataFrame:
    """pixels with the nearest lattice centre, the later one of equally near ones.

    Only the centres of the rows and columns around a pixel can be nearest, so nine are looked at, as columns: no join.
    """
    tall, wide, nx, ny = hex_geometry(side, width, height)
    candidates = []
    for dr in (-1, 0, 1):
        row = F.rint(F.col("y") / tall) + dr
        shift = F.when(row % 2 == 0, 0.5 * wide).otherwise(0.0)
        for dc in (-1, 0, 1):
            column = F.rint((F.col("x") - shift) / wide) + dc
            d2 = F.round(F.pow(F.col("x") - column * wide - shift, F.lit(2)) + F.pow(F.col("y") - row * tall, F.lit(2)), 6)
            valid = (row >= 0) & (row < ny) & (column >= 0) & (column < nx)
            candidates.append(F.when(valid, F.struct(d2.alias("d2"), (-(row * nx + column)).alias("minus"))))
    return pixels.withColumn("spix", (-F.array_min(F.array_compact(F.array(*candidates)))["minus"]).cast("int"))


def sizes(seg: DataFrame) -> DataFrame:
    return seg.where(F.col("spix").isNotNull()).groupBy(*region_key(seg)).agg(F.count("*").alias("n"))


def count_invalid(seg: DataFrame) -> DataFrame:
    return seg.groupBy(*frame_key(seg)).agg(F.count_if(F.col("spix").isNull()).alias("n_invalid"), F.count("*").alias("n"))


def moments(seg: DataFrame, squares: bool = False, key: tuple[str, ...] | None = None) -> DataFrame:
    """n and the sums of colours, places and products of places of each region: one shuffle, combined before it."""
    x, y = F.col("x").cast("long"), F.col("y").cast("long")
    sums = {"n": F.count("*"), "sx": F.sum(x), "sy": F.sum(y), "sxx": F.sum(x * x), "sxy": F.sum(x * y), "syy": F.sum(y * y)}
    sums |= {f"s{i}": F.sum(f"c{i}") for i in range(3)}
    if squares:
        sums |= {f"q{i}": F.sum(F.col(f"c{i}") * F.col(f"c{i}")) for i in range(3)}
    return seg.where(F.col("spix").isNotNull()).groupBy(*(key or region_key(seg))).agg(*(c.alias(k) for k, c in sums.items()))


def parameters(stats: DataFrame, prior_count: Column, side: int, propagated: Column | None = None) -> DataFrame:
    """Means, and the inverse covariance of places drawn to a prior, of each row of moments.

    The prior is the identity, scaled to prior_count and unit determinant; a propagated region's is its sample
    covariance smoothed to a round cell of that side.
    """
    n, pc = F.col("n").cast("double"), prior_count.cast("double")
    shape = {"xx": F.lit(1.0), "xy": F.lit(0.0), "yy": F.lit(1.0)}
    if propagated is not None:
        own = {k: smooth(v / n, pc, pc, side, k != "xy") for k, v in scatter(stats).items()}
        shape = {k: F.when(propagated, own[k]).otherwise(shape[k]) for k in shape}
    return stats.select(*region_key(stats), "n", *_fitted(stats, pc, shape))


def scatter(stats: DataFrame) -> dict[str, Column]:
    """Centred sums of squares of places, of rows of moments."""
    n = F.col("n").cast("double")
    mx, my = F.col("sx") / n, F.col("sy") / n
    return {"xx": F.col("sxx") - n * mx * mx, "xy": F.col("sxy") - n * mx * my, "yy": F.col("syy") - n * my * my}


def _fitted(stats: DataFrame, pc: Column, shape: dict[str, Column]) -> list[Column]:
    """Means and inverse covariances drawn to a shape, scaled to unit determinant and the weight pc."""
    n, spread = F.col("n").cast("double"), scatter(stats)
    root = F.sqrt(F.greatest(shape["xx"] * shape["yy"] - shape["xy"] * shape["xy"], F.lit(1e-12)))
    cov = {k: (pc * (pc / root * shape[k]) + spread[k]) / (n + 50 * pc + 3) for k in spread}
    inv = inverse2(cov["xx"], cov["xy"], cov["yy"])
    means = [*((F.col(f"s{i}") / n).alias(f"mu{i}") for i in range(3)), (F.col("sx") / n).alias("mx"), (F.col("sy") / n).alias("my")]
    return [*means, *(inv[k].alias(f"i{k}" if k != "logdet" else k) for k in inv)]


def initial_priors(stats: DataFrame) -> DataFrame:
    """The priors of a first frame's regions: the whole part of their mean size as weight, the identity, not propagated."""
    frame = Window.partitionBy(*frame_key(stats))
    weight = F.floor(F.sum("n").over(frame) / F.count("*").over(frame)).cast("double")
    one, none = F.lit(1.0), F.lit(0.0)
    shapes = [c.alias(f"{m}{k}") for m in "kv" for k, c in (("xx", one), ("xy", none), ("yy", one))]
    return stats.select(*region_key(stats), weight.alias("prior_count"), *shapes, F.lit(False).alias("propagated"))


def kept_shapes(stats: DataFrame, params: DataFrame, prior_count: Column) -> DataFrame:
    """What a frame leaves to the next one, by region: n, prior_count, the inverse covariance that was fitted (ixx, ixy,
    iyy) and the covariance of places (vxx, vxy, vyy). stats and params: moments and parameters of the same frame."""
    key = region_key(stats)
    spread = [(v / F.col("n")).alias(f"v{k}") for k, v in scatter(stats).items()]
    return stats.select(*key, "n", prior_count.cast("double").alias("prior_count"), *spread).join(params.select(*key, "ixx", "ixy", "iyy"), key)


def carried_priors(kept: DataFrame, filled: DataFrame, prop_nc: bool = True) -> DataFrame:
    """The priors of each region of the frames t + 1 of kept: prior_count, the matrix kxx, kxy, kyy, the sample, propagated.

    filled: sizes n by region after filling. With prop_nc a region's prior weighs as much as the region did, or as what
    was filled where it had no pixels; without, as its prior did. The matrix is the inverse of the fitted one, but its
    off-diagonal keeps its sign. Regions that weren't there before have the identity and are not propagated.
    """
    key, det = region_key(filled), F.col("ixx") * F.col("iyy") - F.col("ixy") * F.col("ixy")
    weight = F.when(F.col("n") > 0, F.col("n").cast("double")) if prop_nc else F.col("prior_count")
    old = kept.select(*[c for c in key if c not in ("t", "spix")], (F.col("t") + 1).cast("int").alias("t"), "spix", weight.alias("weight"),
        (F.col("iyy") / det).alias("kxx"), (F.col("ixy") / det).alias("kxy"), (F.col("ixx") / det).alias("kyy"), "vxx", "vxy", "vyy")
    joined = filled.select(*key, F.col("n").cast("double").alias("now")).join(old, key, "left")
    rounds = [F.coalesce(f"{m}{k}", F.lit(one)).alias(f"{m}{k}") for m in "kv" for k, one in (("xx", 1.0), ("xy", 0.0), ("yy", 1.0))]
    return joined.select(*key, F.coalesce("weight", "now").alias("prior_count"), *rounds, F.col("kxx").isNotNull().alias("propagated"))


def conditioned_parameters(stats: DataFrame, priors: DataFrame, side: int, prop_icov: bool = True) -> DataFrame:
    """parameters with a prior for each region, as from carried_priors. With prop_icov a propagated region is drawn to its
    smoothed sample of the frame before, else to its matrix. One join by region; stats are aggregated before it."""
    key = region_key(stats)
    both = stats.join(priors, key)
    pc = F.col("prior_count")
    conditioned = F.col("propagated") if prop_icov else F.lit(False)
    shape = {k: F.when(conditioned, smooth(F.col(f"v{k}"), pc, pc, side, k != "xy")).otherwise(F.col(f"k{k}")) for k in ("xx", "xy", "yy")}
    return both.select(*key, "n", "prior_count", "propagated", *_fitted(both, pc, shape))


def pooled(seg: DataFrame, over_time: bool = False) -> DataFrame:
    """Mean colours of each region (of a frame, or of all frames)."""
    key = [*video_key(seg), "spix"] if over_time else region_key(seg)
    return seg.where(F.col("spix").isNotNull()).groupBy(*key).agg(F.count("*").alias("n"), *(F.avg(f"c{i}").alias(f"m{i}") for i in range(3)))


def pooled_video(seg: DataFrame, over_time: bool = False) -> DataFrame:
    """seg with the mean colours of the pixel's region as m0, m1, m2: a window over what one shuffle brings together."""
    w = Window.partitionBy(*([*video_key(seg), "spix"] if over_time else region_key(seg)))
    return seg.select("*", *(F.avg(f"c{i}").over(w).alias(f"m{i}") for i in range(3)))


def compacted(seg: DataFrame, previous: int) -> DataFrame:
    """Ids from previous on are renumbered without gaps, frame by frame; older ones stay.

    Ranks come from the distinct ids of a frame, not from its pixels.
    """
    key = region_key(seg)
    ids = seg.where(F.col("spix") >= previous).select(*key).distinct()
    ranked = ids.withColumn("new", F.dense_rank().over(Window.partitionBy(*key[:-1]).orderBy("spix")) - 1 + previous)
    return seg.join(ranked, key, "left").withColumn("spix", F.coalesce("new", "spix").cast("int")).drop("new")


def compacted_first_seen(seg: DataFrame) -> DataFrame:
    """Ids renumbered in the order in which the pixels of a frame show them first."""
    key = region_key(seg)
    first = seg.where(F.col("spix").isNotNull()).groupBy(*key).agg(F.min(F.struct("y", "x")).alias("f"))
    ranked = first.select(*key, (F.row_number().over(Window.partitionBy(*key[:-1]).orderBy("f")) - 1).alias("new"))
    return seg.join(ranked, key, "left").withColumn("spix", F.col("new").cast("int")).drop("new")


def living(seg: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of known (t, spix) that stand in seg."""
    return known.join(seg.select(*region_key(seg)).distinct(), region_key(seg), "left_semi")


def dead(seg: DataFrame, known: DataFrame) -> DataFrame:
    return known.join(seg.select(*region_key(seg)).distinct(), region_key(seg), "left_anti")


def identity_distances(now: DataFrame, before: DataFrame, width: int, height: int) -> DataFrame:
    """For each living region (t, spix, mu0-2, mx, my): the nearest of the dead ones before and of itself; and its own distance.

    Only regions of one frame pair meet (a join on t), and a region keeps only its best candidate.
    """
    frame, key = frame_key(now), region_key(now)
    old = before.select(*frame, *(F.col(c).alias(f"o_{c}") for c in ("spix", "mu0", "mu1", "mu2", "mx", "my", "is_dead")))
    near = [F.pow(F.col(f"mu{i}") - F.col(f"o_mu{i}"), F.lit(2)) for i in range(3)]
    place = F.pow((F.col("mx") - F.col("o_mx")) / width, F.lit(2)) + F.pow((F.col("my") - F.col("o_my")) / height, F.lit(2))
    delta = F.round(near[0] + near[1] + near[2] + place * 10, 9)
    pairs = now.join(old, frame).where(F.col("o_is_dead") | (F.col("o_spix") == F.col("spix"))).withColumn("delta", delta)
    return pairs.groupBy(*key).agg(F.min(F.struct("delta", F.col("o_spix").alias("id"))).alias("best"), F.max(F.when(F.col("o_spix") == F.col("spix"), F.col("delta"))).alias("own")).select(*key, F.col("best.id").alias("candidate"), F.col("best.delta").alias("delta"), "own")


def nearby_identities(now: DataFrame, before: DataFrame, width: int, height: int, epsilon: float) -> DataFrame:
    """identity_distances, but dead ids count only within epsilon, which is all that a decision asks for.

    Rows of a frame meet by cells of (first colour, x, y) as wide as the root of epsilon; a living region looks into the 27
    cells around its own, so the work is linear in living and dead ids, however many ids a video has seen.
    """
    frame, key, wide = frame_key(now), region_key(now), math.sqrt(epsilon)

    def cells(prefix: str = "") -> list[Column]:
        scaled = [F.col(f"{prefix}mu0"), math.sqrt(10) * F.col(f"{prefix}mx") / width, math.sqrt(10) * F.col(f"{prefix}my") / height]
        return [F.floor(c / wide) for c in scaled]

    def delta() -> Column:
        near = [F.pow(F.col(f"mu{i}") - F.col(f"o_mu{i}"), F.lit(2)) for i in range(3)]
        place = F.pow((F.col("mx") - F.col("o_mx")) / width, F.lit(2)) + F.pow((F.col("my") - F.col("o_my")) / height, F.lit(2))
        return F.round(near[0] + near[1] + near[2] + place * 10, 9)

    old = before.select(*frame, *(F.col(c).alias(f"o_{c}") for c in ("spix", "mu0", "mu1", "mu2", "mx", "my", "is_dead")))
    own = now.join(old.withColumn("spix", F.col("o_spix")), key, "left").select(*key, delta().alias("own"))
    steps = [F.array(*(c + step for step in (-1, 0, 1))) for c in cells()]
    looks = now
    for i, step in enumerate(steps):
        looks = looks.withColumn(f"cell{i}", F.explode(step))
    lies = old.where("o_is_dead").select("*", *(c.alias(f"cell{i}") for i, c in enumerate(cells("o_"))))
    met = looks.join(lies, [*frame, "cell0", "cell1", "cell2"]).withColumn("delta", delta()).where(F.col("delta") < epsilon)
    best = met.groupBy(*key).agg(F.min(F.struct("delta", F.col("o_spix").alias("id"))).alias("best"))
    return own.join(best, key, "left").select(*key, F.coalesce("best.id", "spix").alias("candidate"), F.coalesce("best.delta", "own").alias("delta"), "own")


def identity_decisions(distances: DataFrame, epsilon_reid: float, epsilon_new: float) -> DataFrame:
    """revive: take over the nearest dead id (of several regions the nearest one does); new: far from what it was."""
    wants = (F.col("delta") < epsilon_reid) & (F.col("candidate") != F.col("spix"))
    first = F.row_number().over(Window.partitionBy(*frame_key(distances), "candidate", wants).orderBy("delta", "spix")) == 1
    action = F.when(wants & first, "revive").when(~wants & (F.col("own") > epsilon_new), "new").otherwise("keep")
    return distances.withColumn("action", action)


def marginal(n: Column, sums: list[Column], squares: list[Column], sigma: float, a0: float = 1e4) -> Column:
    """Log marginal likelihood of a region's colours, in closed form (terms that cancel left out)."""
    b0 = 2 * sigma * a0
    a = F.lit(a0) + n / 2
    terms = [a * (math.log(b0) - F.log(F.lit(b0) + (q - s * s / n) / 2)) - F.log(n) / 2 - n * (math.log(math.pi) / 2 + math.log(2)) for s, q in zip(sums, squares, strict=True)]
    return terms[0] + terms[1] + terms[2]


def split_scores(parents: DataFrame, sigma: float, split_alpha: float = 0.0, gamma: float = 0.0, least: float = -2.0, least_size: int = 0) -> DataFrame:
    """h and accept of proposals with the moments of the kept part (k_), the new part (s_), and iperc of the kept one."""
    m = {p: marginal(F.col(f"{p}n"), [F.col(f"{p}s{i}") for i in range(3)], [F.col(f"{p}q{i}") for i in range(3)], sigma) for p in ("k_", "s_")}
    whole = marginal(F.col("k_n") + F.col("s_n"), [F.col(f"k_s{i}") + F.col(f"s_s{i}") for i in range(3)], [F.col(f"k_q{i}") + F.col(f"s_q{i}") for i in range(3)], sigma)
    h = m["k_"] + m["s_"] - whole + split_alpha - gamma * (1 - F.col("iperc"))
    return parents.withColumn("h", h).withColumn("accept", (F.col("h") > least) & (F.col("k_n") > 0) & (F.col("s_n") > 0) & (F.col("k_n") + F.col("s_n") >= least_size))


def merge_candidates(seg: DataFrame, direction: str = "s") -> DataFrame:
    """For each region the largest label next to it in one direction (s: below, w: left)."""
    near = neighbours(seg, diagonal=False).where((F.col(direction).isNotNull()) & (F.col(direction) != F.col("spix")))
    return near.groupBy(*region_key(seg)).agg(F.max(direction).alias("target"))


def merge_scores(candidates: DataFrame, stats: DataFrame, sigma: float, alpha: float, merge_alpha: float = 0.0) -> DataFrame:
    """h of merging each region into its target."""
    columns = ["n", *(f"{c}{i}" for c in "sq" for i in range(3))]
    frame, key = frame_key(candidates), region_key(candidates)
    both = candidates.join(stats.select(*key, *(F.col(c).alias(f"k_{c}") for c in columns)), key).join(stats.select(*frame, F.col("spix").alias("target"), *(F.col(c).alias(f"f_{c}") for c in columns)), [*frame, "target"])
    part = [marginal(F.col(f"{p}n"), [F.col(f"{p}s{i}") for i in range(3)], [F.col(f"{p}q{i}") for i in range(3)], sigma) for p in ("k_", "f_")]
    joint = marginal(F.col("k_n") + F.col("f_n"), [F.col(f"k_s{i}") + F.col(f"f_s{i}") for i in range(3)], [F.col(f"k_q{i}") + F.col(f"f_q{i}") for i in range(3)], sigma)
    return both.select(*frame, "spix", "target", (joint - alpha - part[0] - part[1] + merge_alpha).alias("h"))


def merge_accepted(scores: DataFrame, least: float = -2.0) -> DataFrame:
    """One region for each target (the highest h, then the smallest id); of two that want each other the smaller id goes."""
    frame = frame_key(scores)
    rank = Window.partitionBy(*frame, "target").orderBy(F.desc("h"), "spix")
    chosen = scores.where(F.col("h") > least).withColumn("k", F.row_number().over(rank)).where("k = 1").drop("k")
    back = chosen.select(*frame, F.col("spix").alias("target"), F.col("target").alias("wants"))
    return chosen.join(back, [*frame, "target"], "left").where(F.col("wants").isNull() | ((F.col("wants") == F.col("spix")) & (F.col("spix") < F.col("target")))).select(*frame, "spix", "target", "h")


def merge_proposals(scores: DataFrame, least: float = -2.0) -> DataFrame:
    """scores with accepted: whether the merge is carried out."""
    key = region_key(scores)
    taken = merge_accepted(scores, least).select(*key, F.lit(True).alias("taken"))
    return scores.join(taken, key, "left").withColumn("accepted", F.coalesce("taken", F.lit(False))).drop("taken")


def border_scores(seg: DataFrame, params: DataFrame, sigma2: float, potts: float, phase: tuple[int, int]) -> DataFrame:
    """One checkerboard phase of the boundary update: t, y, x and the new label of each pixel that may change.

    A border pixel may take the label of one of its four neighbours if its own removal keeps every label around it in
    one piece. The candidates are rows, joined once with the parameters of their regions; of equal scores the first of n, s,
    w, e wins.
    """
    flags = F.array(*(F.lit(b) for b in simple_table()))
    out = neighbours(seg)
    differs = [F.col(d).isNull() | (F.col(d) != F.col("spix")) for d in "nswe"]
    out = out.where((F.col("x") % 2 == phase[0]) & (F.col("y") % 2 == phase[1]) & (differs[0] | differs[1] | differs[2] | differs[3]))
    for d in "nswe":
        out = out.where(F.col(d).isNull() | F.element_at(flags, same_code(d) + 1))
    frame = frame_key(seg)
    around = [F.when(F.col(d).isNotNull(), F.struct(F.lit(-k).alias("order"), F.col(d).alias("label"))) for k, d in enumerate("nswe")]
    ring = F.array("n", "s", "w", "e", "nw", "ne", "sw", "se")
    out = out.select(*frame, "y", "x", "spix", "c0", "c1", "c2", ring.alias("ring"), F.explode(F.array_compact(F.array(*around))).alias("k")).select("*", "k.order", F.col("k.label").alias("label"))
    names = ["mu0", "mu1", "mu2", "mx", "my", "ixx", "ixy", "iyy", "logdet"]
    out = out.join(params.select(*frame, F.col("spix").alias("label"), *names), [*frame, "label"]).where("mx IS NOT NULL")
    d0, d1 = (F.col("x") - F.col("mx")).cast("int"), (F.col("y") - F.col("my")).cast("int")
    colour = sum(F.pow(F.col(f"c{i}") - F.col(f"mu{i}"), F.lit(2)) for i in range(3))
    unlike = F.expr("aggregate(ring, 0, (m, o) -> m + IF(o IS NOT NULL AND o <> label, 1, 0))")
    r = -1000 - colour / sigma2 - (d0 * d0 * F.col("ixx") + d1 * d1 * F.col("iyy") + 2 * d0 * d1 * F.col("ixy")) - F.col("logdet") - potts * unlike
    best = F.max(F.struct(F.round(r, 6).alias("score"), "order", "label")).alias("best")
    out = out.groupBy(*frame, "y", "x").agg(F.first("spix").alias("spix"), best)  # all candidates of a pixel have its label
    return out.select(*frame, "y", "x", "spix", "best.label", "best.score")


def new_ids(seg: DataFrame, previous: int) -> DataFrame:
    """The regions whose ids begin at previous."""
    return seg.where(F.col("spix") >= previous).select(*region_key(seg)).distinct()


def out_of_range(params: DataFrame, column: str, most: float) -> DataFrame:
    """The regions whose value lies further than most from 0."""
    return params.where(F.abs(column) > most).select(*region_key(params))
