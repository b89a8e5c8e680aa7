"""Queries over what frames hand on to each other: priors, identities, steps into the next frame, merge rounds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import regions
from ..plans import drivers, loops
from ..plans.frame import PHASES, Options
from ..sources.testdata import HEIGHT, PX, SEG, STRIPE, WIDTH, drift, segments, stripes
from . import pixels as pixel_queries
from . import plans, scores

QUERIES: dict = {}
ORACLES: dict = {}


def register(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def diagonals(spark, d) -> DataFrame:
    """The pixels with tilted regions whose shapes change from frame to frame."""
    return segments(spark, d).withColumn("spix", F.col("gt"))


_STATS = SEG + f""", st AS (SELECT t, gt AS spix, count(*) AS n, avg(x) AS mx, avg(y) AS my, sum(x * x) - count(*) * avg(x) * avg(x) AS bxx, sum(x * y) - count(*) * avg(x) * avg(y) AS bxy, sum(y * y) - count(*) * avg(y) * avg(y) AS byy FROM seg GROUP BY t, gt),
    w0 AS (SELECT *, floor(sum(n) OVER (PARTITION BY t) / count(*) OVER (PARTITION BY t)) AS pc FROM st)"""


def _fit_sql(name: str, source: str) -> str:
    """The fitted inverse covariances of rows with n, pc, bxx, bxy, byy and the prior's shape zxx, zxy, zyy."""
    root = "sqrt(greatest(zxx * zyy - zxy * zxy, 1e-12))"
    cov = ", ".join(f"(pc * (pc / {root} * z{k}) + b{k}) / (n + 50 * pc + 3) AS c{k}" for k in ("xx", "xy", "yy"))
    return f"""{name}c AS (SELECT *, {cov} FROM {source}),
    {name} AS (SELECT *, cyy / greatest(cxx * cyy - cxy * cxy, 1e-5) AS ixx, -cxy / greatest(cxx * cyy - cxy * cxy, 1e-5) AS ixy, cxx / greatest(cxx * cyy - cxy * cxy, 1e-5) AS iyy, ln(greatest(cxx * cyy - cxy * cxy, 1e-5)) AS logdet FROM {name}c)"""


_FIRST = _STATS + ", w1 AS (SELECT *, 1.0 AS zxx, 0.0 AS zxy, 1.0 AS zyy FROM w0), " + _fit_sql("p0", "w1")
_SHOWN = ", ".join(f"round({c}, 7) + 0.0 AS {c}" for c in ("ixx", "ixy", "iyy", "logdet"))
#: Regions of a frame with what the frame before left; regions that weren't there begin anew.
_CARRIED = _FIRST + """, sw AS (SELECT * FROM (VALUES (true), (false)) a(prop_nc), (VALUES (true), (false)) b(prop_icov)),
    c0 AS (SELECT s.t, s.spix, s.n, s.bxx, s.bxy, s.byy, prop_nc, prop_icov, p.t IS NOT NULL AS propagated, coalesce(CASE WHEN prop_nc THEN p.n ELSE p.pc END, s.n) AS pc,
        coalesce(p.iyy / (p.ixx * p.iyy - p.ixy * p.ixy), 1) AS kxx, coalesce(p.ixy / (p.ixx * p.iyy - p.ixy * p.ixy), 0) AS kxy, coalesce(p.ixx / (p.ixx * p.iyy - p.ixy * p.ixy), 1) AS kyy,
        coalesce(p.bxx / p.n, 1) AS vxx, coalesce(p.bxy / p.n, 0) AS vxy, coalesce(p.byy / p.n, 1) AS vyy FROM sw, st s LEFT JOIN p0 p ON p.t + 1 = s.t AND p.spix = s.spix),
    c1 AS (SELECT *, CASE WHEN propagated AND prop_icov THEN (pc / 4 * 5 + pc * vxx) / (pc + pc / 4 + 3) ELSE kxx END AS zxx, CASE WHEN propagated AND prop_icov THEN pc * vxy / (pc + pc / 4 + 3) ELSE kxy END AS zxy,
        CASE WHEN propagated AND prop_icov THEN (pc / 4 * 5 + pc * vyy) / (pc + pc / 4 + 3) ELSE kyy END AS zyy FROM c0), """ + _fit_sql("p1", "c1")


def _shown(df: DataFrame, digits: int = 7) -> list:
    return [(F.round(c, digits) + F.lit(0.0)).alias(c) for c in ("ixx", "ixy", "iyy", "logdet")]


@register(f"WITH {_FIRST} SELECT t, spix, CAST(pc AS DOUBLE) AS prior_count, round(mx, 7) AS mx, round(my, 7) AS my, {_SHOWN} FROM p0")
def initial_parameters(spark, d):
    """Parameters of first frames: the weight of the prior is the mean size of a region, its shape the identity."""
    stats = regions.moments(diagonals(spark, d))
    p = regions.conditioned_parameters(stats, regions.initial_priors(stats), 5)
    return p.select("t", "spix", "prior_count", F.round("mx", 7).alias("mx"), F.round("my", 7).alias("my"), *_shown(p))


def _handed_on(spark, d) -> tuple[DataFrame, DataFrame]:
    stats = regions.moments(diagonals(spark, d))
    first = regions.initial_priors(stats)
    params = regions.conditioned_parameters(stats, first, 5)
    weighed = stats.join(first.select("t", "spix", "prior_count"), ["t", "spix"])
    return stats, regions.kept_shapes(weighed, params, F.col("prior_count"))


@register(f"WITH {_CARRIED} SELECT t, spix, prop_nc, propagated, CAST(pc AS DOUBLE) AS prior_count, {', '.join(f'round({m}{k}, 7) + 0.0 AS {m}{k}' for m in 'kv' for k in ('xx', 'xy', 'yy'))} FROM c1 WHERE prop_icov")
def carried_priors(spark, d):
    """The priors that each frame takes over from the one before, with their weights from sizes or from priors."""
    stats, kept = _handed_on(spark, d)
    parts = [regions.carried_priors(kept, stats.select("t", "spix", "n"), nc).withColumn("prop_nc", F.lit(nc)) for nc in (True, False)]
    out = parts[0].unionByName(parts[1])
    return out.select("t", "spix", "prop_nc", "propagated", "prior_count", *((F.round(f"{m}{k}", 7) + F.lit(0.0)).alias(f"{m}{k}") for m in "kv" for k in ("xx", "xy", "yy")))


@register(f"WITH {_CARRIED} SELECT t, spix, prop_nc, prop_icov, CAST(pc AS DOUBLE) AS prior_count, {_SHOWN} FROM p1")
def conditioned_parameters(spark, d):
    """Parameters of each frame under the priors of the frame before, both switches on and off."""
    stats, kept = _handed_on(spark, d)
    parts = []
    for nc in (True, False):
        priors = regions.carried_priors(kept, stats.select("t", "spix", "n"), nc)
        for icov in (True, False):
            p = regions.conditioned_parameters(stats, priors, 5, icov)
            parts.append(p.select("t", "spix", F.lit(nc).alias("prop_nc"), F.lit(icov).alias("prop_icov"), "prior_count", *_shown(p)))
    return reduce(DataFrame.unionByName, parts)


_PARTS = SEG + """, means AS (SELECT t, spix, avg(c0) / 255 AS mu0, avg(c1) / 255 AS mu1, avg(c2) / 255 AS mu2, avg(x) AS mx, avg(y) AS my FROM seg GROUP BY t, spix),
    old AS (SELECT CAST(t + 1 AS INTEGER) AS t, spix, mu0, mu1, mu2, mx, my, spix % 3 = 0 AS is_dead FROM means), now AS (SELECT * FROM means WHERE spix % 3 <> 0),
    pairs AS (SELECT n.t, n.spix, o.spix AS id, o.is_dead, round(pow(n.mu0 - o.mu0, 2) + pow(n.mu1 - o.mu1, 2) + pow(n.mu2 - o.mu2, 2) + 10 * (pow((n.mx - o.mx) / 50, 2) + pow((n.my - o.my) / 30, 2)), 9) AS delta
        FROM now n JOIN old o ON o.t = n.t AND (o.is_dead OR o.spix = n.spix)),
    own AS (SELECT t, spix, delta AS own FROM pairs WHERE id = spix), best AS (SELECT t, spix, arg_min(id, row(delta, id)) AS id, min(delta) AS delta FROM pairs WHERE is_dead AND delta < 0.2 GROUP BY t, spix)"""


@register(f"WITH {_PARTS} SELECT now.t, now.spix, coalesce(best.id, now.spix) AS candidate, coalesce(best.delta, own) AS delta, own FROM now LEFT JOIN own ON own.t = now.t AND own.spix = now.spix LEFT JOIN best ON best.t = now.t AND best.spix = now.spix")
def nearby_identities(spark, d):
    """For the living two thirds of the regions the nearest dead one of the frame before, found by cells of colour and place."""
    seg = segments(spark, d)
    means = seg.groupBy("t", "spix").agg(*((F.avg(f"c{i}") / 255).alias(f"mu{i}") for i in range(3)), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    old = means.withColumns({"t": (F.col("t") + 1).cast("int"), "is_dead": F.col("spix") % 3 == 0})
    return regions.nearby_identities(means.where("spix % 3 <> 0"), old, WIDTH, HEIGHT, 0.2)


def _wandering(spark, d) -> tuple[DataFrame, DataFrame]:
    """Squares of two sizes, and their motion by a pixel or none in each direction."""
    return pixel_queries._uneven(spark, d), pixel_queries._uneven_flow(spark, d)


def _trace(spark, d) -> DataFrame:
    seg, flow = _wandering(spark, d)
    return drivers.traced_labels(drivers.trace_steps(plans.unit(seg), flow, plans.SMALL))


_SHIFTED = pixel_queries.ORACLES["shift_labels"]
_LATER = f"later AS (WITH {PX} SELECT DISTINCT t FROM px WHERE t > 0)"


@register(f"WITH {_LATER}, sh AS ({_SHIFTED}), grid AS (WITH {PX} SELECT t, y, x FROM px) SELECT grid.t, grid.y, grid.x, CAST(coalesce(sh.spix, -1) AS INTEGER) AS spix FROM grid JOIN later USING (t) LEFT JOIN sh USING (t, y, x)")
def trace_shifted(spark, d):
    """The first step into each next frame: the labels along their regions' motion."""
    return _trace(spark, d).where("step = 'shifted'").select("t", "y", "x", "spix")


def _filled_sql(passes: int = 4) -> str:
    uneven = pixel_queries._UNEVEN
    out = f"""WITH {_LATER}, sh AS ({_SHIFTED}), grid AS (WITH {PX} SELECT t, y, x FROM px), m AS (WITH {uneven} SELECT t + 1 AS t, spix, avg(x) + avg(fx) AS mx, avg(y) + avg(fy) AS my FROM flow GROUP BY t, spix),
        f0 AS MATERIALIZED (SELECT grid.t, grid.y, grid.x, sh.spix FROM grid JOIN later USING (t) LEFT JOIN sh USING (t, y, x))"""
    k = 0
    for _ in range(passes):
        for a, b in PHASES:
            out += f""", g{k} AS (SELECT h.t, h.y, h.x, arg_min(o.spix, row(round(pow((h.x - mx) / {WIDTH}, 2) + pow((h.y - my) / {HEIGHT}, 2), 9), o.spix)) AS filled
                FROM (SELECT * FROM f{k} WHERE spix IS NULL AND x % 2 = {a} AND y % 2 = {b}) h, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) s(dy, dx) JOIN f{k} o ON o.t = h.t AND o.y = h.y + s.dy AND o.x = h.x + s.dx JOIN m ON m.t = o.t AND m.spix = o.spix GROUP BY h.t, h.y, h.x),
                f{k + 1} AS MATERIALIZED (SELECT f{k}.t, f{k}.y, f{k}.x, coalesce(f{k}.spix, g{k}.filled) AS spix FROM f{k} LEFT JOIN g{k} USING (t, y, x))"""
            k += 1
    return out + f" SELECT t, y, x, CAST(spix AS INTEGER) AS spix FROM f{k}"


@register(_filled_sql())
def trace_filled(spark, d):
    """The second step: what the motion left open is filled from the labels around it."""
    filled = _trace(spark, d).where("step = 'filled'")
    return filled.withColumn("first", F.min("seq").over(Window.partitionBy("video", "t"))).where("seq = first").select("t", "y", "x", "spix")


def _loop_sql(rounds: int) -> str:
    """Rounds of downward merges, two rows away from the frame's edges, one region for each target."""
    out = f"WITH {SEG}, s0 AS MATERIALIZED (SELECT t, y, x, spix, c0 / 255 AS c0, c1 / 255 AS c1, c2 / 255 AS c2 FROM seg)"
    columns = "count(*) AS n, " + ", ".join(f"sum(c{i}) AS s{i}, sum(c{i} * c{i}) AS q{i}" for i in range(3))
    for k in range(rounds):
        names = ", ".join(f"p.{c} AS k_{c}, f.{c} AS f_{c}" for c in scores._COLS)
        out += f""", mo{k} AS MATERIALIZED (SELECT t, spix, {columns} FROM s{k} GROUP BY t, spix),
            ca{k} AS (SELECT a.t, a.spix, max(b.spix) AS target FROM s{k} a JOIN s{k} b ON b.t = a.t AND b.x = a.x AND b.y = a.y + 1 WHERE a.spix <> b.spix AND a.y > 1 AND a.y < {HEIGHT - 2} GROUP BY a.t, a.spix),
            sc{k} AS (SELECT ca{k}.t, ca{k}.spix, target, {names} FROM ca{k} JOIN mo{k} p ON p.t = ca{k}.t AND p.spix = ca{k}.spix JOIN mo{k} f ON f.t = ca{k}.t AND f.spix = target),
            h{k} AS (SELECT t, spix, target, {scores._m('k_', 'f_')} - {scores._m('k_')} - {scores._m('f_')} - ln(0.5) + 1.5 AS h FROM sc{k}),
            ch{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t, target ORDER BY h DESC, spix) AS r FROM h{k} WHERE h > -2) WHERE r = 1),
            ac{k} AS MATERIALIZED (SELECT x.t, x.spix, x.target, CAST({k} AS INTEGER) AS round FROM ch{k} x LEFT JOIN ch{k} y ON y.t = x.t AND y.spix = x.target WHERE y.target IS NULL OR (y.target = x.spix AND x.spix < x.target)),
            s{k + 1} AS MATERIALIZED (SELECT s.t, s.y, s.x, coalesce(a.target, s.spix) AS spix, c0, c1, c2 FROM s{k} s LEFT JOIN ac{k} a ON a.t = s.t AND a.spix = s.spix)"""
    return out


_LOOPED = Options(sp_size=5, merge_alpha=1.5)


@register(_loop_sql(2) + " SELECT * FROM ac0 UNION ALL SELECT * FROM ac1")
def merge_loop_accepted(spark, d):
    """The merges of two rounds, from joins and sums by region."""
    return drivers.merge_loop_table(plans.unit(segments(spark, d)), _LOOPED, 2)[1].select("t", "spix", "target", "round")


@register(_loop_sql(2) + " SELECT t, y, x, CAST(spix AS INTEGER) AS spix FROM s2")
def merge_loop(spark, d):
    """The labels after two rounds of merges by the kernel."""
    return drivers.merge_loop(plans.unit(segments(spark, d)), _LOOPED, 2).select("t", "y", "x", "spix")


@register(f"WITH {STRIPE} SELECT t, y, x, round(c0, 6) + 0.0 AS m0, round(c1, 6) + 0.0 AS m1, true AS few, CAST(CASE WHEN t = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_late FROM stripe WHERE t % 5 <> 3")
def stream_restarted(spark, d):
    """A stream that lacks every fifth frame, is stopped after half of its files and begun again from its checkpoint, when the
    first frame comes once more, too late: regions end where the stripes do, and the late frame is set aside."""
    from ..streaming import frames

    base, px = loops.fresh_folder(spark, "stream"), stripes(spark, d)
    packed = loops.cut(frames.packed(px, drift(spark, d)).where("t % 5 <> 3"))
    middle = packed.agg(F.max("t")).first()[0] // 2
    parts = [packed.where(F.col("t") <= middle), packed.where((F.col("t") > middle) | (F.col("t") == 0))]
    for part in parts:
        part.repartition(1).sortWithinPartitions(F.desc("t")).write.mode("append").parquet(f"{base}/in")
        source = spark.readStream.schema(packed.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        run = frames.labelled(source, plans.SHARP).writeStream.format("parquet").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start(f"{base}/out")
        run.awaitTermination()
    done = loops.cut(spark.read.schema(frames.OUTPUT).parquet(f"{base}/out"))
    late = done.groupBy("t").agg(F.count_if("late").alias("n_late"))
    return plans.region_colours(frames.unpacked(done), px).join(late, "t")


@register(f"SELECT s.t, s.spix, s.target, s.h, a.spix IS NOT NULL AS accepted FROM ({scores.ORACLES['merge_scores']}) s LEFT JOIN ({scores.ORACLES['merge_accept']}) a ON a.t = s.t AND a.spix = s.spix")
def merge_proposals(spark, d):
    """Every merge that a round proposes, and whether it is accepted."""
    asked = scores.rnd(scores._merge(spark, d), 4, "h")
    return regions.merge_proposals(asked)
