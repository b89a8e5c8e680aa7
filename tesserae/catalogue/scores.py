"""Queries over regions and segmentation quality."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.algebra import eigenvalues2
from ..operators import metrics, regions, stencil
from ..plans import experiments
from ..sources.testdata import HEIGHT, PX, SEG, WIDTH, segments, table

QUERIES: dict = {}
ORACLES: dict = {}
AREA = WIDTH * HEIGHT


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rnd(df, digits, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


@register(f"WITH {SEG} SELECT t, spix, count(*) AS n FROM seg GROUP BY t, spix")
def region_sizes(spark, d):
    return regions.sizes(segments(spark, d))


_MOM = "count(*) AS n, CAST(sum(x) AS BIGINT) AS sx, CAST(sum(y) AS BIGINT) AS sy, CAST(sum(x * x) AS BIGINT) AS sxx, CAST(sum(x * y) AS BIGINT) AS sxy, CAST(sum(y * y) AS BIGINT) AS syy, sum(c0) AS s0, sum(c1) AS s1, sum(c2) AS s2"
_SQ = ", sum(c0 * c0) AS q0, sum(c1 * c1) AS q1, sum(c2 * c2) AS q2"
MOM = SEG + f", mom AS (SELECT t, spix, {_MOM}{_SQ} FROM seg GROUP BY t, spix)"


@register(f"WITH {SEG} SELECT t, spix, {_MOM} FROM seg GROUP BY t, spix")
def moments2d(spark, d):
    return regions.moments(segments(spark, d))


@register(f"WITH {MOM} SELECT * FROM mom")
def moments_color(spark, d):
    return regions.moments(segments(spark, d), squares=True)


def _params_sql(pc: float) -> str:
    return MOM + f""", cv AS (SELECT t, spix, n, s0 / n AS mu0, s1 / n AS mu1, s2 / n AS mu2, sx / n AS mx, sy / n AS my,
        ({pc} * {pc} + sxx - n * (sx / n) * (sx / n)) / (n + 50 * {pc} + 3) AS xx, (sxy - n * (sx / n) * (sy / n)) / (n + 50 * {pc} + 3) AS xy, ({pc} * {pc} + syy - n * (sy / n) * (sy / n)) / (n + 50 * {pc} + 3) AS yy FROM mom),
    par AS (SELECT *, yy / greatest(xx * yy - xy * xy, 1e-5) AS ixx, -xy / greatest(xx * yy - xy * xy, 1e-5) AS ixy, xx / greatest(xx * yy - xy * xy, 1e-5) AS iyy, ln(greatest(xx * yy - xy * xy, 1e-5)) AS logdet FROM cv)"""


def _params(spark, d):
    return regions.parameters(regions.moments(segments(spark, d)), F.lit(25.0), 5)


@register(f"WITH {_params_sql(25.0)} SELECT t, spix, n, mu0, mu1, mu2, mx, my, round(ixx, 6) AS ixx, round(ixy, 6) + 0.0 AS ixy, round(iyy, 6) AS iyy, round(logdet, 6) AS logdet FROM par")
def params_update(spark, d):
    out = rnd(_params(spark, d), 6, "ixx", "ixy", "iyy", "logdet")
    return out.withColumn("ixy", F.col("ixy") + F.lit(0.0))


def _propagated_sql() -> str:
    """A prior whose shape is the sample covariance, drawn to a round region of side 5, at unit determinant."""
    own = {k: f"(({q} + 25.0 * (s{k} - n * ({a} / n) * ({b} / n)) / n) / (25.0 + 6.25 + 3))" for k, q, a, b in (("xx", 6.25 * 5, "sx", "sx"), ("xy", 0.0, "sx", "sy"), ("yy", 6.25 * 5, "sy", "sy"))}
    ctes = _params_sql(25.0)
    for k in ("xx", "yy"):
        ctes = ctes.replace(f"(25.0 * 25.0 + s{k}", f"(25.0 * 25.0 * k{k} / root + s{k}")
    ctes = ctes.replace("(sxy - n *", "(25.0 * 25.0 * kxy / root + sxy - n *").replace("FROM mom),", f"FROM (SELECT *, sqrt(greatest(kxx * kyy - kxy * kxy, 1e-12)) AS root FROM (SELECT *, {own['xx']} AS kxx, {own['xy']} AS kxy, {own['yy']} AS kyy FROM mom))),")
    return f"WITH {ctes} SELECT t, spix, n, round(ixx, 6) AS ixx, round(ixy, 6) + 0.0 AS ixy, round(iyy, 6) AS iyy, round(logdet, 6) AS logdet FROM par"


@register(_propagated_sql())
def params_propagated(spark, d):
    p = regions.parameters(regions.moments(segments(spark, d)), F.lit(25.0), 5, F.lit(True))
    return p.select("t", "spix", "n", *((F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("ixx", "ixy", "iyy", "logdet")))


@register(f"WITH {_params_sql(25.0)} SELECT t, spix, round((xx + yy) / 2 + sqrt((xx - yy) * (xx - yy) / 4 + xy * xy), 6) AS large, round((xx + yy) / 2 - sqrt((xx - yy) * (xx - yy) / 4 + xy * xy), 6) AS small FROM cv")
def covariance_axes(spark, d):
    p = _params(spark, d)
    det = F.col("ixx") * F.col("iyy") - F.col("ixy") * F.col("ixy")
    large, small = eigenvalues2(F.col("iyy") / det, -F.col("ixy") / det, F.col("ixx") / det)
    return p.select("t", "spix", F.round(large, 6).alias("large"), F.round(small, 6).alias("small"))


@register(f"WITH {SEG} SELECT t, y, x, round(avg(c0) OVER w, 6) AS m0, round(avg(c1) OVER w, 6) AS m1, round(avg(c2) OVER w, 6) AS m2 FROM seg WINDOW w AS (PARTITION BY t, spix)")
def pooled_video(spark, d):
    return rnd(regions.pooled_video(segments(spark, d)), 6, "m0", "m1", "m2").select("t", "y", "x", "m0", "m1", "m2")


@register(f"WITH {SEG} SELECT spix, count(*) AS n, round(avg(c0), 6) AS m0, round(avg(c1), 6) AS m1, round(avg(c2), 6) AS m2 FROM seg GROUP BY spix")
def pooled_over_time(spark, d):
    return rnd(regions.pooled(segments(spark, d), over_time=True), 6, "m0", "m1", "m2")


_POOL = SEG + ", pool AS (SELECT *, " + ", ".join(f"avg(c{i}) OVER w AS m{i}" for i in range(3)) + " FROM seg WINDOW w AS (PARTITION BY t, spix))"
_ERR = "(pow(c0 - m0, 2) + pow(c1 - m1, 2) + pow(c2 - m2, 2)) / 3"


@register(f"WITH {_POOL} SELECT t, round(10 * log10(65025.0 / avg({_ERR})), 6) AS psnr FROM pool GROUP BY t")
def pooling_psnr(spark, d):
    return rnd(metrics.pooling_psnr(segments(spark, d)), 6, "psnr")


@register(f"WITH {PX} SELECT t, round(10 * log10(65025.0 / avg((pow(c0 - c1, 2) + pow(c1 - c2, 2) + pow(c2 - c0, 2)) / 3)), 6) AS psnr FROM px GROUP BY t")
def psnr_per_frame(spark, d):
    both = segments(spark, d).select("t", "c0", "c1", "c2", F.col("c1").alias("m0"), F.col("c2").alias("m1"), F.col("c0").alias("m2"))
    return rnd(metrics.psnr(both, 255.0), 6, "psnr")


@register(f"WITH {_POOL} SELECT t, y, x, round({_ERR} / max({_ERR}) OVER (PARTITION BY t), 6) AS residual FROM pool")
def residual_image(spark, d):
    return rnd(metrics.residual(segments(spark, d)), 6, "residual")


_NEW = SEG.replace("CAST((y // 5) * 10 + x // 5 AS INTEGER)", "CAST(((y // 5) * 10 + x // 5) * 3 % 101 AS INTEGER)")


def _scattered(spark, d):
    return segments(spark, d).withColumn("spix", F.expr("cast(spix * 3 % 101 AS int)"))


@register(f"WITH {_NEW}, r AS (SELECT t, spix, 20 + dense_rank() OVER (PARTITION BY t ORDER BY spix) - 1 AS new FROM (SELECT DISTINCT t, spix FROM seg WHERE spix >= 20)) SELECT seg.t, y, x, CAST(coalesce(new, seg.spix) AS INTEGER) AS spix FROM seg LEFT JOIN r ON r.t = seg.t AND r.spix = seg.spix")
def compact_ids(spark, d):
    return regions.compacted(_scattered(spark, d), 20).select("t", "y", "x", "spix")


@register(f"WITH {_NEW}, f AS (SELECT t, spix, row_number() OVER (PARTITION BY t ORDER BY p) - 1 AS new FROM (SELECT t, spix, min(y * {WIDTH} + x) AS p FROM seg GROUP BY t, spix)) SELECT seg.t, y, x, CAST(new AS INTEGER) AS spix FROM seg JOIN f ON f.t = seg.t AND f.spix = seg.spix")
def compact_first_seen(spark, d):
    return regions.compacted_first_seen(_scattered(spark, d)).select("t", "y", "x", "spix")


def _known(spark, d):
    return segments(spark, d).select("t", (F.col("spix") * 2).cast("int").alias("spix")).distinct()


@register(f"WITH {SEG} SELECT DISTINCT t, 2 * spix AS spix FROM seg s WHERE EXISTS (FROM seg q WHERE q.t = s.t AND q.spix = 2 * s.spix)")
def living(spark, d):
    return regions.living(segments(spark, d), _known(spark, d))


@register(f"WITH {SEG} SELECT DISTINCT t, 2 * spix AS spix FROM seg s WHERE NOT EXISTS (FROM seg q WHERE q.t = s.t AND q.spix = 2 * s.spix)")
def dead(spark, d):
    return regions.dead(segments(spark, d), _known(spark, d))


_IDENT = MOM + f""", m AS (SELECT t, spix, s0 / n / 255 AS mu0, s1 / n / 255 AS mu1, s2 / n / 255 AS mu2, sx / n AS mx, sy / n AS my FROM mom),
    old AS (SELECT t, spix, mu0, mu1, mu2, mx + 1 AS mx, my AS my, spix % 5 = 0 AS is_dead FROM m), cur AS (SELECT * FROM m WHERE spix % 5 <> 0),
    pair AS (SELECT c.t, c.spix, o.spix AS id, round(pow(c.mu0 - o.mu0, 2) + pow(c.mu1 - o.mu1, 2) + pow(c.mu2 - o.mu2, 2) + 10 * (pow((c.mx - o.mx) / {WIDTH}, 2) + pow((c.my - o.my) / {HEIGHT}, 2)), 9) AS delta FROM cur c JOIN old o ON o.t = c.t AND (o.is_dead OR o.spix = c.spix)),
    best AS (SELECT t, spix, arg_min(id, row(delta, id)) AS candidate, min(delta) AS delta, max(CASE WHEN id = spix THEN delta END) AS own FROM pair GROUP BY t, spix)"""


def _distances(spark, d):
    s = regions.moments(segments(spark, d))
    n = F.col("n")
    m = s.select("t", "spix", *((F.col(f"s{i}") / n / 255).alias(f"mu{i}") for i in range(3)), (F.col("sx") / n).alias("mx"), (F.col("sy") / n).alias("my"))
    old = m.withColumn("mx", F.col("mx") + 1).withColumn("is_dead", F.col("spix") % 5 == 0)
    return regions.identity_distances(m.where("spix % 5 <> 0"), old, WIDTH, HEIGHT)


@register(f"WITH {_IDENT} SELECT * FROM best")
def relabel_argmin(spark, d):
    return _distances(spark, d)


@register(f"""WITH {_IDENT}, w AS (SELECT *, delta < 0.2 AND candidate <> spix AS wants FROM best), k AS (SELECT *, row_number() OVER (PARTITION BY t, candidate, wants ORDER BY delta, spix) AS k FROM w)
    SELECT t, spix, candidate, delta, own, CASE WHEN wants AND k = 1 THEN 'revive' WHEN NOT wants AND own > 0.003 THEN 'new' ELSE 'keep' END AS action FROM k""")
def relabel_decision(spark, d):
    return regions.identity_decisions(_distances(spark, d), 0.2, 0.003)


_SIGMA = 0.009


def _m(p: str, c: str = "") -> str:
    """SQL for the closed-form marginal of the moments with that prefix (or of a sum of two)."""
    n, b0 = f"({p}n{' + ' + c + 'n' if c else ''})", 2 * _SIGMA * 1e4
    s = [f"({p}s{i}{' + ' + c + f's{i}' if c else ''})" for i in range(3)]
    q = [f"({p}q{i}{' + ' + c + f'q{i}' if c else ''})" for i in range(3)]
    return "(" + " + ".join(f"((1e4::DOUBLE + {n} / 2) * ({math.log(b0)!r}::DOUBLE - ln({b0!r}::DOUBLE + ({q[i]} - {s[i]} * {s[i]} / {n}) / 2)) - ln({n}) / 2 - {n} * {math.log(math.pi) / 2 + math.log(2)!r}::DOUBLE)" for i in range(3)) + ")"


_HALF = SEG.replace("AS gt FROM px)", "AS gt FROM px), unit AS (SELECT t, y, x, spix, c0 / 255 AS c0, c1 / 255 AS c1, c2 / 255 AS c2 FROM seg)") + ", mom AS (SELECT t, spix, (y + x) % 2 AS side, count(*) AS n, " + ", ".join(f"sum(c{i}) AS s{i}, sum(c{i} * c{i}) AS q{i}" for i in range(3)) + " FROM unit GROUP BY ALL)"
_COLS = ["n", *(f"{c}{i}" for c in "sq" for i in range(3))]


@register(f"""WITH {_HALF}, b AS (SELECT k.t, k.spix, {', '.join(f'k.{c} AS k_{c}, s.{c} AS s_{c}' for c in _COLS)} FROM mom k JOIN mom s ON k.t = s.t AND k.spix = s.spix AND k.side = 0 AND s.side = 1)
    SELECT t, spix, round({_m('k_')} + {_m('s_')} - {_m('k_', 's_')} - 4.0 * (1 - spix % 8 / 8.0), 4) AS h, {_m('k_')} + {_m('s_')} - {_m('k_', 's_')} - 4.0 * (1 - spix % 8 / 8.0) > -2 AND k_n + s_n >= 20 AS accept FROM b""")
def split_proposal_stats(spark, d):
    unit = segments(spark, d).withColumns({f"c{i}": F.col(f"c{i}") / 255 for i in range(3)}).withColumn("side", (F.col("y") + F.col("x")) % 2)
    m = regions.moments(unit, squares=True, key=("t", "spix", "side"))
    parts = [m.where(F.col("side") == k).select("t", "spix", *(F.col(c).alias(f"{p}{c}") for c in _COLS)) for k, p in ((0, "k_"), (1, "s_"))]
    both = parts[0].join(parts[1], ["t", "spix"]).withColumn("iperc", F.col("spix") % 8 / 8)
    return regions.split_scores(both, _SIGMA, gamma=4.0, least_size=20).select("t", "spix", F.round("h", 4).alias("h"), "accept")


_CAND = SEG + ", cand AS (SELECT t, spix, max(s) AS target FROM (SELECT t, spix, lead(spix) OVER (PARTITION BY t, x ORDER BY y) AS s FROM seg) WHERE s <> spix GROUP BY t, spix)"


@register(f"WITH {_CAND} SELECT * FROM cand")
def merge_candidates(spark, d):
    return regions.merge_candidates(segments(spark, d))


_MERGE = _CAND + ", unit AS (SELECT t, spix, c0 / 255 AS c0, c1 / 255 AS c1, c2 / 255 AS c2 FROM seg), mom AS (SELECT t, spix, count(*) AS n, " + ", ".join(f"sum(c{i}) AS s{i}, sum(c{i} * c{i}) AS q{i}" for i in range(3)) + f""" FROM unit GROUP BY ALL),
    b AS (SELECT c.t, c.spix, c.target, {', '.join(f'k.{c} AS k_{c}, f.{c} AS f_{c}' for c in _COLS)} FROM cand c JOIN mom k ON k.t = c.t AND k.spix = c.spix JOIN mom f ON f.t = c.t AND f.spix = c.target),
    h AS (SELECT t, spix, target, {_m('k_', 'f_')} - {math.log(0.5)!r} - {_m('k_')} - {_m('f_')} AS h FROM b)"""


def _merge(spark, d):
    seg = segments(spark, d)
    unit = seg.withColumns({f"c{i}": F.col(f"c{i}") / 255 for i in range(3)})
    return regions.merge_scores(regions.merge_candidates(seg), regions.moments(unit, squares=True), _SIGMA, math.log(0.5))


@register(f"WITH {_MERGE} SELECT t, spix, target, round(h, 4) AS h FROM h")
def merge_scores(spark, d):
    return rnd(_merge(spark, d), 4, "h")


@register(f"""WITH {_MERGE}, r AS (SELECT t, spix, target, round(h, 4) AS h, row_number() OVER (PARTITION BY t, target ORDER BY round(h, 4) DESC, spix) AS k FROM h WHERE round(h, 4) > -2), c AS (SELECT t, spix, target, h FROM r WHERE k = 1)
    SELECT c.t, c.spix, c.target, c.h FROM c LEFT JOIN c b ON b.t = c.t AND b.spix = c.target WHERE b.target IS NULL OR (b.target = c.spix AND c.spix < c.target)""")
def merge_accept(spark, d):
    return regions.merge_accepted(rnd(_merge(spark, d), 4, "h"))




def _estep_sql() -> str:
    from .pixels import NEAR, SIMPLE_CODES

    around = ("nw", "n", "ne", "w", "e", "sw", "s", "se")
    code = lambda d: "(" + " + ".join(f"CASE WHEN {o} IS NULL OR {o} = {d} THEN {1 << i} ELSE 0 END" for i, o in enumerate(around)) + ")"
    ok = " AND ".join(f"({d} IS NULL OR {code(d)} IN ({SIMPLE_CODES}))" for d in "nswe")
    ctes = _params_sql(25.0).replace(SEG, NEAR) + f", act AS (SELECT * FROM near8 WHERE x % 2 = 0 AND y % 2 = 0 AND (n IS NULL OR s IS NULL OR w IS NULL OR e IS NULL OR n <> spix OR s <> spix OR w <> spix OR e <> spix) AND {ok})"
    parts = []
    for k, d in enumerate("nswe"):
        unlike = " + ".join(f"CASE WHEN {o} IS NOT NULL AND {o} <> {d} THEN 1 ELSE 0 END" for o in ("n", "s", "w", "e", "nw", "ne", "sw", "se"))
        d0, d1 = "trunc(a.x - p.mx)", "trunc(a.y - p.my)"
        parts.append(f"""SELECT a.t, a.y, a.x, a.spix, {k} AS k, {d} AS label, round(-1000 - (pow(c0 - p.mu0, 2) + pow(c1 - p.mu1, 2) + pow(c2 - p.mu2, 2)) / 100.0 - ({d0} * {d0} * ixx + {d1} * {d1} * iyy + 2 * {d0} * {d1} * ixy) - logdet - 10.0 * ({unlike}), 6) AS score
            FROM act a JOIN (SELECT * EXCLUDE (n) FROM par) p ON p.t = a.t AND p.spix = a.{d}""")
    return f"WITH {ctes}, sc AS ({' UNION ALL '.join(parts)}) SELECT t, y, x, any_value(spix) AS spix, arg_max(label, row(score, -k)) AS label, max(score) AS score FROM sc GROUP BY t, y, x"


@register(_estep_sql())
def estep_one_phase(spark, d):
    seg = segments(spark, d)
    return regions.border_scores(seg, _params(spark, d), 100.0, 10.0, (0, 0))


_OV = SEG + ", ov AS (SELECT t, spix, gt, count(*) AS m FROM seg GROUP BY t, spix, gt), cell AS (SELECT *, sum(m) OVER (PARTITION BY t, spix) AS n FROM ov)"


@register(f"WITH {_OV}, b AS (SELECT t, spix, max(m) AS best, sum(m) AS n FROM ov GROUP BY t, spix) SELECT t, CAST(sum(best) / sum(n) AS DOUBLE) AS asa FROM b GROUP BY t")
def asa(spark, d):
    return metrics.asa(segments(spark, d))


def _edge_sql(c: str, n: str) -> str:
    return f"""{n}0 AS (SELECT t, y, x, {c} AS a, lead({c}) OVER r AS b FROM seg WINDOW r AS (PARTITION BY t, y ORDER BY x)),
        {n}1 AS (SELECT *, lead(a) OVER q AS c, lead(b) OVER q AS d FROM {n}0 WINDOW q AS (PARTITION BY t, x ORDER BY y)), {n} AS (SELECT t, y, x, CAST(a <> d OR b <> d OR c <> d AS INTEGER) AS edge FROM {n}1 WHERE d IS NOT NULL)"""


_BOUND = f"""WITH {SEG}, {_edge_sql('spix', 'sp')}, {_edge_sql('gt', 'tr')}, w1 AS (SELECT t, y, x, max(edge) OVER (PARTITION BY t, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS e FROM sp),
    w2 AS (SELECT t, y, x, max(e) OVER (PARTITION BY t, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS e FROM w1), j AS (SELECT w2.t, w2.e, tr.edge FROM w2 JOIN tr USING (t, y, x))"""


@register(_BOUND + " SELECT t, sum(e * edge) / sum(edge) AS recall FROM j GROUP BY t")
def boundary_recall(spark, d):
    return metrics.boundary_scores(segments(spark, d)).select("t", "recall")


@register(_BOUND + " SELECT t, sum(e * edge) / sum(e) AS precision FROM j GROUP BY t")
def boundary_precision(spark, d):
    return metrics.boundary_scores(segments(spark, d)).select("t", "precision")


_SUMS = {"a": "c0", "b": "m0", "aa": "c0 * c0", "bb": "m0 * m0", "ab": "c0 * m0"}
_R, _C = "(PARTITION BY t, y ORDER BY x ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)", "(PARTITION BY t, x ORDER BY y ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"


@register(f"""WITH {_POOL}, r AS (SELECT t, y, x, count(*) OVER {_R} AS k, {', '.join(f'sum({e}) OVER {_R} AS {n}' for n, e in _SUMS.items())} FROM pool),
    c AS (SELECT t, sum(k) OVER {_C} AS k, {', '.join(f'sum({n}) OVER {_C} AS {n}' for n in _SUMS)} FROM r),
    v AS (SELECT t, a / 49 AS p, b / 49 AS q, (49.0::DOUBLE / 48) * (aa / 49 - (a / 49) * (a / 49)) AS va, (49.0::DOUBLE / 48) * (bb / 49 - (b / 49) * (b / 49)) AS vb, (49.0::DOUBLE / 48) * (ab / 49 - (a / 49) * (b / 49)) AS vab FROM c WHERE k = 49)
    SELECT t, round(avg((2 * p * q + 6.5025::DOUBLE) * (2 * vab + 58.5225::DOUBLE) / ((p * p + q * q + 6.5025::DOUBLE) * (va + vb + 58.5225::DOUBLE))), 6) AS ssim FROM v GROUP BY t""")
def ssim(spark, d):
    return rnd(metrics.ssim(regions.pooled_video(segments(spark, d)), "c0", "m0"), 6, "ssim")


@register(f"""WITH {PX}, s AS (SELECT t, pow(lead(c0) OVER r - c0, 2) AS h, x % 8 = 7 AS eh, pow(lead(c0) OVER c - c0, 2) AS v, y % 8 = 7 AS ev FROM px WINDOW r AS (PARTITION BY t, y ORDER BY x), c AS (PARTITION BY t, x ORDER BY y)),
    u AS (SELECT t, h AS d, eh AS e FROM s WHERE h IS NOT NULL UNION ALL SELECT t, v, ev FROM s WHERE v IS NOT NULL)
    SELECT t, round(greatest(avg(d) FILTER (e) - avg(d) FILTER (NOT e), 0.0), 6) + 0.0 AS bef FROM u GROUP BY t""")
def blocking_effect(spark, d):
    return metrics.blocking_effect(segments(spark, d)).select("t", (F.round("bef", 6) + F.lit(0.0)).alias("bef"))


@register(f"""WITH {SEG}, h AS (SELECT t, 1 / (1 + exp(-(c0 - 128) / 32)) > 0.5 AS h, gt % 2 > 0 AS p FROM seg)
    SELECT t, count(*) FILTER (h AND p) / count(*) FILTER (p) AS tpr, count(*) FILTER (NOT h AND NOT p) / count(*) FILTER (NOT p) AS tnr, count(*) FILTER (p) / count(*) AS positive FROM h GROUP BY t""")
def tpr_tnr(spark, d):
    s = segments(spark, d).select("t", ((F.col("c0") - 128) / 32).alias("score"), (F.col("gt") % 2).alias("truth"))
    return metrics.rates(s, "score", "truth")




def _changing(spark, d):
    """Regions whose number and sizes change from frame to frame."""
    return segments(spark, d).withColumn("spix", F.expr("cast((y div 5) * 10 + x div (5 + t % 3) AS int)"))


_CHANGE = SEG.replace("CAST((y // 5) * 10 + x // 5 AS INTEGER)", "CAST((y // 5) * 10 + x // (5 + t % 3) AS INTEGER)")


@register(f"WITH {_CHANGE}, c AS (SELECT DISTINCT t, spix FROM seg) SELECT count(*) / (count(DISTINCT t) * (max(spix) + 1)) AS tex FROM c")
def tex(spark, d):
    return metrics.temporal_extent(_changing(spark, d))


@register(f"WITH {_CHANGE}, c AS (SELECT t, spix, count(*) AS n FROM seg GROUP BY t, spix), v AS (SELECT spix, stddev_samp(n) AS sd FROM c GROUP BY spix HAVING count(*) > 1) SELECT round(avg(sd), 6) AS szv FROM v")
def szv(spark, d):
    return rnd(metrics.size_variation(_changing(spark, d)), 6, "szv")


def _ev_sql(part: str, scale: str) -> str:
    m = ", ".join(f"avg(c{i}) OVER (PARTITION BY {part}) AS m{i}, avg(c{i}) OVER (PARTITION BY t) AS u{i}" for i in range(3))
    p, q = (" + ".join(f"pow(({c}{i} - u{i}) * {scale}, 2)" for i in range(3)) for c in "mc")
    return f"WITH {SEG}, m AS (SELECT *, {m} FROM seg), e AS (SELECT t, sum({p}) / (sum({q}) + 1e-10) AS ev FROM m GROUP BY t) SELECT round(avg(ev), 6) AS ev FROM e"


@register(_ev_sql("t, spix", "1.0"))
def explained_variance(spark, d):
    return rnd(metrics.explained_variation(segments(spark, d)), 6, "ev")


@register(_ev_sql("spix", "255.0"))
def explained_variance_3d(spark, d):
    return rnd(metrics.explained_variation(segments(spark, d), over_time=True, scale=255.0), 6, "ev")


@register(f"WITH {_OV}, u AS (SELECT sum(least(n - m, m)) AS u FROM cell), k AS (SELECT count(DISTINCT t) * count(DISTINCT gt) AS k FROM seg) SELECT round(u / {AREA} / k, 9) AS ue2d FROM u, k")
def ue2d(spark, d):
    return rnd(metrics.undersegmentation(segments(spark, d), AREA), 9, "ue2d")


@register(f"WITH {_OV}, p AS (SELECT spix, gt, sum(n - m) AS o, sum(m) AS m FROM cell GROUP BY spix, gt), g AS (SELECT gt, sum(least(o, m)) AS u FROM p GROUP BY gt), f AS (SELECT count(DISTINCT t) AS f FROM seg) SELECT round(avg(u) / (any_value(f) * {AREA}), 9) AS ue3d FROM g, f")
def ue3d(spark, d):
    return rnd(metrics.undersegmentation_3d(segments(spark, d), AREA), 9, "ue3d")


@register(f"WITH {_OV}, r AS (SELECT t, gt, sum(CASE WHEN m >= 0.5 * n THEN m ELSE 0 END) / sum(m) AS r FROM cell GROUP BY t, gt), l AS (SELECT gt, avg(r) AS r FROM r GROUP BY gt) SELECT round(avg(r), 6) AS sa2d FROM l WHERE gt > (SELECT min(gt) FROM seg)")
def sa2d(spark, d):
    return rnd(metrics.accuracy(segments(spark, d)), 6, "sa2d")


@register(f"WITH {SEG}, o AS (SELECT spix, gt, count(*) AS m FROM seg GROUP BY spix, gt), c AS (SELECT *, sum(m) OVER (PARTITION BY spix) AS n FROM o), l AS (SELECT gt, sum(CASE WHEN m >= 0.5 * n THEN m ELSE 0 END) / sum(m) AS r FROM c GROUP BY gt) SELECT round(avg(r), 6) AS sa3d FROM l WHERE gt > (SELECT min(gt) FROM seg)")
def sa3d(spark, d):
    return rnd(metrics.accuracy_3d(segments(spark, d)), 6, "sa3d")


_K = _CHANGE + ", k AS (SELECT t, CAST(count(DISTINCT spix) AS DOUBLE) AS k, max(spix) AS top FROM seg GROUP BY t)"


@register(f"WITH {_K} SELECT CAST(max(top) + 1 AS BIGINT) AS spnum, round(avg(k), 6) AS ave_nsp, round(stddev_samp(k), 6) AS std_nsp FROM k")
def nspix_stats(spark, d):
    return rnd(metrics.count_stats(_changing(spark, d)), 6, "ave_nsp", "std_nsp")


@register(f"WITH {_K} SELECT round(avg(pow(k - 50, 2)), 6) AS ave_delta_nsp, round(stddev_samp(pow(k - 50, 2)), 6) AS std_delta_nsp FROM k")
def delta_nspix(spark, d):
    return rnd(metrics.count_stats(_changing(spark, d), 50), 6, "ave_delta_nsp", "std_delta_nsp").select("ave_delta_nsp", "std_delta_nsp")


@register(f"WITH {SEG}, c AS (SELECT t, gt, count(*) AS n FROM seg GROUP BY t, gt) SELECT t, gt, n FROM c ORDER BY n DESC, t, gt LIMIT 20")
def topk_regions(spark, d):
    return metrics.largest_cells(segments(spark, d), 20)


@register(f"WITH {SEG} SELECT t, y, x, spix FROM seg WHERE t < 3")
def limit_frames(spark, d):
    return segments(spark, d).where("t < 3").select("t", "y", "x", "spix")


@register(f"WITH {SEG} SELECT DISTINCT spix FROM seg")
def unique_ids(spark, d):
    return segments(spark, d).select("spix").distinct()


@register(f"WITH {_CHANGE} SELECT 'tex' AS metric, count(*) AS n FROM seg UNION ALL SELECT 'rows', count(DISTINCT spix) FROM seg")
def union_results(spark, d):
    s = _changing(spark, d)
    return experiments.united({"tex": s.agg(F.count("*").alias("n")), "rows": s.agg(F.countDistinct("spix").alias("n"))}, "metric")


@register("SELECT i::INTEGER AS x FROM range(50) r(i) WHERE i % 8 <> 7")
def except_blocks(spark, d):
    return stencil.inside_blocks(spark, WIDTH)


@register("WITH r AS (SELECT o_orderpriority AS grp, o_orderstatus AS id, o_totalprice AS v FROM orders) SELECT grp, id, count(*) AS n, round(avg(v), 4) AS mean, round(stddev_samp(v) / sqrt(count(*)), 4) AS stderr FROM r GROUP BY grp, id")
def results_mean_stderr(spark, d):
    o = table(spark, d, "orders").selectExpr("o_orderpriority AS grp", "o_orderstatus AS id", "o_totalprice AS v")
    return o.groupBy("grp", "id").agg(F.count("*").alias("n"), F.round(F.avg("v"), 4).alias("mean"), F.round(F.stddev_samp("v") / F.sqrt(F.count("*")), 4).alias("stderr"))


@register("SELECT c_custkey, n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 2) ON c_nationkey = n_nationkey")
def results_left_join(spark, d):
    n = table(spark, d, "nation").where("n_regionkey < 2")
    return experiments.with_results(table(spark, d, "customer"), n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


@register("SELECT l_shipmode_bucket AS bucket, round(quantile_cont(v, 0.5), 6) AS median, round(stddev_pop(v), 6) AS sd FROM (SELECT l_linenumber AS l_shipmode_bucket, l_quantity AS v FROM lineitem) GROUP BY ALL")
def timing_quantiles(spark, d):
    li = table(spark, d, "lineitem").selectExpr("l_linenumber AS bucket", "l_quantity AS v")
    return rnd(experiments.timings(li, ["bucket"], "v"), 6, "median", "sd")


def _value(name: str) -> str:
    """The oracle of another query as a scalar."""
    return f"({ORACLES[name]})"


@register(f"""SELECT * FROM {_value('tex')} a, {_value('szv')} b, (SELECT ev FROM {_value('explained_variance')}) c, (SELECT ev AS ev3d FROM {_value('explained_variance_3d')}) e, {_value('ue2d')} f, {_value('ue3d')} g, {_value('sa2d')} h, {_value('sa3d')} i, {_value('nspix_stats')} j,
    (SELECT round(avg(psnr), 4) AS pooling FROM {_value('pooling_psnr')}) k, (SELECT -1.0::DOUBLE AS ave_delta_nsp, -1.0::DOUBLE AS std_delta_nsp, -1.0::DOUBLE AS strred0, -1.0::DOUBLE AS strred1) l""".replace(_CHANGE, SEG))
def evaluation(spark, d):
    out = metrics.evaluate(segments(spark, d), AREA)
    digits = {"szv": 6, "ev": 6, "ev3d": 6, "ue2d": 9, "ue3d": 9, "sa2d": 6, "sa3d": 6, "ave_nsp": 6, "std_nsp": 6, "pooling": 4}
    return out.withColumns({k: F.round(k, n) for k, n in digits.items()})


@register(f"WITH {_NEW} SELECT DISTINCT t, spix FROM seg WHERE spix >= 60")
def new_ids(spark, d):
    return regions.new_ids(_scattered(spark, d), 60)


@register(f"WITH {MOM} SELECT t, spix FROM mom WHERE abs(s0 / n) > 150")
def range_check(spark, d):
    return regions.out_of_range(_params(spark, d), "mu0", 150)


@register("SELECT o_orderpriority AS grp, printf('%.2f', avg(o_totalprice)) AS price_mean, printf('%.1f', round(count(*) / 10.0, 1)) AS tex FROM orders GROUP BY ALL")
def format_table(spark, d):
    from ..functions.display import formatted

    o = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("grp")).agg(F.round(F.avg("o_totalprice"), 6).alias("price_mean"), F.round(F.count("*") / 10, 1).alias("tex"))
    return formatted(o, {"price": 2, "tex": 1})
