"""Queries over pixels and labels: scalar functions, stencils, initial cells, motion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import algebra, color, display
from ..operators import motion, regions, stencil
from ..sources.testdata import FLOW, HEIGHT, PX, SEG, WIDTH, flows, pixels, segments

QUERIES: dict = {}
ORACLES: dict = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(columns: dict, digits: int = 6) -> list:
    return [F.round(c, digits).alias(k) for k, c in columns.items()]


@register(f"WITH {PX} SELECT t, y, x, CAST(y * {WIDTH} + x AS BIGINT) AS p, c0, c1, c2 FROM px")
def pixel_grid(spark, d):
    return pixels(spark, d).select("t", "y", "x", (F.col("y").cast("long") * WIDTH + F.col("x")).alias("p"), "c0", "c1", "c2")


@register(f"WITH {PX} SELECT t, y, x, round(c0 / 255.0, 6) AS c0, round(c1 / 255.0, 6) AS c1, round(c2 / 255.0, 6) AS c2 FROM px")
def rgb_rescale(spark, d):
    return pixels(spark, d).select("t", "y", "x", *rounded({f"c{i}": color.rescale(F.col(f"c{i}")) for i in range(3)}))


_LIN = ", ".join(f"CASE WHEN c{i} / 255.0 <= 0.04045 THEN c{i} / 255.0 / 12.92 ELSE pow((c{i} / 255.0 + 0.055) / 1.055, 2.4) END AS l{i}" for i in range(3))
_XYZ = ", ".join(f"(l0 * {r[0]} + l1 * {r[1]} + l2 * {r[2]}) / {w} AS {n}" for r, w, n in zip(color.TO_XYZ, color.WHITE, "abc", strict=True))
_CURVE = ", ".join(f"CASE WHEN {n} > 0.008856 THEN cbrt({n}) ELSE (903.3 * {n} + 16) / 116 END AS f{n}" for n in "abc")
LAB = PX + f", lin AS (SELECT t, y, x, {_LIN} FROM px), xyz AS (SELECT t, y, x, {_XYZ} FROM lin), cur AS (SELECT t, y, x, {_CURVE} FROM xyz), lab AS (SELECT t, y, x, (fb * 116 - 16) / -100 AS l, (fa - fb) * 500 / 100 AS a, (fb - fc) * 200 / 100 AS b FROM cur)"


def _lab(spark, d):
    return pixels(spark, d).select("t", "y", "x", *(c.alias(n) for n, c in zip("lab", color.rgb_to_lab(*(color.rescale(F.col(f"c{i}")) for i in range(3))), strict=True)))


@register(f"WITH {LAB} SELECT t, y, x, round(l, 6) + 0.0 AS l, round(a, 6) + 0.0 AS a, round(b, 6) + 0.0 AS b FROM lab")
def rgb_to_lab(spark, d):
    return _lab(spark, d).select("t", "y", "x", *((F.round(c, 6) + F.lit(0.0)).alias(c) for c in "lab"))


_CUBES = "pow((l * -100 + 16) / 116, 3)"


@register(f"""WITH {LAB}, f AS (SELECT t, y, x, (l * -100 + 16) / 116 AS fy, (l * -100 + 16) / 116 + a * 100 / 500 AS fx, (l * -100 + 16) / 116 - b * 100 / 200 AS fz FROM lab),
    v AS (SELECT t, y, x, 0.950456 * CASE WHEN fx * fx * fx > 0.008856 THEN fx * fx * fx ELSE (fx - 16.0 / 116) / 7.787 END AS vx, CASE WHEN fy * fy * fy > 0.008856 THEN fy * fy * fy ELSE (fy - 16.0 / 116) / 7.787 END AS vy,
        1.088754 * CASE WHEN fz * fz * fz > 0.008856 THEN fz * fz * fz ELSE (fz - 16.0 / 116) / 7.787 END AS vz FROM f),
    m AS (SELECT t, y, x, greatest(3.2406 * vx - 1.5372 * vy - 0.4986 * vz, 0) AS r, greatest(-0.9689 * vx + 1.8758 * vy + 0.0415 * vz, 0) AS g, greatest(0.0557 * vx - 0.2040 * vy + 1.0570 * vz, 0) AS b FROM v)
    SELECT t, y, x, {", ".join(f"round(least(greatest(CASE WHEN {n} <= 0.0031308 THEN {n} * 12.92 ELSE pow({n}, 1 / 2.4) * 1.055 - 0.055 END, 0), 1), 5) + 0.0 AS {n}" for n in "rgb")} FROM m""")
def lab_to_rgb(spark, d):
    back = color.lab_to_rgb(F.col("l"), F.col("a"), F.col("b"))
    return _lab(spark, d).select("t", "y", "x", *((F.round(c, 5) + F.lit(0.0)).alias(n) for n, c in zip("rgb", back, strict=True)))


@register(f"WITH {PX} SELECT t, y, x, round(c0 * 0.2126 + c1 * 0.7152 + c2 * 0.0722, 6) AS y709 FROM px")
def luminance(spark, d):
    return pixels(spark, d).select("t", "y", "x", F.round(color.luminance(F.col("c0"), F.col("c1"), F.col("c2")), 6).alias("y709"))


@register(f"WITH {PX} SELECT t, y, x, c0 FROM px WHERE y BETWEEN 5 AND 19 AND x BETWEEN 10 AND 39")
def crop(spark, d):
    return stencil.crop(pixels(spark, d), 5, 20, 10, 40).select("t", "y", "x", "c0")


NEAR = SEG + """, near AS (SELECT *, lag(spix) OVER r AS w, lead(spix) OVER r AS e, lag(spix) OVER c AS n, lead(spix) OVER c AS s FROM seg WINDOW r AS (PARTITION BY t, y ORDER BY x), c AS (PARTITION BY t, x ORDER BY y)),
    near8 AS (SELECT *, lag(w) OVER c AS nw, lag(e) OVER c AS ne, lead(w) OVER c AS sw, lead(e) OVER c AS se FROM near WINDOW c AS (PARTITION BY t, x ORDER BY y))"""


@register(f"WITH {NEAR} SELECT t, y, x, spix, n, s, w, e, nw, ne, sw, se FROM near8")
def neighbors8(spark, d):
    return stencil.neighbours(segments(spark, d)).select("t", "y", "x", "spix", "n", "s", "w", "e", "nw", "ne", "sw", "se")


_BORDER = "n IS NULL OR s IS NULL OR w IS NULL OR e IS NULL OR n <> spix OR s <> spix OR w <> spix OR e <> spix"


@register(f"WITH {NEAR} SELECT t, count(*) FILTER ({_BORDER}) AS n_border, CAST(sum(CASE WHEN {_BORDER} THEN y * {WIDTH} + x ELSE 0 END) AS BIGINT) AS place FROM near GROUP BY t")
def border_sym(spark, d):
    b = stencil.border(segments(spark, d))
    return b.groupBy("t").agg(F.count_if("is_border").alias("n_border"), F.sum(F.when(F.col("is_border"), F.col("y") * WIDTH + F.col("x")).otherwise(0)).alias("place"))


@register(f"WITH {NEAR} SELECT t, y, x FROM near WHERE spix > n OR spix > s OR spix > w OR spix > e")
def border_onesided(spark, d):
    return stencil.border_one_sided(segments(spark, d)).where("is_border").select("t", "y", "x")


@register(f"WITH {NEAR} SELECT t, y, x, CASE WHEN {_BORDER} THEN 0.0 ELSE least(greatest(c0 / 255.0, 0.0), 1.0) END AS c0, CASE WHEN {_BORDER} THEN 1.0 ELSE least(greatest(c2 / 255.0, 0.0), 1.0) END AS c2 FROM near")
def overlay_border(spark, d):
    b = stencil.border(segments(spark, d).withColumns({f"c{i}": F.col(f"c{i}") / 255.0 for i in range(3)}))
    return stencil.overlay(b).select("t", "y", "x", "c0", "c2")


_CODE = " + ".join(f"CASE WHEN {n} IS NULL OR {n} = spix THEN {1 << i} ELSE 0 END" for i, n in enumerate(("nw", "n", "ne", "w", "e", "sw", "s", "se")))


def _simple_codes() -> str:
    """SQL for the codes whose same-label neighbours, and also the others, form one run around the centre that holds n, e, s or w.

    A run begins where the neighbour before it is of the other kind; a run of a single corner doesn't count.
    """
    ring = [f"((c >> {bit}) & 1)" for bit in (0, 1, 2, 4, 7, 6, 5, 3)]  # nw n ne e se s sw w
    begun = {k: " + ".join(f"({a} = {k} AND {ring[i - 1]} <> {k})::INT" for i, a in enumerate(ring)) for k in (0, 1)}
    corner = {k: " + ".join(f"({ring[i]} = {k} AND {ring[i - 1]} <> {k} AND {ring[i + 1]} <> {k})::INT" for i in (0, 2, 4, 6)) for k in (0, 1)}
    return f"SELECT c FROM range(256) r(c) WHERE {begun[0]} - ({corner[0]}) = 1 AND {begun[1]} - ({corner[1]}) = 1"


SIMPLE_CODES = _simple_codes()


@register(f"WITH {NEAR}, k AS (SELECT t, y, x, {_CODE} AS code FROM near8) SELECT t, y, x, code, code IN ({SIMPLE_CODES}) AS is_simple FROM k")
def simple_points(spark, d):
    return stencil.simple_points(segments(spark, d)).select("t", "y", "x", "code", "is_simple")


@register(f"WITH {PX} SELECT t, y, x, CAST((y // 7) * 8 + x // 7 AS INTEGER) AS spix FROM px")
def square_init(spark, d):
    return regions.square_cells(pixels(spark, d), 7, WIDTH).select("t", "y", "x", "spix")


@register(f"""WITH {PX}, pitch AS (SELECT sqrt(3) * sqrt(49 / (1.5 * sqrt(3))) AS wide, 1.5 * sqrt(49 / (1.5 * sqrt(3))) AS tall),
    size AS (SELECT *, CAST(floor(50 / wide) AS INTEGER) + 2 AS nx, CAST(floor(30 / tall) AS INTEGER) + 2 AS ny FROM pitch),
    centre AS (SELECT i AS j, (i % nx) * wide + CASE WHEN (i // nx) % 2 = 0 THEN 0.5 * wide ELSE 0 END AS cx, (i // nx) * tall AS cy FROM size, range(400) r(i) WHERE i < nx * ny)
    SELECT t, y, x, CAST(arg_min(j, row(round(pow(x - cx, 2) + pow(y - cy, 2), 6), -j)) AS INTEGER) AS spix FROM px, centre GROUP BY t, y, x""")
def hex_init(spark, d):
    return regions.hex_cells(pixels(spark, d), 7, WIDTH, HEIGHT).select("t", "y", "x", "spix")


@register(f"WITH {FLOW} SELECT t, spix, avg(fx) AS fx, avg(fy) AS fy FROM flow GROUP BY t, spix")
def flow_mean_per_region(spark, d):
    return motion.mean_flow(flows(spark, d))


@register(f"WITH {FLOW} SELECT t, y, x, k AS factor, fx * k AS fx, fy * k AS fy FROM flow, (VALUES (0.0::DOUBLE), (0.25), (0.5), (1.0)) v(k)")
def flow_scaled(spark, d):
    return motion.scaled(flows(spark, d), [0.0, 0.25, 0.5, 1.0])


def _shift_sql(order: str) -> str:
    return f"""WITH {FLOW}, size AS (SELECT t, spix, count(*) AS n, avg(fx) AS fx, avg(fy) AS fy FROM flow GROUP BY t, spix),
        moved AS (SELECT t + 1 AS t, CAST(y + round(size.fy) AS INTEGER) AS y, CAST(x + round(size.fx) AS INTEGER) AS x, spix, n FROM seg JOIN size USING (t, spix))
        SELECT t, y, x, arg_min(spix, row({order}, spix)) AS spix FROM moved WHERE y BETWEEN 0 AND {HEIGHT - 1} AND x BETWEEN 0 AND {WIDTH - 1} GROUP BY t, y, x"""


def _uneven(spark, d):
    """Regions of two sizes, so that the size decides collisions."""
    return segments(spark, d).withColumn("spix", F.expr("IF(spix % 10 IN (3, 4), spix - spix % 10 + 3, spix)"))


def _uneven_flow(spark, d):
    return flows(spark, d).withColumn("spix", F.expr("IF(spix % 10 IN (3, 4), spix - spix % 10 + 3, spix)"))


_UNEVEN = FLOW.replace("SELECT *, CAST((y // 5) * 10 + x // 5 AS INTEGER) AS spix", "SELECT *, CAST((y // 5) * 10 + CASE WHEN x // 5 IN (3, 4) THEN 3 ELSE x // 5 END AS INTEGER) AS spix").replace("CAST(spix % 3 - 1 AS DOUBLE)", "CAST(((y // 5) * 10 + x // 5) % 3 - 1 AS DOUBLE)").replace("CAST(spix // 3 % 3 - 1 AS DOUBLE)", "CAST(((y // 5) * 10 + x // 5) // 3 % 3 - 1 AS DOUBLE)")


@register(_shift_sql("n").replace(FLOW, _UNEVEN))
def shift_labels(spark, d):
    return motion.shift_labels(_uneven(spark, d), motion.mean_flow(_uneven_flow(spark, d)), WIDTH, HEIGHT)


@register(_shift_sql("-n").replace(FLOW, _UNEVEN))
def shift_labels_large(spark, d):
    return motion.shift_labels(_uneven(spark, d), motion.mean_flow(_uneven_flow(spark, d)), WIDTH, HEIGHT, smaller_wins=False)


_HOLES = SEG + ", hole AS (SELECT t, y, x, CASE WHEN x BETWEEN 10 AND 20 AND y BETWEEN 7 AND 15 THEN NULL ELSE spix END AS spix FROM seg), hn AS (SELECT *, lag(spix) OVER r AS w, lead(spix) OVER r AS e, lag(spix) OVER c AS n, lead(spix) OVER c AS s FROM hole WINDOW r AS (PARTITION BY t, y ORDER BY x), c AS (PARTITION BY t, x ORDER BY y))"


def holes(spark, d):
    return segments(spark, d).withColumn("spix", F.expr("IF(x BETWEEN 10 AND 20 AND y BETWEEN 7 AND 15, NULL, spix)"))


@register(f"WITH {_HOLES} SELECT t, count(*) FILTER (spix IS NULL) AS n_invalid, count(*) AS n FROM hole GROUP BY t")
def count_invalid(spark, d):
    return regions.count_invalid(holes(spark, d))


@register(f"WITH {_HOLES} SELECT t, y, x FROM hn WHERE spix IS NULL AND coalesce(n, s, w, e) IS NOT NULL")
def missing_border(spark, d):
    return motion.missing_border(holes(spark, d))


@register(f"""WITH {_HOLES}, m AS (SELECT t, spix, avg(x) AS mx, avg(y) AS my FROM hole WHERE spix IS NOT NULL GROUP BY t, spix),
    c AS (SELECT DISTINCT t, y, x, unnest([n, s, w, e]) AS label FROM hn WHERE spix IS NULL),
    b AS (SELECT c.t, y, x, arg_min(label, row(round(pow((x - mx) / {WIDTH}, 2) + pow((y - my) / {HEIGHT}, 2), 9), label)) AS filled FROM c JOIN m ON m.t = c.t AND m.spix = label GROUP BY c.t, y, x)
    SELECT hole.t, hole.y, hole.x, coalesce(spix, filled) AS spix FROM hole LEFT JOIN b ON b.t = hole.t AND b.y = hole.y AND b.x = hole.x""")
def fill_one_pass(spark, d):
    seg = holes(spark, d)
    centres = seg.where("spix IS NOT NULL").groupBy("t", "spix").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    return motion.fill_once(seg, centres, WIDTH, HEIGHT).select("t", "y", "x", "spix")


@register(f"WITH {_HOLES} SELECT t, round(count(*) FILTER (spix IS NULL) / count(*), 9) AS share, CASE WHEN count(*) FILTER (spix IS NULL) / count(*) < 0.01 THEN 4 WHEN count(*) FILTER (spix IS NULL) / count(*) > 0.2 THEN 12 ELSE 8 END AS rounds FROM hole GROUP BY t")
def adaptive_rounds(spark, d):
    return motion.invalid_share(holes(spark, d)).withColumn("share", F.round("share", 9))


@register(f"""WITH {_HOLES}, a AS (SELECT t, spix, count(*) AS after FROM seg GROUP BY t, spix), b AS (SELECT t, spix, count(*) AS before FROM hole WHERE spix IS NOT NULL GROUP BY t, spix)
    SELECT t, spix, round((after - coalesce(before, 0)) / (after + 1e-8), 6) AS icount FROM a LEFT JOIN b USING (t, spix)""")
def region_invalid(spark, d):
    return motion.region_invalid_share(holes(spark, d), segments(spark, d)).withColumn("icount", F.round("icount", 6))


_MUL = "CAST(CAST({h} AS HUGEINT) * {k} % 4294967296 AS BIGINT)"


@register(f"""WITH {PX}, h0 AS (SELECT t, y, x, xor(CAST(y * {WIDTH} + x AS BIGINT), 123) AS h FROM px), h1 AS (SELECT t, y, x, xor(h, h >> 16) AS h FROM h0), h2 AS (SELECT t, y, x, {_MUL.format(h="h", k=0x85EBCA6B)} AS h FROM h1),
    h3 AS (SELECT t, y, x, xor(h, h >> 13) AS h FROM h2), h4 AS (SELECT t, y, x, {_MUL.format(h="h", k=0xC2B2AE35)} AS h FROM h3), h5 AS (SELECT t, y, x, xor(h, h >> 16) AS h FROM h4) SELECT t, y, x, round((h & 16777215) / 16777215.0, 9) AS u FROM h5""")
def hash_unit(spark, d):
    return pixels(spark, d).select("t", "y", "x", F.round(algebra.hash_unit(F.lit(123), F.col("y") * WIDTH + F.col("x")), 9).alias("u"))


@register(f"WITH {SEG} SELECT p.t, p.y, p.x, coalesce(q.spix, 0) AS spix FROM px p LEFT JOIN seg q ON q.t = p.t AND q.y = p.y AND q.x = p.x + (p.y % 3) - 1")
def index_gather(spark, d):
    at = pixels(spark, d).select("t", "y", "x", (F.col("x") + F.col("y") % 3 - 1).alias("at"))
    return stencil.gathered(at, segments(spark, d))


def _unfold_sql() -> str:
    near = ", ".join(f"coalesce(lag(l, {-k}) OVER c, [0.0, 0.0, 0.0])" if k < 0 else f"coalesce(lead(l, {k}) OVER c, [0.0, 0.0, 0.0])" if k else "l" for k in (-1, 0, 1))
    return f"WITH {PX}, r AS (SELECT t, y, x, [coalesce(lag(c0) OVER w, 0.0), c0, coalesce(lead(c0) OVER w, 0.0)] AS l FROM px WINDOW w AS (PARTITION BY t, y ORDER BY x)) SELECT t, y, x, flatten([{near}]) AS near FROM r WINDOW c AS (PARTITION BY t, x ORDER BY y)"


@register(_unfold_sql())
def unfold(spark, d):
    return stencil.unfold(pixels(spark, d), "c0")


@register(f"WITH {_HOLES} SELECT t, y, x, CASE WHEN spix IS NULL THEN 255.0::DOUBLE ELSE CAST(spix AS DOUBLE) END AS shade FROM hole")
def fill_background(spark, d):
    return holes(spark, d).select("t", "y", "x", display.with_background("spix", F.col("spix").cast("double"), 255.0).alias("shade"))


_WHEEL = display.colour_wheel(6)


@register(f"WITH {SEG}, pal AS (SELECT * FROM (VALUES {', '.join(f'({i}, {r!r}::DOUBLE, {g!r}::DOUBLE, {b!r}::DOUBLE)' for i, (r, g, b) in enumerate(_WHEEL))}) p(i, r, g, b)) SELECT t, y, x, r, g, b FROM seg JOIN pal ON i = spix % 6")
def painted_labels(spark, d):
    return display.painted(segments(spark, d), "spix", _WHEEL).select("t", "y", "x", "r", "g", "b")


@register(f"WITH {FLOW}, m AS (SELECT t, spix, avg(x) AS mx, avg(y) AS my, avg(fx) AS fx, avg(fy) AS fy FROM flow GROUP BY t, spix) SELECT t, spix, mx + fx AS mx, my + fy AS my FROM m")
def shifted_centres(spark, d):
    seg = segments(spark, d).groupBy("t", "spix").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    return motion.shifted_centres(seg, motion.mean_flow(flows(spark, d)))
