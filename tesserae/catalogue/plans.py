"""Queries over the iterative algorithms (with what must hold of their results), experiments and the stream."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.regions import pooled_video
from ..plans import drivers, experiments, loops, mesh
from ..plans import frame as kernel
from ..plans.frame import PHASES, Options
from ..sources.testdata import BAND, EDGE, PX, SEG, STRIPE, VERTEX, bands, drift, edges, flows, pixels, segments, stripes, table
from . import scores
from .graphs import stored_graph
from .pixels import holes

QUERIES: dict = {}
ORACLES: dict = {}
SMALL = Options(sp_size=7, niters=8, sigma_app=0.3)
#: For the stripes, whose colours are far apart.
SHARP = Options(sp_size=7, niters=16, sigma_app=0.02)


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def unit(df):
    return df.withColumns({f"c{i}": F.col(f"c{i}") / 255 for i in range(3)})


def region_colours(labels, pixels, most: int = 45):
    """t, y, x and the mean colour of each pixel's region, which is its own colour if no region goes beyond a stripe; and
    whether the frame has so few regions that they hold many pixels each. Labels take few bytes in files, by which the planner
    would broadcast them."""
    labels = loops.cut(labels.select("t", "y", "x", "spix")).hint("merge")
    found = labels.join(pixels, ["t", "y", "x"])
    few = labels.groupBy("t").agg((F.countDistinct("spix") <= most).alias("few"))
    return pooled_video(found).join(few, "t").select("t", "y", "x", *((F.round(f"m{i}", 6) + F.lit(0.0)).alias(f"m{i}") for i in (0, 1)), "few")


_OWN_COLOURS = f"WITH {STRIPE} SELECT t, y, x, round(c0, 6) + 0.0 AS m0, round(c1, 6) + 0.0 AS m1, true AS few FROM stripe"
_BAND_COLOURS = f"WITH {BAND} SELECT t, y, x, round(c0, 6) + 0.0 AS m0, round(c1, 6) + 0.0 AS m1, true AS few FROM band"


@register(_BAND_COLOURS)
def segment_frames(spark, d):
    """Regions of single frames end where the bands do, and are few."""
    px = bands(spark, d)
    return region_colours(drivers.segment_frames(px, SHARP), px)


@register(_BAND_COLOURS)
def segment_frames_batched(spark, d):
    px = bands(spark, d)
    return region_colours(drivers.segment_frames_batched(px, SHARP), px)


@register(f"WITH {PX} SELECT t, count(*) AS n, count(*) AS n_same FROM px GROUP BY t")
def segment_frames_alone(spark, d):
    """Frames taken together and one by one: the pixels with the same label."""
    px = unit(pixels(spark, d)).where("t < 4")
    together = drivers.segment_frames(unit(pixels(spark, d)), SMALL).select("t", "y", "x", F.col("spix").alias("a"))
    alone = reduce(DataFrame.union, [drivers.segment_frames(px.where(F.col("t") == k), SMALL) for k in range(4)])
    later = drivers.segment_frames(unit(pixels(spark, d)).where("t >= 4"), SMALL)
    both = alone.union(later).join(together, ["t", "y", "x"])
    return both.groupBy("t").agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("spix")).alias("n_same"))


@register(_OWN_COLOURS)
def segment_videos(spark, d):
    """Regions of a video follow the stripes from frame to frame."""
    px = stripes(spark, d)
    return region_colours(drivers.segment_videos(px, drift(spark, d), SHARP), px)


@register(f"WITH {PX} SELECT t, true AS kept, true AS known FROM px WHERE t > 0 GROUP BY t")
def stable_ids(spark, d):
    """By frame: at least nine tenths of the pixels keep their label along the motion, and at least as many labels are old."""
    out = loops.cut(drivers.segment_videos(stripes(spark, d), drift(spark, d), SHARP)).select("t", "y", "x", "spix")
    before = out.select((F.col("t") + 1).alias("t"), "y", (F.col("x") - 2).alias("x"), F.col("spix").alias("was"))
    kept = out.join(before, ["t", "y", "x"]).groupBy("t").agg((F.avg((F.col("was") == F.col("spix")).cast("int")) >= 0.9).alias("kept"))
    ids = out.groupBy("t").agg(F.collect_set("spix").alias("ids"))
    old = ids.select((F.col("t") + 1).alias("t"), F.col("ids").alias("before"))
    known = ids.join(old, "t").select("t", (F.size(F.array_intersect("ids", "before")) >= 0.8 * F.size("ids")).alias("known"))
    return kept.join(known, "t")


@register(f"WITH {PX} SELECT t, count(*) AS n, 0::BIGINT AS n_missing, true AS on_target FROM px GROUP BY t")
def controlled_count(spark, d):
    """Within five hundredths of forty regions, and all pixels have one."""
    out = drivers.controlled_count(unit(pixels(spark, d)), 40, SMALL).groupBy("t")
    return out.agg(F.count("*").alias("n"), F.count_if(F.col("spix") < 0).alias("n_missing"), F.countDistinct("spix").between(38, 42).alias("on_target"))


@register(f"WITH {STRIPE} SELECT t, y, x, CAST(min(x) OVER (PARTITION BY t, band) AS INTEGER) AS first FROM stripe")
def merge_only(spark, d):
    """Squares merge into whole stripes; a region is named by the place of its first pixel."""
    seg = stripes(spark, d).withColumn("spix", F.expr("cast((y div 5) * 12 + ((x + 2 * t) div 10 - (2 * t) div 10) * 2 + ((x + 2 * t) % 10) div 5 AS int)"))
    out = drivers.merge_only(seg, SHARP, 16)
    first = F.min(F.struct("y", "x")).over(Window.partitionBy("t", "spix"))["x"]
    return out.select("t", "y", "x", first.alias("first"))


def _fill_sql(passes: int) -> str:
    """Passes of filling, phase by phase, over the pixels of the hole and its edge."""
    from .pixels import _HOLES

    out = f"WITH {_HOLES}, m AS (SELECT t, spix, avg(x) AS mx, avg(y) AS my FROM hole WHERE spix IS NOT NULL GROUP BY t, spix), f0 AS (SELECT * FROM hole WHERE x BETWEEN 9 AND 21 AND y BETWEEN 6 AND 16)"
    k = 0
    for _ in range(passes):
        for a, b in PHASES:
            out += f""", c{k} AS (SELECT h.t, h.y, h.x, arg_min(o.spix, row(round(pow((h.x - mx) / 50, 2) + pow((h.y - my) / 30, 2), 9), o.spix)) AS filled FROM f{k} h JOIN f{k} o ON o.t = h.t AND abs(o.y - h.y) + abs(o.x - h.x) = 1 JOIN m ON m.t = o.t AND m.spix = o.spix
                WHERE h.spix IS NULL AND h.x % 2 = {a} AND h.y % 2 = {b} GROUP BY h.t, h.y, h.x), f{k + 1} AS MATERIALIZED (SELECT f{k}.t, f{k}.y, f{k}.x, coalesce(spix, filled) AS spix FROM f{k} LEFT JOIN c{k} USING (t, y, x))"""
            k += 1
    return out + f" SELECT hole.t, hole.y, hole.x, CAST(coalesce(hole.spix, f{k}.spix) AS INTEGER) AS spix FROM hole LEFT JOIN f{k} USING (t, y, x)"


@register(_fill_sql(4))
def fill_missing_full(spark, d):
    """The kernel's filling, to the end: in each phase a missing pixel takes the label around it with the nearest centre."""
    return drivers.fill_missing(holes(spark, d)).select("t", "y", "x", "spix")


@register(f"SELECT s.t, s.y, s.x, coalesce(e.label, s.spix) AS spix FROM (WITH {SEG} SELECT t, y, x, spix FROM seg) s LEFT JOIN ({scores.ORACLES['estep_one_phase']}) e ON e.t = s.t AND e.y = s.y AND e.x = s.x")
def estep_kernel(spark, d):
    """One phase of border moves by the kernel that the drivers run."""

    def work(f):
        image, labels = drivers.raster(f, ["c0", "c1", "c2"]), drivers.raster(f, ["spix"])[..., 0].astype(int)
        size = labels.max() + 1
        p = kernel.parameters(image, labels, np.full(size, 25.0), np.zeros(size, bool), 5)
        return kernel.update_labels(image, labels, p, 100.0, 10.0, 1, ((0, 0),))

    return drivers._each(segments(spark, d), work).select("t", "y", "x", "spix")


@register(f"SELECT s.t, s.y, s.x, coalesce(e.target, s.spix) AS spix FROM (WITH {SEG} SELECT t, y, x, spix FROM seg) s LEFT JOIN ({scores.ORACLES['merge_accept']}) e ON e.t = s.t AND e.spix = s.spix")
def merge_kernel(spark, d):
    """One round of merges, downwards, by the kernel that the drivers run."""

    def work(f):
        image, labels = drivers.raster(f, ["c0", "c1", "c2"]), drivers.raster(f, ["spix"])[..., 0].astype(int)
        size = labels.max() + 1
        p = kernel.parameters(image, labels, np.full(size, 25.0), np.zeros(size, bool), 5)
        return kernel.merge(image, labels, p, Options(sp_size=5), 1)[0]

    return drivers._each(unit(segments(spark, d)), work).select("t", "y", "x", "spix")


@register(f"""WITH RECURSIVE {PX}, l AS (SELECT t, y, x, CAST(c1 % 9 AS INTEGER) AS spix FROM px), e AS (SELECT a.t, a.y * 50 + a.x AS p, b.y * 50 + b.x AS q FROM l a JOIN l b ON a.t = b.t AND a.spix = b.spix AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
    r(t, p, q) AS (SELECT t, p, q FROM e UNION SELECT r.t, r.p, e.q FROM r JOIN e ON e.t = r.t AND e.p = r.q) SELECT t, CAST(p // 50 AS INTEGER) AS y, CAST(p % 50 AS INTEGER) AS x, CAST(min(q) AS INTEGER) AS spix FROM r GROUP BY t, p""")
def components_8(spark, d):
    seg = pixels(spark, d).select("t", "y", "x", F.expr("cast(c1 % 9 AS int)").alias("spix"))
    return drivers.components_8(seg).select("t", "y", "x", "spix")


@register(f"WITH {SEG} SELECT t, y, x, CAST(y % 5 + x % 5 AS INTEGER) AS steps FROM seg")
def geodesic_bfs(spark, d):
    from ..plans.frame import distances

    def work(f):
        labels = drivers.raster(f, ["spix"])[..., 0].astype(int)
        y, x = np.mgrid[: labels.shape[0], : labels.shape[1]]
        return distances(labels, np.stack([y[(y % 5 == 0) & (x % 5 == 0)], x[(y % 5 == 0) & (x % 5 == 0)]], 1))

    return drivers._each(segments(spark, d), work).select("t", "y", "x", F.col("spix").alias("steps"))


@register(f"WITH {EDGE} SELECT CAST(count(DISTINCT v) AS BIGINT) AS n_vertices, 0::BIGINT AS n_conflicts, 0::BIGINT AS n_uncoloured FROM (SELECT u AS v FROM edge UNION SELECT v FROM edge)")
def graph_coloring(spark, d):
    e = loops.stored(edges(spark, d), "edges")
    c = loops.cut(mesh.coloured(e))
    pairs = e.join(c.select(F.col("v").alias("u"), F.col("colour").alias("a")), "u").join(c.select("v", F.col("colour").alias("b")), "v")
    conflicts = pairs.agg(F.count_if(F.col("a") == F.col("b")).alias("n_conflicts"))
    return c.agg(F.countDistinct("v").alias("n_vertices"), F.count_if(F.col("colour").isNull()).alias("n_uncoloured")).crossJoin(conflicts).select("n_vertices", "n_conflicts", "n_uncoloured")


def _flood_sql(steps: int = 12) -> str:
    """Pieces of a cell by passing on least vertices; the piece of the vertex nearest to the cell's centroid is reached."""
    out = f"WITH {VERTEX}, adj AS (SELECT e.u AS p, e.v AS q FROM edge e JOIN vertex a ON a.v = e.u JOIN vertex b ON b.v = e.v WHERE a.spix = b.spix), both_ways AS (SELECT p, q FROM adj UNION SELECT q, p FROM adj UNION SELECT v, v FROM vertex), l0 AS (SELECT v AS id, v AS piece FROM vertex)"
    for k in range(steps):
        out += f", l{k + 1} AS MATERIALIZED (SELECT w.p AS id, min(x.piece) AS piece FROM both_ways w JOIN l{k} x ON x.id = w.q GROUP BY w.p)"
    return out + f""", c AS (SELECT spix, avg(px) AS x, avg(py) AS y, avg(pz) AS z FROM vertex GROUP BY spix), s AS (SELECT vertex.spix, arg_min(v, row(round(pow(px - x, 2) + pow(py - y, 2) + pow(pz - z, 2), 9), v)) AS v FROM vertex JOIN c ON c.spix = vertex.spix GROUP BY vertex.spix),
        r AS (SELECT piece, CAST(row_number() OVER (ORDER BY piece) - 1 AS INTEGER) AS k FROM (SELECT DISTINCT piece FROM l{steps}))
        SELECT l.id AS v, r.k AS spix, l.piece = m.piece AS reached FROM l{steps} l JOIN r ON r.piece = l.piece JOIN vertex ON vertex.v = l.id JOIN s ON s.spix = vertex.spix JOIN l{steps} m ON m.id = s.v"""


@register(_flood_sql())
def flood_fill(spark, d):
    e, v = stored_graph(spark, d)
    return mesh.flood_filled(e, v.select("v", F.col("spix").alias("cell")), v)


def _component_sql(steps: int = 10) -> str:
    """Least labels passed on so many times, more than the graph is wide."""
    out = f"WITH {EDGE}, adj AS (SELECT u AS p, v AS q FROM edge UNION SELECT v, u FROM edge), l0 AS (SELECT DISTINCT p AS id, p AS component FROM adj)"
    for k in range(steps):
        out += f", l{k + 1} AS (SELECT a.p AS id, least(min(x.component), min(y.component)) AS component FROM adj a JOIN l{k} x ON x.id = a.p JOIN l{k} y ON y.id = a.q GROUP BY a.p)"
    return out + f" SELECT id, component FROM l{steps}"


@register(_component_sql())
def graph_components(spark, d):
    return loops.components(edges(spark, d))


@register("WITH p AS (SELECT p_partkey - (SELECT min(p_partkey) FROM part) AS k FROM part) SELECT CAST(k // 6 * 7 AS INTEGER) AS v, CAST(list(CAST(k AS INTEGER) ORDER BY k) AS INTEGER[]) AS ring FROM p GROUP BY k // 6 HAVING count(*) = 6")
def dual_mesh(spark, d):
    """The faces around the middles of fans of six, in their order; a ring begins at its least face and goes to the lesser side."""
    part = table(spark, d, "part")
    k = part.crossJoin(F.broadcast(part.agg(F.min("p_partkey").alias("least")))).select((F.col("p_partkey") - F.col("least")).alias("k"))
    f = k.selectExpr("cast(k AS int) AS f", "cast(k div 6 AS int) * 7 AS a", "cast(k div 6 * 7 + 1 + k % 6 AS int) AS b", "cast(k div 6 * 7 + 1 + (k + 1) % 6 AS int) AS c")
    return mesh.vertex_rings(f.repartition(7, F.hash("f"))).withColumn("ring", mesh.ring_from_least(F.col("ring")))


@register(f"WITH {PX} SELECT CAST(t * 1500 + y * 50 + x AS INTEGER) AS v, CAST(2 * t + CASE WHEN x >= 25 THEN 1 ELSE 0 END AS INTEGER) AS spix FROM px")
def segment_mesh(spark, d):
    """The grid of all pixels in two colours, whose regions begin one column off: the borders move to where the colours
    change."""
    px = pixels(spark, d).withColumn("p", F.expr("cast(t * 1500 + y * 50 + x AS int)"))
    v = px.selectExpr("p AS v", "cast(x + 60 * t AS double) AS px", "cast(y AS double) AS py", "0D AS pz", "IF(x < 25, 0D, 100D) AS f0", "0D AS f1", "0D AS f2", "2 * t + IF(x < 26, 0, 1) AS spix")
    e = px.where("x < 49").selectExpr("p AS u", "p + 1 AS v").union(px.where("y < 29").selectExpr("p AS u", "p + 50 AS v"))
    return mesh.segment_mesh(e, v)


@register("""SELECT 'id_' || place AS id, place, potts, sigma_app, sp_size FROM (SELECT CAST(p.i * 1 + s.i * 3 * 2 + z.i * 3 AS INTEGER) AS place, potts, sigma_app, sp_size
    FROM (VALUES (0, 1.0::DOUBLE), (1, 10.0), (2, 20.0)) p(i, potts), (VALUES (0, 0.0045::DOUBLE), (1, 0.009)) s(i, sigma_app), (VALUES (0, 10), (1, 25)) z(i, sp_size))""")
def experiment_grid(spark, d):
    return experiments.grid(spark, {"potts": [1.0, 10.0, 20.0], "sigma_app": [0.0045, 0.009], "sp_size": [10, 25]})


@register("SELECT 'id_' || CAST(g * 2 + p AS VARCHAR) AS id, CAST(g * 2 + p AS INTEGER) AS place, CASE g WHEN 0 THEN 'raft' ELSE 'spynet' END AS flow, CAST(CASE g WHEN 0 THEN 1 ELSE 2 END AS INTEGER) AS rep, CASE p WHEN 0 THEN 1.0::DOUBLE ELSE 5.0 END AS potts FROM range(2) a(g), range(2) b(p)")
def grid_groups(spark, d):
    return experiments.grid(spark, {"potts": [1.0, 5.0]}, {"flow": ["raft", "spynet"], "rep": [1, 2]})


@register("SELECT 'id_' || i AS id, CAST(i AS INTEGER) AS place, v AS gamma, 25 AS sp_size, 10.0::DOUBLE AS potts FROM (VALUES (0, 0.0::DOUBLE), (1, 4.0), (2, 8.0)) t(i, v)")
def grid_defaults(spark, d):
    return experiments.with_defaults(experiments.grid(spark, {"gamma": [0.0, 4.0, 8.0]})).select("id", "place", "gamma", "sp_size", "potts")


@register("SELECT id, flow, CASE flow WHEN 'raft' THEN 32 ELSE 8 END AS steps FROM (VALUES ('id_0', 'raft'), ('id_1', 'spynet'), ('id_2', 'default')) t(id, flow)")
def grid_picked(spark, d):
    menu = spark.createDataFrame([("raft", 32), ("_def_", 8)], "flow string, steps int")
    return experiments.with_menu(experiments.grid(spark, {"flow": ["raft", "spynet", "default"]}).select("id", "flow"), menu, "flow")


@register("SELECT 'video' AS suite, 1::BIGINT AS n UNION ALL SELECT * FROM (VALUES ('image', 1), ('split', 22), ('rsplit', 6), ('relabel', 12), ('overlap', 2), ('bshape', 9), ('cboundary', 4), ('flow', 3)) t(suite, n)")
def experiment_suites(spark, d):
    parts = [experiments.suite(spark, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("suite"), "n") for n in experiments.SUITES]
    return reduce(lambda a, b: a.union(b), parts)


@register("SELECT a.f AS f1, b.f AS f2 FROM (VALUES ('alpha'), ('gamma'), ('potts')) a(f), (VALUES ('alpha'), ('gamma'), ('potts')) b(f) WHERE a.f < b.f")
def field_pairs(spark, d):
    return experiments.field_pairs(spark.createDataFrame([("alpha",), ("gamma",), ("potts",)], "f string"))


@register("SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS price, round(stddev_samp(o_totalprice) / sqrt(count(*)), 4) AS price_stderr FROM orders WHERE o_orderpriority NOT LIKE '1%' GROUP BY ALL")
def results_report(spark, d):
    r = spark.read.parquet(f"{d}/orders.parquet").where("o_orderpriority NOT LIKE '1%'").withColumnRenamed("o_totalprice", "price")
    return experiments.report(r, ["o_orderpriority", "o_orderstatus"], ["price"]).withColumns({"price": F.round("price", 4), "price_stderr": F.round("price_stderr", 4)})


@register(f"WITH {PX} SELECT t, count(*) AS n, 0::BIGINT AS n_other, 0::BIGINT AS n_late FROM px GROUP BY t")
def stream_frames(spark, d):
    """Frames through the stateful stream, file by file: the same labels as the batch driver gives."""
    from ..streaming import frames

    px, fl = unit(pixels(spark, d)), flows(spark, d)
    base = loops.fresh_folder(spark, "stream")
    packed = frames.packed(px, fl)
    frames.write_backlog(packed, f"{base}/in")
    source = spark.readStream.schema(packed.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    query = frames.labelled(source, SMALL).writeStream.format("parquet").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start(f"{base}/out")
    query.awaitTermination()
    done = spark.read.schema("video string, t int, late boolean, height int, width int, labels binary").parquet(f"{base}/out")
    late = done.groupBy("t").agg(F.count_if("late").alias("n_late"))
    batch = drivers.segment_videos(px, fl, SMALL)
    # labels take few bytes in files and as frames, by which the planner would send all pixels through the driver
    both = frames.unpacked(done).select("t", "y", "x", F.col("spix").alias("a")).hint("merge").join(batch.select("t", "y", "x", "spix"), ["t", "y", "x"])
    return both.groupBy("t").agg(F.count("*").alias("n"), F.count_if(F.col("a") != F.col("spix")).alias("n_other")).join(late, "t")


@register(f"""WITH p AS ({ORACLES['components_8']}), l AS (WITH {PX} SELECT t, y, x, CAST(c1 % 9 AS INTEGER) AS label FROM px), j AS (SELECT l.t, l.y, l.x, label, spix AS piece FROM l JOIN p ON p.t = l.t AND p.y = l.y AND p.x = l.x),
    n AS (SELECT t, label, piece, count(*) AS n FROM j GROUP BY ALL), b AS (SELECT t, label, arg_max(piece, row(n, -piece)) AS best FROM n GROUP BY t, label) SELECT j.t, y, x, CASE WHEN piece = best THEN j.label ELSE -1 END AS spix FROM j JOIN b ON b.t = j.t AND b.label = j.label""")
def largest_pieces(spark, d):
    """Only the largest piece of each label stays, the first one of equals."""
    seg = pixels(spark, d).select("t", "y", "x", F.expr("cast(c1 % 9 AS int)").alias("spix"))
    return drivers.largest_pieces(seg).select("t", "y", "x", "spix")


@register(f"WITH {PX} SELECT t, step, n_steps, CAST(sum(n_steps) AS BIGINT) AS n FROM px, (VALUES ('split', 2), ('merge', 2), ('bndy', 8)) v(step, n_steps) GROUP BY ALL")
def trace_frames(spark, d):
    """Every step of eight rounds is logged for every pixel: splits and merges every fourth round, border moves in all."""
    trace = drivers.trace_frames(unit(pixels(spark, d)), SMALL)
    return trace.groupBy("t", "step").agg(F.countDistinct("seq").cast("int").alias("n_steps"), F.count("*").alias("n"))


@register("SELECT 'id_' || CAST(p + 2 * s AS VARCHAR) AS id FROM range(2) a(p), range(2) b(s) WHERE p = 1 AND s = 0 OR p = 0 AND s = 1")
def grid_only(spark, d):
    """The experiments that hold one of two pairs of values."""
    full = experiments.grid(spark, {"sp_size": [10, 25], "potts": [1.0, 10.0]})
    return experiments.only(full, [("potts", 10.0, "sp_size", 10), ("potts", 1.0, "sp_size", 25)]).select("id")


@register(f"""WITH {BAND} SELECT 'g' AS "group", e.id, CAST(r.rep AS INTEGER) AS rep, count(*) AS n, CAST(0 AS INTEGER) AS n_again, 1.0::DOUBLE AS ev FROM band, (VALUES ('id_0'), ('id_1')) e(id), (VALUES (0), (1)) r(rep) GROUP BY e.id, r.rep""")
def experiment_runs(spark, d):
    """Two experiments in two repetitions over all frames: labels of all pixels, regions that explain all colours, and nothing
    run twice."""
    from ..plans import runner

    base, px = loops.fresh_folder(spark, "runs"), bands(spark, d)
    grid = experiments.grid(spark, {"sp_size": [7, 8]}).withColumns({"group": F.lit("g"), "niters": F.lit(16), "sigma_app": F.lit(0.02), "video_mode": F.lit(False)})
    runner.run(grid, px, None, base, 2)
    again = runner.run(grid, px, None, base, 2)
    truth = px.withColumn("gt", F.expr("cast(x div 10 AS int)"))
    scores = runner.evaluate(spark, base, truth, 1500).select("group", "id", "rep", F.round("ev", 6).alias("ev"))
    n = spark.read.parquet(f"{base}/labels").groupBy("group", "id", "rep").agg(F.count("*").alias("n"))
    return n.join(scores, ["group", "id", "rep"]).withColumn("n_again", F.lit(again))
