"""Graph and mesh plans whose work has to grow no faster than their tables."""

import random

import pytest
from pyspark.sql import functions as F

from tesserae.operators import graph
from tesserae.plans import mesh


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rings_are_not_a_group_of_python_each(spark):
    """A closed fan of four, an open fan of two, two closed fans around one vertex, an edge of three faces."""
    closed = [(0, 1, 2), (0, 2, 3), (0, 3, 4), (0, 4, 1)]
    open_fan = [(10, 11, 12), (10, 12, 13)]
    twice = [(20, 21, 22), (20, 22, 23), (20, 23, 21), (20, 24, 25), (20, 25, 26), (20, 26, 24)]
    crowded = [(30, 31, 32), (30, 31, 33), (30, 31, 34)]
    faces = spark.createDataFrame([(f, *corners) for f, corners in enumerate(closed + open_fan + twice + crowded)], "f int, a int, b int, c int")
    out = mesh.vertex_rings(faces.repartition(3, "f"))
    assert "FlatMapGroupsInPandas" not in plan(out)
    assert {r.v: r.ring for r in out.withColumn("ring", mesh.ring_from_least(F.col("ring"))).collect()} == {0: [0, 1, 2, 3]}


def random_graph(spark, seed, n, m, labels):
    rng = random.Random(seed)
    pairs = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)})
    edges = spark.createDataFrame(pairs, "u int, v int")
    return pairs, edges, spark.createDataFrame([(v, rng.randrange(labels)) for v in range(n)], "v int, spix int")


@pytest.mark.parametrize("seed, n, m, labels", [(1, 12, 20, 1), (2, 30, 150, 2), (3, 60, 110, 2), (4, 25, 200, 1)])
def test_removable_is_what_all_pairs_say(spark, seed, n, m, labels):
    pairs, edges, vertices = random_graph(spark, seed, n, m, labels)
    label = {r.v: r.spix for r in vertices.collect()}
    near = {v: {b if a == v else a for a, b in pairs if v in (a, b) and label[a] == label[b]} for v in label}
    simple = {v: all(q in near[p] or (near[p] & near[q]) - {v} for p in near[v] for q in near[v] if p < q) for v in near}
    assert {r.v: r.is_simple for r in graph.removable(edges.union(edges.limit(5)), vertices).collect()} == simple


def test_a_hub_of_leaves_makes_no_pairs(spark):
    """20,000 leaves are 200 million pairs, of which one is enough."""
    edges = spark.range(1, 20001).selectExpr("0 AS u", "cast(id AS int) AS v")
    out = graph.removable(edges, spark.range(20001).selectExpr("cast(id AS int) AS v", "0 AS spix"))
    assert [r.v for r in out.where("NOT is_simple").collect()] == [0]


def test_ring_walks_don_t_repeat_their_steps(spark):
    """Rings of 5, 30 and 60 vertices, of which each has a neighbour of another label; walks take 32 steps at most."""
    rings, start = [], 0
    for n in (5, 30, 60):
        rings.append(range(start, start + n))
        start += n
    pairs = [tuple(sorted((r[i], r[(i + 1) % len(r)]))) for r in rings for i in range(len(r))] + [(v, start) for v in range(start)]
    out = mesh.ring_walks(spark.createDataFrame(pairs, "u int, v int"), spark.createDataFrame([(v, int(v == start)) for v in range(start + 1)], "v int, spix int"))
    assert {r.v: r.is_simple for r in out.collect()} == {v: v < 35 for v in range(start + 1)}
    assert plan(out).split("== Initial Plan ==")[0].count("Join") <= 4


def test_flood_fill_reads_its_tables_once(spark):
    """Two cells, one in two pieces; the last vertex has no place."""
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (4, 5)], "u int, v int")
    cells = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1), (4, 0), (5, 0), (6, 1)], "v int, cell int")
    points = spark.range(6).selectExpr("cast(id AS int) AS v", "cast(id AS double) AS px", "0D AS py", "0D AS pz")
    out = mesh.flood_filled(edges, cells, points)
    assert "Range (" not in plan(out)
    assert sorted(map(tuple, out.collect())) == [(0, 0, True), (1, 0, True), (2, 1, True), (3, 1, True), (4, 2, False), (5, 2, False), (6, 3, False)]


@pytest.mark.parametrize("n, files", [(10, 3), (100, 25), (1030, 25)])
def test_a_longer_backlog_has_no_more_micro_batches(spark, tmp_path, n, files):
    from tesserae.streaming import frames

    rows = spark.range(n, 0, -1).selectExpr("'' AS video", "cast(id AS int) AS t", "1 AS height", "1 AS width", "cast('a' AS binary) AS image", "cast('b' AS binary) AS flow")
    frames.write_backlog(rows, f"{tmp_path}/in")
    spans = spark.read.parquet(f"{tmp_path}/in").groupBy(F.input_file_name().alias("file")).agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count("*").alias("n")).orderBy("file").collect()
    assert len(spans) == files and sum(r.n for r in spans) == n
    assert all(x.b < y.a for x, y in zip(spans, spans[1:], strict=False))


def test_colours_are_those_taken_in_the_order_of_priority(spark):
    from tesserae.functions.algebra import hash_unit

    pairs, edges, vertices = random_graph(spark, 5, 40, 160, 1)
    near = {v: {b if a == v else a for a, b in pairs if v in (a, b)} for v in range(40)}
    priority = {r.v: (len(near[r.v]), r.h, r.v) for r in vertices.select("v", hash_unit(F.lit(123), F.col("v")).alias("h")).collect()}
    colours = {}
    for v in sorted((v for v in near if near[v]), key=priority.get, reverse=True):
        colours[v] = min(set(range(41)) - {colours.get(w) for w in near[v]})
    out = mesh.coloured(edges.union(edges.selectExpr("v AS u", "u AS v").limit(9)))
    assert {r.v: r.colour for r in out.collect()} == colours


def test_labels_are_updated_beside_borders_only(spark, monkeypatch):
    """A strip of 4 x 60 in two colours whose regions begin far from where the colours change: the border moves there, as it
    does by updates of all vertices, and no update sees all edges."""
    v = spark.range(240).selectExpr("cast(id AS int) AS v", "cast(id % 60 AS double) AS px", "cast(id div 60 AS double) AS py", "0D AS pz", "IF(id % 60 < 30, 0D, 100D) AS f0", "0D AS f1", "0D AS f2", "IF(id % 60 < 34, 0, 1) AS spix").cache()
    edges = v.where("px < 59").selectExpr("v AS u", "v + 1 AS v").union(v.where("py < 3").selectExpr("v AS u", "v + 60 AS v")).cache()
    seen, update = [], mesh.update3d
    monkeypatch.setattr(mesh, "update3d", lambda e, *more: seen.append(e.count()) or update(e, *more))
    got = {r.v: r.spix for r in mesh.segment_mesh(edges, v, rounds=1, passes=2).collect()}
    assert max(seen) < edges.count() / 2
    colours = mesh.coloured(edges).cache()
    now, p = v.join(colours, "v").cache(), mesh.params3d(mesh.moments3d(v), 25).cache()
    for _ in range(2):
        for colour in range(colours.agg(F.max("colour")).first()[0] + 1):
            new = update(edges, now, p, 50.0, 0.5, F.col("colour") == colour).select("v", F.col("spix").alias("new"))
            now = mesh.stored(now.join(new, "v", "left").withColumn("spix", F.coalesce("new", "spix")).drop("new"))
    assert got == {r.v: r.spix for r in now.collect()} and got != {r.v: r.spix for r in v.collect()}


def pixel_joins(df):
    """The planner's joins by pixel."""
    return [line for line in plan(df).splitlines() if "Join" in line and "y#" in line and "x#" in line]


def test_motion_of_pixels_is_not_broadcast(spark, tmp_path):
    """A row a pixel in files of few bytes."""
    from tesserae.plans import drivers

    spark.range(3000).selectExpr("cast(id div 600 AS int) AS t", "cast(id % 600 div 30 AS int) AS y", "cast(id % 30 AS int) AS x", "1D AS c0", "2D AS c1", "3D AS c2", "-2D AS fx", "0D AS fy").write.parquet(f"{tmp_path}/px")
    px = spark.read.parquet(f"{tmp_path}/px")
    out = drivers.packed(px.drop("fx", "fy"), px.where("x < 29").select("t", "y", "x", "fx", "fy"))
    joins = pixel_joins(out)
    assert joins and not any("Broadcast" in line for line in joins)
    import numpy as np

    for r in out.collect():
        image, flow = drivers.image_of(r)
        assert (image == (1, 2, 3)).all() and (flow[:, :29, 0] == (-2 if r.t else 0)).all() and not flow[:, 29].any() and not np.any(flow[..., 1])


def test_labels_of_a_stream_are_not_broadcast(spark):
    from tesserae.catalogue import QUERIES

    joins = pixel_joins(QUERIES["stream_frames"](spark, "/root/testdata/sf0.001"))
    assert len(joins) >= 2 and not any("Broadcast" in line for line in joins)


def test_regions_of_tiles_are_not_broadcast(spark, monkeypatch):
    """A split and a merge; no step sends a table by region or by frame through the driver."""
    from tesserae.catalogue.plans import region_colours
    from tesserae.catalogue.tiled import GRID
    from tesserae.plans import loops, tiles
    from tesserae.plans.frame import Options
    from tesserae.sources.testdata import bands

    plans, kept, px = [], loops.stored, bands(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(loops, "stored", lambda df, *a: plans.append(plan(df)) or kept(df, *a))
    out = tiles.segment_tiled(px, GRID, Options(sp_size=7, niters=3, sm_start=-1, sigma_app=0.02))
    last = region_colours(out, px)
    assert len(pixel_joins(last)) == 1 and "Broadcast" not in pixel_joins(last)[0]
    assert sum("SortMergeJoin" in p for p in [*plans, plan(out)]) > 5
    assert not any("BroadcastHashJoin" in p or "BroadcastNestedLoopJoin" in p for p in [*plans, plan(out)])


def test_labels_of_a_stream_begun_again_are_not_broadcast(spark):
    from tesserae.catalogue import QUERIES

    joins = pixel_joins(QUERIES["stream_restarted"](spark, "/root/testdata/sf0.001"))
    assert joins and not any("Broadcast" in line for line in joins)
