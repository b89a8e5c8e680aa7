"""Tiles against the kernels on whole frames, priors from frame to frame, and what runs and streams heed."""

import numpy as np
import pandas as pd
import pytest

from tesserae.operators import regions
from tesserae.plans import drivers, experiments, loops, runner, tiles
from tesserae.plans import frame as k
from tesserae.plans.frame import Options
from tesserae.plans.tiles import Grid

H, W = 26, 38
GRID = Grid(H, W, 12)


def table(spark, image, labels=None, t=0, **more):
    y, x = np.mgrid[:H, :W]
    data = {"t": np.full(H * W, t, np.int32), "y": y.ravel().astype(np.int32), "x": x.ravel().astype(np.int32), **{f"c{i}": image[..., i].ravel() for i in range(3)}}
    if labels is not None:
        data["spix"] = labels.ravel().astype(np.int32)
    data |= {name: a.ravel() for name, a in more.items()}
    return spark.createDataFrame(pd.DataFrame(data))


def picture(seed, levels=8):
    rng = np.random.default_rng(seed)
    image = rng.integers(0, levels, (H, W, 3)) / 64
    image[:, W // 2 :] += 0.5
    return image


def array(df):
    rows = df.select("y", "x", "spix").collect()
    out = np.full((H, W), -9)
    for r in rows:
        out[r["y"], r["x"]] = r["spix"]
    return out


def cut_of(spark, image, labels, halo):
    return loops.stored(tiles.widened(tiles.tiled(table(spark, image, labels), GRID, {"labels": ["spix"], "image": ["c0", "c1", "c2"]}), GRID, halo))


def params_table(cut, halo, weight, propagated=False):
    from pyspark.sql import functions as F

    stats = tiles.sums_by_region(cut, GRID, halo)
    shapes = [F.lit(v).alias(f"{m}{c}") for m in "kv" for c, v in (("xx", 1.0), ("xy", 0.0), ("yy", 1.0))]
    priors = stats.select("video", "t", "spix", F.lit(weight).alias("prior_count"), *shapes, F.lit(propagated).alias("propagated"))
    return loops.stored(regions.conditioned_parameters(stats, priors, 6, False))


def test_border_moves_over_all_phases(spark):
    image, labels = picture(1), k.hex_labels(H, W, 6)
    size = labels.max() + 1
    cut = cut_of(spark, image, labels, 16)
    out = array(tiles.unpacked(tiles.moved_borders(cut, GRID, params_table(cut, 16, 36.0), 16, 0.05, 2.0), GRID))
    p = k.parameters(image, labels, np.full(size, 36.0), np.zeros(size, bool), 6)
    want = k.update_labels(image, labels, p, 0.05, 2.0, 4)
    assert (want != labels).sum() > 50 and (out == want).all()
    with pytest.raises(ValueError):
        tiles.moved_borders(cut, GRID, params_table(cut, 16, 36.0), 16, 0.05, 2.0, 5)


def test_whole_rounds(spark):
    image = picture(2)
    o = Options(sp_size=6, niters=3, sigma_app=0.3)
    assert (array(tiles.segment_tiled(table(spark, image), GRID, o)) == k.segment_image(image.astype("<f4").astype(float), o)[0]).all()


def test_pieces_and_holes_over_tiles(spark):
    rng = np.random.default_rng(3)
    labels = np.where(rng.random((H, W)) < 0.3, -1, (rng.random((H, W)) < 0.5).astype(int))
    labels[5:22, 6:33] = np.where(labels[5:22, 6:33] == 0, 2, labels[5:22, 6:33])
    seg = table(spark, picture(3), labels)
    assert (array(tiles.components_8(seg, GRID)) == k.pieces(labels)).all()
    cut = loops.stored(tiles.tiled(seg, GRID, {"labels": ["spix"]}))
    assert (array(tiles.unpacked(tiles.largest_pieces(cut, GRID), GRID)) == k.largest_pieces(labels)).all()
    holes = k.hex_labels(H, W, 6)
    holes[3:24, 4:35] = -1
    seg = table(spark, picture(3), holes)
    assert (array(tiles.fill_missing(seg, GRID)) == array(drivers.fill_missing(seg))).all()


@pytest.mark.parametrize("propagated", [False, True])
@pytest.mark.parametrize("direction", [1, 2])
def test_splits(spark, direction, propagated):
    image, labels = picture(4, 40), k.hex_labels(H, W, 11)
    size = labels.max() + 1
    invalid = np.random.default_rng(5).random((H, W)) < 0.3 if propagated else None
    o = Options(sp_size=6, sigma_app=0.3, split_alpha=3.0, gamma=1.0)
    cut = cut_of(spark, image, labels, 0)
    lost = loops.stored(tiles.tiled(table(spark, image, labels, lost=invalid.astype(int)), GRID, {"invalid": ["lost"]})) if propagated else None
    out, made = tiles.split(cut, GRID, 0, params_table(cut, 0, 121.0, propagated), o, direction, lost)
    p = k.parameters(image, labels, np.full(size, 121.0), np.zeros(size, bool), 6)
    p.propagated = np.full(size, propagated)
    want, q = k.split(image, labels, p, o, direction - 1, invalid)
    assert 0 < want.max() + 1 - size and (array(tiles.unpacked(out, GRID)) == want).all()
    for r in made.collect():
        assert r["half"] == q.prior_count[r["name"]] and r["prior_count"] == q.prior_count[r["spix"]]


@pytest.mark.parametrize(("nc", "icov"), [(True, True), (True, False), (False, True), (False, False)])
def test_carried_priors_of_kernel_and_table(spark, nc, icov):
    y, x = np.mgrid[:H, :W]
    labels, later, image = (x + y) // 11, (x + y + 2) // 11, picture(6)
    size = labels.max() + 1
    p = k.parameters(image, labels, np.full(size, 50.0), np.zeros(size, bool), 6)
    state = k.state_of(labels, p)
    n = max(size, later.max() + 1)
    weight, sample, prior = k.carried_priors(state, later, n, Options(prop_nc=nc))
    q = k.parameters(image, later, weight, np.arange(n) < size, 6, sample, prior, icov)
    from pyspark.sql import functions as F

    first, second = regions.moments(table(spark, image, labels)), regions.moments(table(spark, image, later, 1))
    kept = regions.kept_shapes(first, regions.parameters(first, F.lit(50.0), 6), F.lit(50.0))
    priors = regions.carried_priors(kept, second.select("t", "spix", "n"), nc)
    rows = {r["spix"]: r for r in regions.conditioned_parameters(second, priors, 6, icov).collect()}
    for i in np.unique(later).tolist():
        assert rows[i]["prior_count"] == weight[i]
        assert np.allclose([rows[i]["ixx"], rows[i]["ixy"], rows[i]["iyy"], rows[i]["logdet"]], [*q.inverse[i], q.logdet[i]])


def test_priors_change_later_frames():
    rng = np.random.default_rng(7)
    image = k.hex_labels(H, W, 9)[..., None] % 5 / 5 + rng.normal(0, 0.05, (H, W, 3))
    flow = np.zeros((H, W, 2))
    flow[..., 0] = 2
    found = {}
    for nc in (True, False):
        for icov in (True, False):
            o = Options(sp_size=7, niters=6, sigma_app=0.3, prop_nc=nc, prop_icov=icov)
            state = k.first_frame(image, o)
            for t in range(1, 4):
                state = k.next_frame(np.roll(image, 2 * t, 1), flow, state, o)
            found[nc, icov] = state.labels.tobytes()
    assert found[True, True] != found[True, False] and len(set(found.values())) >= 3


def test_revival_equals_brute_force():
    rng = np.random.default_rng(8)
    labels = k.hex_labels(H, W, 4)
    size = labels.max() + 1
    image = rng.integers(0, 3, size)[labels][..., None] * np.ones(3) / 40
    p = k.parameters(image, labels, np.full(size, 9.0), np.zeros(size, bool), 4)
    known = size + 40
    n = np.where(np.arange(known) < size, 0.0, 9.0)
    mu, centre = np.zeros((known, 3)), np.zeros((known, 2))
    twins = rng.integers(0, size, 40)
    mu[size:], centre[size:] = p.mu[twins] + rng.normal(0, 0.004, (40, 3)), p.centre[twins] + rng.normal(0, 0.3, (40, 2))
    grown = k.Params(*(np.concatenate([getattr(p, c), np.zeros((40, *getattr(p, c).shape[1:]), getattr(p, c).dtype)]) for c in ("n", "mu", "centre", "inverse", "logdet", "prior_count", "propagated", "sample", "prior")))
    o = Options(epsilon_reid=1e-3)
    out, _ = k.revive(labels, grown, k.State(labels, n, mu, centre), o)
    wants = []
    for i in np.unique(labels):
        d = ((p.mu[i] - mu[size:]) ** 2).sum(1) + 10 * (((p.centre[i] - centre[size:]) / (W, H)) ** 2).sum(1)
        if d.min() < o.epsilon_reid:
            wants.append((d.min(), i, size + int(d.argmin())))
    to, taken = np.arange(size), set()
    for _, i, j in sorted(wants):
        if j not in taken:
            taken.add(j)
            to[i] = j
    assert len(taken) > 5 and (out == to[labels]).all()


def test_near_pairs_are_complete():
    rng = np.random.default_rng(9)
    a, b = rng.random((200, 3)), rng.random((150, 3))
    for radius in (0.05, 0.3, 2.0, 1e-9):
        i, j = k.near_pairs(a, b, radius)
        found = set(zip(i.tolist(), j.tolist(), strict=True))
        assert len(found) == len(i)
        d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
        assert {(x, y) for x, y in zip(*np.nonzero(d < radius), strict=True)} <= found


def test_options_reach_the_engine(spark):
    base = {"id": "id_0", "group": "g", "rep": 0, "sp_size": 9}
    assert runner.options_of({**base, "overlap": 0, "prop_nc": 0, "niters": -1, "rgb2lab": True}) == Options(sp_size=9, smaller_wins=False, prop_nc=False)
    with pytest.raises(ValueError, match="sigma_ap"):
        runner.options_of({**base, "sigma_ap": 0.1})
    for name, n in (("cboundary", 4), ("overlap", 2), ("relabel", 12)):
        assert len({runner.options_of(r.asDict()) for r in experiments.suite(spark, name).collect()}) == n


def test_runs_of_named_flows_and_few_frames(spark):
    px = table(spark, picture(10)).union(table(spark, picture(11), t=1))
    base = loops.fresh_folder(spark, "runs")
    rows = spark.createDataFrame([("a", "raft", 1), ("b", "none", 0)], "id string, flow string, nimgs int")
    motion = {n: px.selectExpr("t", "y", "x", "1D AS fx", "0D AS fy") for n in ("raft", "none")}
    with pytest.raises(ValueError):
        runner.run(rows, px, None, base)
    assert runner.run(rows.selectExpr("*", "9 AS sp_size", "3 AS niters"), px, motion, base) == 2
    seen = {r["id"]: r["n"] for r in spark.read.parquet(f"{base}/labels").groupBy("id").agg({"t": "count"}).withColumnRenamed("count(t)", "n").collect()}
    assert seen == {"a": H * W, "b": 2 * H * W}


def test_traces_hold_all_steps_and_proposals(spark):
    px = table(spark, picture(12)).union(table(spark, picture(13), t=1)).union(table(spark, picture(14), t=2))
    o = Options(sp_size=7, niters=4, sigma_app=0.3, vid_niters=4)
    trace = drivers.trace_videos(px, None, o).cache()
    steps = {t: [r["step"] for r in trace.where(f"t = {t}").orderBy("seq").select("step").collect()] for t in (0, 1)}
    assert steps[0] == ["split", "bndy", "bndy", "merge", "bndy", "bndy", "final"]
    assert steps[1] == ["shifted", "filled", "filled", "bndy", "split", "bndy", "bndy", "relabel", "merge", "bndy", "final"]
    final = drivers.traced_labels(trace.where("step = 'final'")).select("t", "y", "x", "spix")
    assert final.exceptAll(drivers.segment_videos(px, None, o).select("t", "y", "x", "spix")).isEmpty()
    merges = drivers.traced_merges(trace)
    assert merges.where("accepted AND h <= -2").isEmpty() and not merges.where("NOT accepted").isEmpty()


def test_labels_of_a_run_are_not_broadcast(spark, tmp_path, monkeypatch):
    """Labels of whole regions take few bytes on disk, however many pixels there are."""
    from pyspark.sql import functions as F

    base = f"file://{tmp_path}/runs"
    truth = table(spark, picture(3), np.zeros((H, W))).withColumnRenamed("spix", "gt")
    seg = truth.select("t", "y", "x", F.lit("").alias("video"), F.expr("cast(x div 19 AS int)").alias("spix"))
    runner.write_results(seg.withColumns({"group": F.lit("g"), "id": F.lit("id_0"), "rep": F.lit(0)}), f"{base}/labels")
    plans = []
    kept = runner.write_results
    monkeypatch.setattr(runner, "write_results", lambda df, *a: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df, *a))
    assert runner.evaluate(spark, base, truth, H * W).count() == 1
    joins = [line for line in plans[0].splitlines() if "Join" in line and "y#" in line and "x#" in line]
    assert joins and not any("Broadcast" in line for line in joins)


def test_small_tiles_share_tasks_and_batches(spark):
    """Many small tiles in few batches of several tasks, and a tile whose rows lie in two batches."""
    from pyspark.sql import functions as F

    rows = spark.range(3000).selectExpr("'' AS video", "cast(id % 50 AS int) AS t", "0 AS ty", "0 AS tx", "cast(id AS int) AS k")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        out = tiles.by_tile(rows, lambda key, f: tiles._row(key, n=len(f), total=int(f["k"].sum())), "video string, t int, ty int, tx int, n int, total int")
        found = out.withColumn("task", F.spark_partition_id()).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(found["t"]) == list(range(50)) and (found["n"] == 60).all()
    assert (found["total"] == 60 * found["t"] + 50 * sum(range(60))).all() and found["task"].nunique() > 4
