"""Frame kernels on small pictures whose result is known."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.operators.stencil import simple_table
from tesserae.plans import frame as k
from tesserae.plans.experiments import speed
from tesserae.plans.frame import Options


def two_colours(h=24, w=32, edge=16):
    image = np.zeros((h, w, 3))
    image[:, edge:] = 1
    return image


def test_border_moves_onto_the_edge():
    image = two_colours()
    labels = (np.arange(32)[None, :] >= 18).astype(int).repeat(24, 0)
    p = k.parameters(image, labels, np.full(2, 9.0), np.zeros(2, bool), 3)
    for _ in range(4):
        labels = k.update_labels(image, labels, p, 0.01, 1.0, 4)
    assert (labels == (np.arange(32)[None, :] >= 16)).mean() > 0.98


def test_checkerboard_splits_and_constant_merges():
    image = two_colours()
    one = np.zeros((24, 32), int)
    p = k.parameters(image, one, np.full(1, 64.0), np.zeros(1, bool), 8)
    split, q = k.split(image, one, p, Options(sigma_app=0.009), 0)
    assert len(np.unique(split)) == 2 and len(q.n) == 2
    flat, halves = np.zeros((24, 32, 3)), (np.arange(32)[None, :] >= 16).astype(int).repeat(24, 0)
    p = k.parameters(flat, halves, np.full(2, 64.0), np.zeros(2, bool), 8)
    assert len(np.unique(k.merge(flat, halves, p, Options(), 0)[0])) == 1
    p = k.parameters(image, halves, np.full(2, 64.0), np.zeros(2, bool), 8)
    assert len(np.unique(k.merge(image, halves, p, Options(), 0)[0])) == 2


def test_ids_move_with_the_picture():
    rng = np.random.default_rng(1)
    image = np.zeros((40, 60, 3))
    image[10:25, 15:40] = 0.9
    image += rng.normal(0, 0.01, image.shape)
    o = Options(sp_size=10, niters=8)
    first = k.first_frame(image, o)
    flow = np.zeros((40, 60, 2))
    flow[..., 0], flow[..., 1] = 2, 1
    second = k.next_frame(np.roll(image, (1, 2), (0, 1)), flow, first, o)
    assert (second.labels[1:, 2:] == first.labels[:-1, :-2]).mean() > 0.85
    assert (second.labels >= 0).all()


@pytest.mark.parametrize(("smaller", "winner"), [(True, 0), (False, 1)])
def test_overlaps_go_by_size(smaller, winner):
    labels = np.full((6, 12), -1)
    labels[2, 1:4], labels[2, 7:12] = 0, 1  # 3 and 5 pixels
    flow = np.zeros((6, 12, 2))
    flow[labels == 0, 0] = 6
    out, _ = k.shift(labels, flow, smaller)
    assert (out[2, 7:10] == winner).all()


def test_only_the_largest_piece_stays():
    labels = np.zeros((7, 7), int)
    labels[0, 0] = labels[1, 1] = 1
    labels[3, 3:6] = labels[4, 4] = 1
    out = k.largest_pieces(labels)
    assert (out[3, 3:6] == 1).all() and out[0, 0] == -1 and out[1, 1] == -1
    filled = k.fill(out, np.array([[3.0, 3.0], [4.0, 3.0]]))
    assert (filled >= 0).all()


def test_dead_ids_are_revived_and_changed_ones_renamed():
    image = np.zeros((10, 20, 3))
    image[:, 10:] = 1
    labels = np.zeros((10, 20), int)
    labels[:, 10:] = 2  # takes the place and colour of dead id 1
    state = k.State(labels, np.array([100.0, 100.0, 0.0]), np.array([[0.0] * 3, [1.0] * 3, [0.0] * 3]), np.array([[4.5, 4.5], [14.5, 4.5], [0.0, 0.0]]))
    p = k.parameters(image, labels, np.full(3, 9.0), np.zeros(3, bool), 3)
    assert set(np.unique(k.revive(labels, p, state, Options())[0])) == {0, 1}
    moved = k.State(labels, np.array([100.0, 0.0, 100.0]), np.array([[0.0] * 3, [0.0] * 3, [0.2] * 3]), state.centre)
    assert 3 in k.revive(labels, p, moved, Options())[0]


def striped(t, h=30, w=50):
    """Upright stripes, ten pixels wide, that move by two pixels to the left a frame and repeat."""
    band = (np.arange(w)[None, :].repeat(h, 0) + 2 * t) // 10
    return np.stack([band % 3 * 0.45, band % 2 * 0.75, np.full((h, w), 0.25)], 2)


def test_regions_that_move_do_not_give_way_to_dead_ids_they_pass():
    """From frame 117 on, stripes pass the places where others of their colour ended."""
    o, flow = Options(sp_size=7, niters=16, sigma_app=0.02), np.zeros((30, 50, 2))
    flow[..., 0] = -2
    state = k.first_frame(striped(0), o)
    for t in range(1, 160):
        before, state = state.labels, k.next_frame(striped(t), flow, state, o)
        now, was = set(np.unique(state.labels).tolist()), set(np.unique(before).tolist())
        assert (state.labels[:, :-2] == before[:, 2:]).mean() >= 0.9 and len(now & was) >= 0.8 * len(now), t


def test_a_step_does_not_grow_with_the_ids_ever_seen(monkeypatch):
    """20,000 dead ids far from all regions, and one whose place and colour a new region has."""
    o, flow = Options(sp_size=7, niters=16, sigma_app=0.02), np.zeros((30, 50, 2))
    flow[..., 0] = -2
    state = k.first_frame(striped(0), o)
    for t in range(1, 6):
        state = k.next_frame(striped(t), flow, state, o)
    n, extra = len(state.n), 20_000
    rng = np.random.default_rng(5)
    more = {"n": np.full(extra, 9.0), "mu": 2 + rng.random((extra, 3)), "centre": 10 * rng.random((extra, 2)), "inverse": k.round_shapes(extra), "sample": k.round_shapes(extra), "prior_count": np.full(extra, 9.0)}
    more["mu"][77], more["centre"][77] = striped(6)[15, 49], [48.5, 14.5]  # the stripe that comes in
    grown = k.State(state.labels, **{c: np.concatenate([getattr(state, c), v]) for c, v in more.items()})
    seen, refit = [], k.refit
    monkeypatch.setattr(k, "refit", lambda image, labels, p, side: seen.append(len(p.n)) or refit(image, labels, p, side))
    few, many = (k.next_frame(striped(6), flow, s, o) for s in (state, grown))
    assert max(seen) < 100
    new = np.unique(few.labels[few.labels >= n])
    assert len(new) == 1 and (many.labels == np.where(few.labels == new[0], n + 77, few.labels)).all()


def test_dead_ids_are_found_by_their_cells():
    rng = np.random.default_rng(6)
    known, labels = 3000, np.zeros((10, 20), int)
    mu, centre = rng.random((known, 3)), rng.random((known, 2)) * [20, 10]
    state = k.State(labels, np.where(np.arange(known) % 7 == 3, 0.0, 5.0), mu, centre)
    dead = k.Dead(state, 0.1)
    at = k.features(mu, centre, labels.shape)
    for died in (np.array([3, 10]), np.arange(17, 3000, 7)):  # they live until then: 600 and more are sorted in
        n = state.n.copy()
        n[died] = 4.0
        state = k.State(labels, n, mu, centre)
        dead = dead.after(state, died)
        want = np.flatnonzero(n > 0)[1:]
        i, j = k.near_pairs(at[[5, 900]], at[want], 0.1)
        d = np.sqrt(((at[[5, 900]][i] - at[want][j]) ** 2).sum(1))
        assert set(want[j[d < 0.1]].tolist()) <= set(dead.near(at[[5, 900]]).tolist()) <= set(want.tolist())


class Shelf:
    """A state variable in memory that counts its calls."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def getValue(self, key):
        self.calls += 1
        return self.held[key]

    def updateValue(self, key, value):
        self.calls += 1
        self.held[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self.held[key]

    def iterator(self):
        return iter(self.held.items())

    def clear(self):
        self.held.clear()

    def exists(self):
        return bool(self.held)

    def get(self):
        return self.held[()]

    def update(self, value):
        self.held[()] = value


@pytest.mark.parametrize("held", [1 << 25, 200_000])
def test_frames_of_a_micro_batch_come_in_order_with_few_calls(monkeypatch, held):
    """Frames come backwards, one twice, then one that is late; with little memory sorted runs wait in the store."""
    import pandas as pd

    from tesserae.streaming import frames

    o, flow, shelves = Options(sp_size=7, niters=16, sigma_app=0.02), np.zeros((30, 50, 2), "<f4"), []
    flow[..., 0] = -2
    monkeypatch.setattr(frames, "_HELD", held)

    class Handle:
        def getMapState(self, *_):
            return shelves.append(Shelf()) or shelves[-1]

        getValueState = getMapState

    processor = frames.Regions(o)
    processor.init(Handle())

    def rows(ts):
        yield pd.DataFrame([("", t, 30, 50, striped(t).astype("<f4").tobytes(), flow.tobytes()) for t in ts], columns=["video", "t", "height", "width", "image", "flow"])

    first = list(processor.handleInputRows(("",), rows([*range(29, -1, -1), 7]), None))
    second = list(processor.handleInputRows(("",), rows([31, 3, 30]), None))
    assert len(first) == len(second) == 1
    assert not shelves[2].held and shelves[2].calls <= (0 if held > 1 << 20 else 30)
    out = pd.concat(first + second)
    assert sorted(out.t[out.late]) == [3, 7] and out.t[~out.late].tolist() == list(range(32))
    state = None
    for t, blob in zip(out.t[~out.late], out.labels[~out.late], strict=True):
        image = striped(t).astype("<f4").astype(float)
        state = k.first_frame(image, o) if state is None else k.next_frame(image, flow.astype(float), state, o)
        assert (np.frombuffer(blob, "<i4").reshape(30, 50) == state.labels).all()


def test_controller_reaches_its_target():
    rng = np.random.default_rng(0)
    image = rng.random((40, 50, 3)) * 0.05 + two_colours(40, 50, 25) * 0.5
    labels, _ = k.segment_image(image, Options(sp_size=8, niters=6, target_nspix=30, most_rounds=300))
    assert 20 <= len(np.unique(labels)) <= 45


def test_table_has_the_known_number_of_simple_codes():
    assert sum(simple_table()) == 48


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 2**32 - 1))
def test_border_moves_keep_regions_in_one_piece(seed):
    rng = np.random.default_rng(seed)
    image = rng.random((20, 24, 3))
    labels = k.hex_labels(20, 24, 6)
    size = labels.max() + 1
    before = len(np.unique(k.pieces(labels)))
    p = k.parameters(image, labels, np.full(size, 36.0), np.zeros(size, bool), 6)
    out = k.update_labels(image, labels, p, 0.1, 1.0, 2)
    assert len(np.unique(k.pieces(out))) <= before and (out >= 0).all()


def test_grid_order():
    assert speed(["a", "b"]) == ["a", "b"]
    assert speed(["a", "b", "c"]) == ["b", "c", "a"]


def test_mesh_rounds_and_passes(spark, monkeypatch):
    """Labels that grow by one in every pass, up to a most."""
    from pyspark.sql import functions as F

    from tesserae.plans import mesh

    calls = []
    start = spark.range(2).selectExpr("cast(id AS int) AS v", "0 AS spix")
    monkeypatch.setattr(mesh, "coloured", lambda edges: start.selectExpr("v", "0 AS colour"))
    monkeypatch.setattr(mesh, "moments3d", lambda vertices: vertices)
    monkeypatch.setattr(mesh, "params3d", lambda moments, side: calls.append("round") or moments)

    def grown(most):
        monkeypatch.setattr(mesh, "update3d", lambda edges, vertices, p, sigma2, potts, colour: calls.append("update") or vertices.select("v", F.least(F.col("spix") + 1, F.lit(most)).alias("spix")))

    grown(99)
    assert {r.spix for r in mesh.segment_mesh(start, start, side=3).collect()} == {12} and calls.count("round") == 3
    calls.clear()
    grown(6)
    assert {r.spix for r in mesh.segment_mesh(start, start).collect()} == {6} and (calls.count("round"), calls.count("update")) == (3, 8)


def test_controlled_count_keeps_the_callers_rounds(monkeypatch):
    from tesserae.plans import drivers

    monkeypatch.setattr(drivers, "segment_frames", lambda pixels, options: options)
    assert drivers.controlled_count(None, 9).most_rounds == Options().most_rounds == 5000
    assert drivers.controlled_count(None, 9, Options(most_rounds=7)).most_rounds == 7


def test_split_gain_equals_the_scores_of_the_table(spark):
    """Regions with all shares of invalid pixels, on either side."""
    from tesserae.operators.regions import split_scores

    rng = np.random.default_rng(3)
    n = rng.integers(20, 60, (2, 30)).astype(float)
    values = [[rng.random((int(c), 3)) * rng.random() for c in side] for side in n]
    moments = [(side, np.array([v.sum(0) for v in vs]), np.array([(v**2).sum(0) for v in vs])) for side, vs in zip(n, values, strict=True)]
    lost = [np.floor(rng.random(30) * side) for side in n]
    o = Options(sigma_app=0.1, gamma=4.0, split_alpha=0.5)
    gain, other = k.split_gain(*moments, o, lost)
    rows = []
    for i in range(30):
        part = 1 if lost[1][i] < lost[0][i] else 0
        rows.append((i, float(lost[part][i] / n[part][i]), *(float(x) for m in moments for x in (m[0][i], *m[1][i], *m[2][i]))))
    columns = ["i", "iperc", *(f"{side}{c}" for side in ("k_", "s_") for c in ("n", "s0", "s1", "s2", "q0", "q1", "q2"))]
    got = split_scores(spark.createDataFrame(rows, columns), 0.1, 0.5, 4.0).orderBy("i").collect()
    assert np.allclose([r.h for r in got], gain) and 0 < other.sum() < 30
    assert np.allclose(k.split_gain(*moments, o)[0] - gain, 4 * (1 - np.array([r[1] for r in rows])))


def test_a_cut_halves_the_prior_of_a_part_that_changed():
    image = two_colours(24, 32, 16)
    one = np.zeros((24, 32), int)
    p = k.parameters(image, one, np.full(1, 400.0), np.ones(1, bool), 8)
    o = Options(gamma=0.0)
    for side in (0, 1):
        invalid = np.zeros((24, 32), bool)
        invalid[:, 16 * side : 16 * side + 16] = True  # which half newly came into view
        labels, q = k.split(image, one, p, o, 0, invalid)
        assert len(np.unique(labels)) == 2 and q.prior_count.tolist() in ([400.0, 200.0], [200.0, 200.0])
        assert labels[0, 0] != labels[0, -1]
        old = labels[0, -1] if side == 0 else labels[0, 0]
        assert old == 0  # the valid half keeps the id


def test_wide_holes_are_filled_to_the_end():
    labels = np.full((3, 2600), -1)
    labels[:, 0] = 4
    assert (k.fill(labels, np.zeros((5, 2))) == 4).all()


def _count_calls(monkeypatch, name):
    calls, kept = [], getattr(k, name)
    monkeypatch.setattr(k, name, lambda *a, **b: calls.append(1) or kept(*a, **b))
    return calls


def test_rounds_that_change_nothing_are_left_out(monkeypatch):
    image = np.zeros((20, 30, 3))
    image[:, 15:] = 1
    o = Options(sp_size=7, niters=16, sigma_app=0.02, use_sm=False)
    want = k.segment_image(image, o)[0]
    calls = _count_calls(monkeypatch, "update_labels")
    assert (k.segment_image(image, o)[0] == want).all() and len(calls) < 16
    p = k.parameters(image, want, np.full(want.max() + 1, 25.0), np.zeros(want.max() + 1, bool), 7)
    once = k.update_labels(image, want, p, o.sigma2, o.potts, 40)
    assert (k.update_labels(image, once, p, o.sigma2, o.potts, 4) == once).all()


def test_frames_are_spread_over_tasks(spark):
    """Few bytes, but long work: one task must not get all frames."""
    from pyspark.sql import functions as F

    from tesserae.plans import drivers

    px = spark.range(64 * 36).selectExpr("cast(id div 36 AS int) AS t", "cast(id % 36 div 6 AS int) AS y", "cast(id % 6 AS int) AS x", "0D AS c0", "0D AS c1", "0D AS c2")
    out = drivers.segment_frames(px, Options(sp_size=5, niters=1)).withColumn("task", F.spark_partition_id())
    assert out.select("task").distinct().count() > 4
