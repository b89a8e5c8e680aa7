"""Round trips of the file forms."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.sources import files


def test_images(spark, tmp_path):
    (tmp_path / "vid").mkdir()
    rng = np.random.default_rng(0)
    frames = rng.integers(0, 256, (2, 4, 5, 3), dtype=np.uint8)
    for t, a in enumerate(frames):
        (tmp_path / "vid" / f"{t:05d}.png").write_bytes(files.png(a))
    px = files.read_video(spark, str(tmp_path))
    got = np.zeros(frames.shape)
    for r in px.collect():
        got[r.t, r.y, r.x] = r.c0, r.c1, r.c2
    assert (got == frames).all()
    assert files.read_image(spark, str(tmp_path / "vid" / "00000.png")).agg(F.max("c0")).first()[0] <= 1
    again = {r.t: r.content for r in files.images(px).collect()}
    assert bytes(again[1]) == files.png(frames[1])
    small = files.resize(px.where("t = 0"), 2, 5, 4, 5).orderBy("y", "x").collect()
    want = (frames[0, ::2].astype(float) + frames[0, 1::2]) / 2
    assert np.allclose([r.c0 for r in small], want[..., 0].ravel())
    truth = files.read_truth(spark, str(tmp_path)).where("t = 0").orderBy("y", "x").collect()
    assert [r.gt for r in truth] == (frames[0, ..., 0].ravel() >= 128).astype(int).tolist()


def test_flows(spark, tmp_path):
    (tmp_path / "vid").mkdir()
    a = np.random.default_rng(0).normal(size=(3, 4, 2)).astype(np.float32)
    (tmp_path / "vid" / "00000.flo").write_bytes(files.encode_flow(a))
    rows = files.read_flows(spark, str(tmp_path))
    got = np.zeros_like(a)
    for r in rows.collect():
        got[r.y, r.x] = r.fx, r.fy
    assert (got == a).all()
    assert bytes(files.flow_files(rows).first().content) == files.encode_flow(a)
    with pytest.raises(ValueError, match="not a motion"):
        files.decode_flow(b"nope" + files.encode_flow(a)[4:])
    with pytest.raises(ValueError, match="size"):
        files.decode_flow(files.encode_flow(a)[:-1])
    a[0, 0, 0] = np.nan
    with pytest.raises(ValueError, match="no numbers"):
        files.decode_flow(files.encode_flow(a))
    half = files.FLOW_TAG + struct.pack("<ii", 2, 1) + np.ones((1, 2, 2), "<f2").tobytes()
    assert files.decode_flow(half, 16).tolist() == [[[1, 1], [1, 1]]]


def test_label_matrices(spark, tmp_path):
    seg = spark.createDataFrame([(t, y, x, None if (y, x) == (0, 1) else 3 * y + x) for t in (0, 2) for y in range(3) for x in range(4)], "t int, y int, x int, spix int")
    files.write_files(files.label_matrices(seg), f"file://{tmp_path}/vid", ".csv")
    (tmp_path / "vid" / "notes.csv").write_text("no matrix")
    back = files.read_labels(spark, str(tmp_path)).select("t", "y", "x", "spix")
    assert sorted(map(str, back.collect())) == sorted(map(str, seg.collect()))


def test_meshes(spark, tmp_path):
    v = [(0.0, 0.0, 0.0, 255, 0, 0), (1.0, 0.0, 0.0, 0, 255, 0), (0.0, 1.0, 0.0, 0, 0, 255)]
    props = [("x", "float"), ("y", "float"), ("z", "float"), ("red", "uchar"), ("green", "uchar"), ("blue", "uchar")]
    (tmp_path / "a.ply").write_bytes(files.encode_ply({"vertex": (props, v), "face": ([("vertex_indices", "list")], [([0, 1, 2],)])}))
    (tmp_path / "a.txt").write_text("axisAlignment = 1 0 0 5 0 1 0 0 0 0 1 0 0 0 0 1\nother = 1\n")
    (tmp_path / "b.ply").write_text("ply\nformat ascii 1.0\nelement vertex 1\nproperty float x\nproperty float y\nproperty float z\nend_header\n1 2 3\n")
    points, faces = files.read_scenes(spark, str(tmp_path), lab=False)
    got = {(r.scene, r.v): (r.px, r.f0) for r in points.collect()}
    assert got["a", 1] == (6.0, 0.0) and got["a", 0] == (5.0, 1.0) and got["b", 0][0] == 1.0
    assert [r.verts for r in faces.where("scene = 'a'").collect()] == [[0, 1, 2]]
    assert files.boxes(points).where("scene = 'a'").first().max_x == 6.0


def test_points_and_results(spark, tmp_path):
    (tmp_path / "p.off").write_text("OFF\n3 0 0\n0 0 0\n2 0 0\n0 4 0\n")
    pts = files.read_off(spark, str(tmp_path))
    assert pts.count() == 3 and files.every_nth(pts, 2).count() == 2
    assert files.unit_cube(pts).agg(F.max("y")).first()[0] == 1.0
    r = spark.createDataFrame([("g", "id_0", 0, 0.5)], "group string, id string, rep int, tex double")
    files.write_results(r, str(tmp_path / "results"))
    files.write_results(r.withColumn("rep", F.lit(1)), str(tmp_path / "results"))
    assert spark.read.parquet(str(tmp_path / "results")).count() == 2
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "one.csv").write_text("tex,szv\n0.5,1\n")
    assert files.read_results(spark, str(tmp_path / "absent.csv")) is None and files.read_results(spark, str(tmp_path / "empty.csv")) is None
    assert files.read_results(spark, str(tmp_path / "one.csv")).first().tex == 0.5


def test_trace(spark, tmp_path):
    a = spark.createDataFrame([(0, 0, 0, 1), (0, 0, 1, 2)], "t int, y int, x int, spix int")
    files.append_trace(a, str(tmp_path / "log"), "merge", 0)
    files.append_trace(a.withColumn("spix", F.lit(1)), str(tmp_path / "log"), "merge", 1)
    changes = files.label_changes(spark.read.parquet(str(tmp_path / "log"))).collect()
    assert [(r.old, r.new, r.n) for r in changes] == [(2, 1, 1)]


def test_scene_files(spark, tmp_path):
    v = spark.createDataFrame([("s", i, float(i), 0.0, 1.0, 1.0, 0.0, 0.5, i % 2, i) for i in range(3)], "scene string, v int, px double, py double, pz double, f0 double, f1 double, f2 double, gcolor int, spix int")
    f = spark.createDataFrame([("s", 0, [0, 1, 2])], "scene string, f int, verts array<int>")
    (tmp_path / "s.ply").write_bytes(bytes(files.scene_files(v, f).first().content))
    points, faces = files.read_scenes(spark, str(tmp_path), lab=False)
    assert sorted((r.v, r.px, r.f0) for r in points.collect()) == [(i, float(i), 1.0) for i in range(3)]
    assert faces.first().verts == [0, 1, 2]
    assert files.decode_ply((tmp_path / "s.ply").read_bytes())["vertex"]["label"] == [0, 1, 2]
    r = spark.createDataFrame([("s", 0, *[1.0] * 12)], "scene string, spix int, " + ", ".join(f"{c} double" for c in ("m_px", "m_py", "m_pz", "ixx", "iyy", "izz", "ixy", "ixz", "iyz", "m_f0", "m_f1", "m_f2")))
    assert files.decode_ply(bytes(files.region_files(r).first().content))["vertex"]["var_x"] == [1.0]


def test_datasets(spark, tmp_path):
    from tesserae.sources import datasets

    (tmp_path / "GroundTruth" / "bird").mkdir(parents=True)
    (tmp_path / "GroundTruth" / "bird" / "00001.png").write_bytes(files.png(np.zeros((1, 1, 3), np.uint8)))
    (tmp_path / "ImageSets" / "2017").mkdir(parents=True)
    (tmp_path / "ImageSets" / "2017" / "val.txt").write_text("bear\ncar\n")
    assert [r.video for r in datasets.videos(spark, "SegTrackv2", str(tmp_path)).collect()] == ["bird"]
    assert sorted(r.video for r in datasets.videos(spark, "davis", str(tmp_path)).collect()) == ["bear", "car"]
    assert datasets.images("davis", "/d", "bear") == "/d/JPEGImages/480p/bear" and datasets.known("segtrackv2")["start"] == 1
    with pytest.raises(KeyError):
        datasets.known("other")


def test_outlines(spark):
    from tesserae.plans.mesh import outlines

    square = [(0, 0, 1), (0, 1, 2), (0, 2, 3), (0, 0, 3)]
    points = spark.createDataFrame([(i, float(x), float(y), 0.0) for i, (x, y) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1)])], "v int, px double, py double, pz double")
    out = outlines(spark.createDataFrame(square, "spix int, u int, v int"), points).first()
    assert out.path == [0, 1, 2, 3]
    ring = spark.range(700).selectExpr("1 AS spix", "cast(id AS int) AS u", "cast((id + 1) % 700 AS int) AS v")
    places = spark.range(700).selectExpr("cast(id AS int) AS v", "cos(id * pi() / 350) AS px", "sin(id * pi() / 350) AS py", "0D AS pz")
    long = outlines(ring, places).first().path
    assert long in ([*range(700)], [0, *range(699, 0, -1)])
