"""Queries over the file forms: tables are written in a form, read back from the files, and compared as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import color
from ..operators import regions
from ..plans import loops
from ..sources import datasets, files
from ..sources.testdata import FLOW, PX, SEG, VERTEX, flows, pixels, segments, table, vertices
from .pixels import LAB, holes

QUERIES: dict = {}
ORACLES: dict = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _images(spark, d, name: str, step: int = 1) -> str:
    """Folder of the frames as images, numbered step by step, below a folder vid."""
    base = loops.fresh_folder(spark, name)
    files.write_files(files.images(pixels(spark, d)).withColumn("t", F.col("t") * step), f"{base}/vid", ".png")
    return base


@register(f"WITH {PX} SELECT 'vid' AS video, t, y, x, c0, c1, c2 FROM px")
def image_files(spark, d):
    out = files.read_video(spark, _images(spark, d, "images"))
    return out.select("video", "t", "y", "x", *(F.col(f"c{i}").cast("double").alias(f"c{i}") for i in range(3)))


@register(f"WITH {PX} SELECT DISTINCT t AS place, CAST(3 * t AS INTEGER) AS number FROM px")
def numbered_files(spark, d):
    """Frames with gaps in their numbers: by rank and by the number in the file's name."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(_images(spark, d, "numbers", 3)).select("path")
    ranks = files.numbered(found).select("path", F.col("t").alias("place"))
    return files.by_number(found).select("path", F.col("t").alias("number")).join(ranks, "path").select("place", "number")


@register(f"WITH {PX} SELECT y, x, round(c0 / 255, 6) AS c0, round(c1 / 255, 6) AS c1, round(c2 / 255, 6) AS c2 FROM px WHERE t = 0")
def one_image(spark, d):
    base = _images(spark, d, "image")
    return files.read_image(spark, f"{base}/vid/00000.png").select("y", "x", *(F.round(F.col(f"c{i}").cast("double"), 6).alias(f"c{i}") for i in range(3)))


@register(f"WITH {PX} SELECT t, CAST(y // 2 AS INTEGER) AS y, CAST(x // 2 AS INTEGER) AS x, avg(c0) AS c0, avg(c1) AS c1, avg(c2) AS c2 FROM px GROUP BY t, y // 2, x // 2")
def resized_half(spark, d):
    """Half the size: each pixel is the mean of four."""
    return files.resize(pixels(spark, d), 15, 25, 30, 50)


@register(f"WITH {PX}, e AS (SELECT t, y, x, c0 FROM px), k AS (SELECT CAST(q AS INTEGER) AS x, CAST(greatest(q * 0.5 - 0.25, 0) AS DOUBLE) AS f FROM range(100) r(q)) SELECT a.t, a.y, k.x, round(a.c0 * (1 - (f - floor(f))) + b.c0 * (f - floor(f)), 6) AS c0 FROM k JOIN e a ON a.x = CAST(floor(f) AS INTEGER) JOIN e b ON b.t = a.t AND b.y = a.y AND b.x = least(CAST(floor(f) AS INTEGER) + 1, 49)")
def resized_wide(spark, d):
    """Twice as wide: linear between the centres of pixels."""
    return files.resize(pixels(spark, d), 30, 100, 30, 50).select("t", "y", "x", F.round("c0", 6).alias("c0"))


@register(f"WITH {FLOW} SELECT t, y, x, fx / 4 AS fx, fy / 8 AS fy FROM flow")
def flow_files(spark, d):
    base = loops.fresh_folder(spark, "flows")
    files.write_files(files.flow_files(flows(spark, d).withColumns({"fx": F.col("fx") / 4, "fy": F.col("fy") / 8})), f"{base}/vid", ".flo")
    return files.read_flows(spark, base).select("t", "y", "x", F.col("fx").cast("double").alias("fx"), F.col("fy").cast("double").alias("fy"))


@register(f"WITH {SEG} SELECT CASE WHEN t % 2 = 0 THEN 'a' ELSE 'b' END AS video, t, y, x, CASE WHEN x BETWEEN 10 AND 20 AND y BETWEEN 7 AND 15 THEN NULL ELSE spix END AS spix FROM seg")
def label_files(spark, d):
    """Label matrices of two videos; pixels without a label stand as -1 in the files."""
    base = loops.fresh_folder(spark, "labels")
    seg = holes(spark, d).withColumn("video", F.when(F.col("t") % 2 == 0, "a").otherwise("b"))
    files.write_files(files.label_matrices(seg), base, ".csv")
    return files.read_labels(spark, base)


@register(f"WITH {PX} SELECT t, y, x, CAST(c0 >= 128 AS INTEGER) AS gt FROM px")
def truth_files(spark, d):
    return files.read_truth(spark, _images(spark, d, "truth")).select("t", "y", "x", "gt")


@register(f"WITH {PX} SELECT t, y, x, CAST(CASE WHEN c0 > 200 THEN 2 WHEN c0 < 100 THEN 1 ELSE 0 END AS INTEGER) AS gt FROM px")
def truth_objects(spark, d):
    """One folder an object: the last one that covers a pixel."""
    base = loops.fresh_folder(spark, "objects")
    for name, inside in (("1", F.col("c0") < 100), ("2", F.col("c0") > 200)):
        shown = F.when(inside, 255.0).otherwise(0.0)
        files.write_files(files.images(pixels(spark, d).withColumns({f"c{i}": shown for i in range(3)})), f"{base}/{name}", ".png")
    return files.read_truth_objects(spark, [f"{base}/1", f"{base}/2"])


@register("SELECT 'segtrack' AS dataset, n_name AS video FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'davis', n_name FROM nation WHERE n_regionkey = 2")
def dataset_videos(spark, d):
    """Videos of a dataset by its folders of ground truth, and by its list."""
    base, nation = loops.fresh_folder(spark, "datasets"), table(spark, d, "nation")
    frames = nation.where("n_regionkey = 1").select(F.col("n_name").alias("video"), F.lit(1).alias("t"), F.lit("x").alias("content"))
    files.write_files(frames, f"{base}/s/GroundTruth", ".png")
    names = nation.where("n_regionkey = 2").agg(F.array_join(F.array_sort(F.collect_list("n_name")), "\n").alias("content"))
    files.write_files(names.select(F.lit("val").alias("scene"), "content"), f"{base}/d/ImageSets/2017", ".txt")
    return datasets.videos(spark, "SegTrackv2", f"{base}/s").select(F.lit("segtrack").alias("dataset"), "video").union(datasets.videos(spark, "DAVIS", f"{base}/d").select(F.lit("davis").alias("dataset"), "video"))


_POINT = "SELECT 'part' AS cloud, CAST(p_partkey AS INTEGER) AS i, CAST(p_partkey % 17 AS DOUBLE) AS x, CAST(p_size AS DOUBLE) AS y, CAST(p_partkey % 5 AS DOUBLE) AS z FROM part"


@register(f"WITH p AS ({_POINT}), b AS (SELECT min(i) AS i0, min(x) AS x0, min(y) AS y0, min(z) AS z0, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS side FROM p) SELECT cloud, CAST(i - i0 AS INTEGER) AS i, round((x - x0) / side, 9) AS x, round((y - y0) / side, 9) AS y, round((z - z0) / side, 9) AS z FROM p, b WHERE (i - i0) % 3 = 0")
def point_files(spark, d):
    """Points of an OFF file in the unit cube, every third one."""
    base = loops.fresh_folder(spark, "points")
    line = F.struct("p_partkey", F.concat_ws(" ", (F.col("p_partkey") % 17).cast("string"), F.col("p_size").cast("string"), (F.col("p_partkey") % 5).cast("string")).alias("line"))
    rows = table(spark, d, "part").agg(F.array_sort(F.collect_list(line)).alias("rows"))
    content = F.concat(F.lit("OFF\n"), F.size("rows").cast("string"), F.lit(" 0 0\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n"))
    files.write_files(rows.select(F.lit("part").alias("scene"), content.alias("content")), base, ".off")
    out = files.every_nth(files.unit_cube(files.read_off(spark, base)), 3)
    return out.select("cloud", "i", *(F.round(c, 9).alias(c) for c in "xyz"))


def _scene(spark, d):
    """Each frame's pixels as the vertices of a scene, two triangles between four of them, and their first edges."""
    px = pixels(spark, d).withColumn("scene", F.concat(F.lit("s"), "t"))
    v = px.select("scene", F.expr("y * 50 + x").alias("v"), F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py"), F.lit(0.5).alias("pz"), *((F.col(f"c{i}") / 255).alias(f"f{i}") for i in range(3)), F.expr("cast((x + y) % 4 AS int)").alias("gcolor"), F.expr("cast(x div 10 AS int)").alias("spix"))
    cells = px.where("y < 29 AND x < 49").select("scene", F.expr("y * 49 + x").alias("c"), F.expr("y * 50 + x").alias("p"))
    f = cells.select("scene", F.explode(F.expr("array(struct(2 * c AS f, array(p, p + 1, p + 50) AS verts), struct(2 * c + 1 AS f, array(p + 1, p + 51, p + 50) AS verts))")).alias("k")).select("scene", "k.f", "k.verts")
    e = cells.select("scene", F.col("p").alias("u"), F.expr("p + 1").alias("v"))
    return v, f, e


def _frame_of_scene():
    return F.expr("cast(substring(scene, 2) AS int)").alias("t")


@register(LAB.join(("WITH ", " SELECT t, CAST(y * 50 + x AS INTEGER) AS v, CAST(x + 5 AS DOUBLE) AS px, CAST(y AS DOUBLE) AS py, 0.5::DOUBLE AS pz, round(l, 5) + 0.0 AS f0, round(a, 5) + 0.0 AS f1, round(b, 5) + 0.0 AS f2 FROM lab")))
def scene_files(spark, d):
    """Vertices of a PLY file, colours as Lab, moved by the scene's alignment; the file is made from Lab colours too."""
    base = loops.fresh_folder(spark, "scenes")
    v, f, e = _scene(spark, d)
    lab = v.withColumns({f"f{i}": c for i, c in enumerate(color.rgb_to_lab(F.col("f0"), F.col("f1"), F.col("f2")))})
    files.write_files(files.scene_files(lab, f, e, lab=True), base, ".ply")
    files.write_files(v.select("scene").distinct().select("scene", F.lit("axisAlignment = 1 0 0 5 0 1 0 0 0 0 1 0 0 0 0 1\n").alias("content")), base, ".txt")
    points, _ = files.read_scenes(spark, base)
    return points.select(_frame_of_scene(), "v", "px", "py", "pz", *((F.round(f"f{i}", 5) + F.lit(0.0)).alias(f"f{i}") for i in range(3)))


@register(f"WITH {PX}, c AS (SELECT t, y * 49 + x AS c, y * 50 + x AS p FROM px WHERE y < 29 AND x < 49) SELECT t, CAST(2 * c AS INTEGER) AS f, CAST(p AS INTEGER) AS a, CAST(p + 1 AS INTEGER) AS b, CAST(p + 50 AS INTEGER) AS c FROM c UNION ALL SELECT t, CAST(2 * c + 1 AS INTEGER), CAST(p + 1 AS INTEGER), CAST(p + 51 AS INTEGER), CAST(p + 50 AS INTEGER) FROM c")
def scene_faces(spark, d):
    base = loops.fresh_folder(spark, "faces")
    v, f, _ = _scene(spark, d)
    files.write_files(files.scene_files(v, f), base, ".ply")
    faces = files.read_scenes(spark, base)[1]
    return faces.select(_frame_of_scene(), "f", *(F.col("verts")[i].alias(n) for i, n in enumerate("abc")))


def _ply(spark, folder: str, element: str, schema: str):
    """Rows of an element of PLY files."""

    def decode(frames):
        import pandas as pd

        for frame in frames:
            for content in frame["content"]:
                found = pd.DataFrame(files.decode_ply(content)[element])
                yield found[[c.split()[0].strip("`") for c in schema.split(", ")]]

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.ply").load(folder).select("content").mapInPandas(decode, schema)


@register(f"WITH {PX} SELECT CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(c0 AS INTEGER) AS red, CAST(c1 AS INTEGER) AS green, CAST(c2 AS INTEGER) AS blue, CAST((x + y) % 4 AS INTEGER) AS gcolor, CAST(x // 10 AS INTEGER) AS label FROM px")
def scene_labels(spark, d):
    """What a scene's file says of its vertices beside their places: colours, the colour of the graph, labels."""
    base = loops.fresh_folder(spark, "marks")
    v, f, _ = _scene(spark, d)
    files.write_files(files.scene_files(v, f), base, ".ply")
    return _ply(spark, base, "vertex", "x double, y double, red int, green int, blue int, gcolor int, label int")


@register(f"WITH {PX} SELECT CAST(y * 50 + x AS INTEGER) AS vertex1, CAST(y * 50 + x + 1 AS INTEGER) AS vertex2 FROM px WHERE y < 29 AND x < 49")
def scene_edges(spark, d):
    base = loops.fresh_folder(spark, "edges")
    files.write_files(files.scene_files(*_scene(spark, d)), base, ".ply")
    return _ply(spark, base, "edge", "vertex1 int, vertex2 int")


@register(f"""WITH {PX} SELECT t, CAST(min(x) AS DOUBLE) AS min_x, CAST(max(x) AS DOUBLE) AS max_x, CAST(min(y) AS DOUBLE) AS min_y, CAST(max(y) AS DOUBLE) AS max_y, 0.5::DOUBLE AS min_z, 0.5::DOUBLE AS max_z FROM px GROUP BY t""")
def scene_boxes(spark, d):
    return files.boxes(_scene(spark, d)[0]).select(_frame_of_scene(), "*").drop("scene")


@register(f"""WITH {VERTEX}, r AS (SELECT spix, avg(px) AS x, avg(py) AS y, avg(pz) AS z, var_pop(px) AS var_x, covar_pop(px, py) AS cov_xy, avg(f0) AS f0 FROM vertex GROUP BY spix)
    SELECT round(x, 3) + 0.0 AS x, round(y, 3) + 0.0 AS y, round(z, 3) + 0.0 AS z, round(var_x, 3) + 0.0 AS var_x, round(cov_xy, 3) + 0.0 AS cov_xy, CAST(round_even(least(greatest(f0 / 64 * 255, 0), 255), 0) AS INTEGER) AS red FROM r""")
def region_files(spark, d):
    """A file of regions: positions, variances and covariances, mean colours."""
    base, v = loops.fresh_folder(spark, "regions"), vertices(spark, d)
    m = v.groupBy("spix").agg(*(F.avg(c).alias(f"m_{c}") for c in ("px", "py", "pz")), *((F.avg(c) / 64).alias(f"m_{c}") for c in ("f0", "f1", "f2")), *(F.covar_pop(f"p{a}", f"p{b}").alias(f"i{a}{b}") for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")))
    files.write_files(files.region_files(m.withColumn("scene", F.lit("s"))), base, ".ply")
    out = _ply(spark, base, "vertex", "x double, y double, z double, var_x double, cov_xy double, red int")
    return out.select(*((F.round(c, 3) + F.lit(0.0)).alias(c) for c in ("x", "y", "z", "var_x", "cov_xy")), "red")


@register(f"WITH {SEG}, m AS (SELECT t, spix, count(*) AS n, avg(c0) AS mu0, avg(x) AS mx, avg(y) AS my FROM seg GROUP BY t, spix) SELECT spix AS label, round(mu0, 4) AS mu, round(mu0, 4) AS p_mu, round(mx, 4) AS mx, round(my, 4) AS my, CAST(n AS INTEGER) AS n, 25.0::DOUBLE AS prior_count FROM m")
def parameter_files(spark, d):
    base = loops.fresh_folder(spark, "parameters")
    p = regions.parameters(regions.moments(segments(spark, d)), F.lit(25.0), 5)
    files.parameter_table(p, 25.0).write.csv(base, header=True)
    r = files.read_results(spark, base)
    assert tuple(r.columns) == files.PARAMETER_COLUMNS
    return r.select("label", F.round("`mu_i.x`", 4).alias("mu"), F.round("`p_mu_i.x`", 4).alias("p_mu"), F.round("`mu_s.x`", 4).alias("mx"), F.round("`mu_s.y`", 4).alias("my"), F.col("count").alias("n"), "prior_count")


@register("WITH g AS (SELECT 'g' || (c_nationkey % 3) AS grp, c_mktsegment AS id, avg(c_acctbal) AS tex FROM customer GROUP BY ALL) SELECT grp, id, CAST(rep AS INTEGER) AS rep, round(tex + rep, 4) AS tex FROM g, (VALUES (0), (1)) v(rep)")
def result_files(spark, d):
    """Results by group, experiment and repetition; those of repetition 1 are written twice, and the later ones stay."""
    base = loops.fresh_folder(spark, "results")
    r = table(spark, d, "customer").groupBy(F.concat(F.lit("g"), F.col("c_nationkey") % 3).alias("grp"), F.col("c_mktsegment").alias("id")).agg(F.avg("c_acctbal").alias("tex"))
    for rep, shift in ((0, 0), (1, 7), (1, 1)):
        files.write_results(r.withColumns({"rep": F.lit(rep), "tex": F.round(F.col("tex") + shift, 4)}), base, ("grp", "id", "rep"))
    return spark.read.parquet(base).select("grp", "id", "rep", "tex")


@register(f"WITH {SEG}, s AS (SELECT t, y, x, spix AS a, CAST(spix - spix % 2 AS INTEGER) AS b, CAST(spix - spix % 4 AS INTEGER) AS c FROM seg) SELECT 'merge' AS step, 1 AS seq, t, a AS old, b AS new, count(*) AS n FROM s WHERE a <> b GROUP BY ALL UNION ALL SELECT 'merge', 2, t, b, c, count(*) FROM s WHERE b <> c GROUP BY ALL")
def trace_changes(spark, d):
    """A log of three snapshots, and which labels change between them."""
    base, seg = loops.fresh_folder(spark, "trace"), segments(spark, d)
    for seq, k in enumerate((1, 2, 4)):
        files.append_trace(seg.withColumn("spix", (F.col("spix") - F.col("spix") % k).cast("int")), base, "merge", seq)
    return files.label_changes(spark.read.parquet(base))
