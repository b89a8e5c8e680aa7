"""Graphs and meshes as edge, vertex and face tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.loops import stored


def unique_edges(faces: DataFrame) -> DataFrame:
    """Undirected edges u < v of triangles (a, b, c)."""
    return face_edges(faces).select("u", "v").distinct()


def face_edges(faces: DataFrame) -> DataFrame:
    """f, u, v: three rows for each triangle."""
    pairs = F.array(*(F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v")) for p, q in (("a", "b"), ("b", "c"), ("a", "c"))))
    return faces.select("f", F.explode(pairs).alias("e")).select("f", "e.u", "e.v").where("u < v").distinct()


def both_ways(edges: DataFrame, *more: str) -> DataFrame:
    return edges.select("u", "v", *more).union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), *more))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("u").agg(F.count("*").alias("degree")).withColumnRenamed("u", "v")


def running_total(df: DataFrame, number: str, value: Column, name: str) -> DataFrame:
    """df with the sum of value over all rows up to its own, in the order of an integer column without repeats.

    Sums run within ranges of 1024 numbers, within ranges of 1024 such ranges, and over those ranges' totals, so that one
    task only sorts a millionth of the numbers.
    """
    n = F.col(number).cast("long")
    rows = df.withColumns({"__value": value.cast("long"), "__block": F.shiftright(n, 10), "__range": F.shiftright(n, 20)})
    blocks = rows.groupBy("__range", "__block").agg(F.sum("__value").alias("__total"))
    ranges = blocks.groupBy("__range").agg(F.sum("__total").alias("__sum"))
    ranges = ranges.select("__range", (F.sum("__sum").over(Window.orderBy("__range")) - F.col("__sum")).alias("__first"))
    ahead = F.sum("__total").over(Window.partitionBy("__range").orderBy("__block")) - F.col("__total")
    blocks = blocks.select("__range", "__block", ahead.alias("__ahead")).join(ranges, "__range").select("__block", (F.col("__ahead") + F.col("__first")).alias("__before"))
    inner = F.sum("__value").over(Window.partitionBy("__block").orderBy(number))
    return rows.withColumn("__inner", inner).join(blocks, "__block").withColumn(name, F.col("__inner") + F.col("__before")).select(*df.columns, name)


def prefix_offsets(edges: DataFrame) -> DataFrame:
    """Where each vertex's neighbours end in the list of all, by id: v, degree, stop."""
    return running_total(degrees(edges), "v", F.col("degree"), "stop")


def from_both_ways(adjacency: DataFrame) -> DataFrame:
    return adjacency.where("u < v")


def edge_runs(faces: DataFrame) -> DataFrame:
    """Each edge with its faces in order."""
    return face_edges(faces).groupBy("u", "v").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("f")).alias("faces"))


def non_manifold(faces: DataFrame) -> DataFrame:
    return face_edges(faces).groupBy("u", "v").agg(F.count("*").alias("n")).where("n > 2")


def repaired(faces: DataFrame) -> DataFrame:
    """Triangles whose edges have two faces at most: of a third and later face on an edge all corners become new vertices.

    New vertices are numbered by face and corner above all old ones.
    """
    extra = face_edges(faces).withColumn("k", F.row_number().over(Window.partitionBy("u", "v").orderBy("f"))).where("k > 2").select("f").distinct()
    top = faces.agg((F.greatest(F.max("a"), F.max("b"), F.max("c")) + 1).alias("top"))
    out = faces.join(extra.withColumn("cut", F.lit(True)), "f", "left").crossJoin(F.broadcast(top))
    return out.select("f", *(F.when(F.col("cut"), F.col("top") + 3 * F.col("f") + i).otherwise(F.col(c)).cast("int").alias(c) for i, c in enumerate("abc")))


def repair_marks(faces: DataFrame, top: int) -> DataFrame:
    """f, k, old and new: the corners k (0 to 2) at which the third and later faces of an edge begin that edge, each with a
    new vertex. New vertices are numbered from top on in the order of faces and corners."""
    corners = F.array(*(F.struct(F.lit(k).alias("k"), F.col(p).alias("p"), F.col(q).alias("q")) for k, (p, q) in enumerate((("a", "b"), ("b", "c"), ("c", "a")))))
    each = faces.select("f", F.explode(corners).alias("e")).select("f", "e.k", F.col("e.p").alias("old"), F.least("e.p", "e.q").alias("u"), F.greatest("e.p", "e.q").alias("v")).where("u < v")
    nth = F.dense_rank().over(Window.partitionBy("u", "v").orderBy("f"))
    late = each.withColumn("nth", nth).where("nth > 2").withColumn("place", 3 * F.col("f").cast("long") + F.col("k"))
    return running_total(late, "place", F.lit(1), "number").select("f", "k", "old", (F.col("number") + top - 1).cast("int").alias("new"))


def repaired_mesh(faces: DataFrame, vertices: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Faces, vertices and edges of the mesh in which no edge has more than two of the faces it had.

    Of a third and later face on an edge the corner that begins that edge becomes a new vertex: a copy of the old one, and
    two edges join it to the face's other corners as they are then. Faces rank by f. Edges that were there stay.
    """
    highest = vertices.agg(F.max("v")).first()[0]
    marks = repair_marks(faces, (-1 if highest is None else highest) + 1)
    by_face = marks.groupBy("f").agg(*(F.max(F.when(F.col("k") == k, F.col("new"))).alias(f"n{k}") for k in range(3)))
    both = faces.join(by_face, "f", "left")
    a, b = F.coalesce("n0", "a"), F.coalesce("n1", "b")
    added = F.array(*(F.struct(F.col(f"n{k}").alias("new"), F.array(*ends).alias("ends")) for k, ends in enumerate(((F.col("b"), F.col("c")), (F.col("c"), a), (a, b)))))
    more = both.select(F.explode(added).alias("m")).where("m.new IS NOT NULL").select(F.explode("m.ends").alias("u"), F.col("m.new").alias("v"))
    copies = marks.select(F.col("old").alias("v"), "new").join(vertices, "v").withColumn("v", F.col("new")).select(*vertices.columns)
    new_faces = both.select("f", a.cast("int").alias("a"), b.cast("int").alias("b"), F.coalesce("n2", "c").cast("int").alias("c"))
    return new_faces, vertices.union(copies), unique_edges(faces).union(more.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")))


def dual_edges(faces: DataFrame) -> DataFrame:
    """Pairs f1 < f2 of faces that share an edge."""
    e = face_edges(faces)
    return e.select("u", "v", F.col("f").alias("f1")).join(e.select("u", "v", F.col("f").alias("f2")), ["u", "v"]).where("f1 < f2").select("f1", "f2").distinct()


def dual_vertices(faces: DataFrame, vertices: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Faces as vertices: means of their corners' columns."""
    corners = faces.select("f", F.explode(F.array("a", "b", "c")).alias("v"))
    return corners.join(vertices, "v").groupBy("f").agg(*(F.avg(c).alias(c) for c in columns))


def graph_border(edges: DataFrame, vertices: DataFrame, label: str = "spix") -> DataFrame:
    """v and is_border: a neighbour has another label."""
    near = both_ways(edges).join(vertices.select(F.col("v"), F.col(label).alias("other")), "v").join(vertices.select(F.col("v").alias("u"), F.col(label).alias("own")), "u")
    return near.groupBy("u").agg(F.bool_or(F.col("own") != F.col("other")).alias("is_border")).withColumnRenamed("u", "v")


def border_edges(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges between border vertices of one label."""
    v = graph_border(edges, vertices).where("is_border").join(vertices.select("v", "spix"), "v").drop("is_border")
    out = edges.join(v.withColumnRenamed("v", "u").withColumnRenamed("spix", "own"), "u").join(v, "v")
    return out.where("own = spix").select("u", "v", "spix")


def label_vote(faces: DataFrame, labels: DataFrame) -> DataFrame:
    """Vertex labels by majority of its faces' labels (f, spix), the smaller one of equals."""
    corners = faces.select("f", F.explode(F.array_distinct(F.array("a", "b", "c"))).alias("v"))
    votes = corners.join(labels, "f").groupBy("v", "spix").agg(F.count("*").alias("n"))
    return votes.groupBy("v").agg(F.max(F.struct("n", (-F.col("spix")).alias("minus")))["minus"].alias("minus")).select("v", (-F.col("minus")).alias("spix"))


def two_hop_pairs(edges: DataFrame) -> DataFrame:
    """For each vertex the pairs of its neighbours and whether another path of one or two steps joins them."""
    a = both_ways(edges)
    pairs = a.select(F.col("u").alias("c"), F.col("v").alias("p")).join(a.select(F.col("u").alias("c"), F.col("v").alias("q")), "c").where("p < q")
    direct = a.select(F.col("u").alias("p"), F.col("v").alias("q"), F.lit(-1).alias("via"))
    step = a.select(F.col("v").alias("p"), F.col("u").alias("via")).join(a.select(F.col("u").alias("via"), F.col("v").alias("q")), "via").where("p < q").select("p", "q", "via")
    ways = direct.union(step)
    joined = pairs.join(ways, ["p", "q"], "left").groupBy("c", "p", "q").agg(F.max(F.when(F.col("via") != F.col("c"), 1).otherwise(0)).alias("joined"))
    return joined


def removable(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """v and is_simple: all neighbours with v's label stay joined within two steps without v, inside that label.

    One pair of neighbours that isn't joined decides. A vertex with more pairs than its least neighbour has neighbours is
    first asked for its two least ones; only vertices that pass have all their pairs made, which meet by pair: a pair that
    one vertex alone joins is not joined without it, unless by one of the vertices decided before.
    """
    lab = vertices.select("v", "spix")
    own = edges.join(lab.withColumnRenamed("v", "u").withColumnRenamed("spix", "a"), "u").join(lab, "v").where("a = spix AND u <> v").select("u", "v")
    near = stored(both_ways(own).distinct(), "near")
    degree = near.groupBy("u").agg(F.count("*").alias("degree"))
    ranked = near.join(degree.select(F.col("u").alias("v"), F.col("degree").alias("theirs")), "v")
    nth = F.row_number().over(Window.partitionBy("u").orderBy("theirs", "v"))
    two = ranked.withColumn("nth", nth).where("nth <= 2").groupBy("u").agg(F.min(F.when(F.col("nth") == 1, F.struct("v", "theirs"))).alias("least"), F.max(F.when(F.col("nth") == 2, F.col("v"))).alias("q"))
    asked = stored(two.where("q IS NOT NULL").join(degree, "u").where("degree * (degree - 1) > 2 * least.theirs").select(F.col("u").alias("c"), F.col("least.v").alias("p"), "q"), "asked")

    def through(pairs: DataFrame, steps: DataFrame) -> DataFrame:
        """Those pairs (c, p, q) that a step from p joins to q, at once or by a vertex other than c."""
        first = pairs.join(steps.select(F.col("u").alias("p"), F.col("v").alias("via")), "p").where("via <> c")
        second = first.join(near.select(F.col("u").alias("via"), F.col("v").alias("q")), ["via", "q"])
        return first.where("via = q").select("c", "p", "q").union(second.select("c", "p", "q")).distinct()

    apart = stored(asked.join(through(asked, near), ["c", "p", "q"], "left_anti").select("c"), "apart")
    left = near.join(apart.select(F.col("c").alias("u")), "u", "left_anti")
    pairs = left.select(F.col("u").alias("c"), F.col("v").alias("p")).join(left.select(F.col("u").alias("c"), F.col("v").alias("q")), "c").where("p < q")
    direct = near.where("u < v").select(F.lit(None).cast("int").alias("c"), F.col("u").alias("p"), F.col("v").alias("q"))
    met = pairs.select("c", "p", "q").union(direct).groupBy("p", "q").agg(F.min("c").alias("c"), F.max("c").alias("other"), F.count_if(F.col("c").isNull()).alias("direct"))
    lone = stored(met.where("c = other AND direct = 0").select("c", "p", "q"), "lone")
    gone = near.join(apart.select(F.col("c").alias("v")), "v", "left_semi")
    held = lone.join(through(lone, gone), ["c", "p", "q"], "left_anti")
    bad = apart.union(held.select("c")).distinct().select(F.col("c").alias("v"), F.lit(False).alias("is_simple"))
    return lab.select("v").join(bad, "v", "left").select("v", F.coalesce("is_simple", F.lit(True)).alias("is_simple"))


def removable_by_count(edges: DataFrame, vertices: DataFrame, share: float = 0.2) -> DataFrame:
    """v and is_simple: few neighbours differ (one, or a fifth of all), or the vertex hangs on by one of its neighbours."""
    lab = vertices.select("v", "spix")
    near = both_ways(edges).join(lab.select(F.col("v").alias("u"), F.col("spix").alias("own")), "u").join(lab, "v")
    unlike, n = F.count_if(F.col("own") != F.col("spix")), F.count("*")
    return near.groupBy("u").agg(((unlike <= F.greatest(F.lit(1.0), n * share)) | ((n - unlike == 1) & (n >= 2))).alias("is_simple")).withColumnRenamed("u", "v")


def exterior_edges(faces: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges that one face of a region (f, spix) has alone: the outline of each region."""
    return face_edges(faces).join(labels, "f").groupBy("spix", "u", "v").agg(F.count("*").alias("n")).where("n = 1").select("spix", "u", "v")


def exterior_corners(outline: DataFrame) -> DataFrame:
    """Vertices of each region's outline and how many of its edges meet there."""
    ends = outline.select("spix", F.col("u").alias("v")).union(outline.select("spix", "v"))
    return ends.groupBy("spix", "v").agg(F.count("*").alias("n"))


def moments3d(vertices: DataFrame) -> DataFrame:
    axes = ("px", "py", "pz")
    sums = {"n": F.count("*")} | {f"s_{a}": F.sum(a) for a in axes} | {f"s_f{i}": F.sum(f"f{i}") for i in range(3)}
    sums |= {f"s_{a}{b}": F.sum(F.col(a) * F.col(b)) for i, a in enumerate(axes) for b in axes[i:]}
    return vertices.groupBy("spix").agg(*(c.alias(k) for k, c in sums.items()))


def params3d(stats: DataFrame, side: int) -> DataFrame:
    """Means, inverse covariance drawn to a round prior, and log determinant, by region."""
    from ..functions.algebra import inverse3

    n = F.col("n").cast("double")
    pc = float(side * side)
    mean = {a: F.col(f"s_{a}") / n for a in ("px", "py", "pz")}
    total = n + 50 * pc

    def cov(a: str, b: str) -> Column:
        return ((pc * pc if a == b else 0.0) + F.col(f"s_{a}{b}") - n * mean[a] * mean[b]) / (total - 3)

    inv = inverse3(cov("px", "px"), cov("py", "py"), cov("pz", "pz"), cov("px", "py"), cov("px", "pz"), cov("py", "pz"))
    out = stats.select("spix", "n", *(m.alias(f"m_{a}") for a, m in mean.items()), *((F.col(f"s_f{i}") / n).alias(f"m_f{i}") for i in range(3)), *(inv[k].alias(k) for k in inv))
    return out.withColumn("logdet", F.log("det")).drop("det")


def update3d(edges: DataFrame, vertices: DataFrame, params: DataFrame, sigma2: float, potts: float, colour: Column) -> DataFrame:
    """New labels of the vertices of one colour: the best of their neighbours' labels, of equals the smaller one."""
    lab = vertices.select(F.col("v").alias("w"), F.col("spix").alias("near"))
    active = vertices.where(colour)
    near = active.select("v").join(both_ways(edges).select(F.col("u").alias("v"), F.col("v").alias("w")), "v").join(lab, "w").select("v", "near")
    degree = near.groupBy("v").agg(F.count("*").alias("deg"))
    cand = near.groupBy("v", "near").agg(F.count("*").alias("k")).join(degree, "v").join(active, "v").join(params.drop("n").withColumnRenamed("spix", "near"), "near")
    d = [F.col(a) - F.col(f"m_{a}") for a in ("px", "py", "pz")]
    place = d[0] * d[0] * F.col("ixx") + d[1] * d[1] * F.col("iyy") + d[2] * d[2] * F.col("izz") + 2 * (d[0] * d[1] * F.col("ixy") + d[0] * d[2] * F.col("ixz") + d[1] * d[2] * F.col("iyz"))
    shade = sum(F.pow(F.col(f"f{i}") - F.col(f"m_f{i}"), F.lit(2)) for i in range(3))
    score = F.round(-shade / sigma2 - place - F.col("logdet") - potts * (F.col("deg") - F.col("k")), 6)
    best = cand.groupBy("v").agg(F.max(F.struct(score.alias("score"), (-F.col("near")).alias("minus"))).alias("b"))
    return best.select("v", (-F.col("b.minus")).alias("spix"), F.col("b.score").alias("score"))


def bcc_cells(points: DataFrame, pitch: float) -> DataFrame:
    """Cells of two interleaved cubic grids, the second half a pitch along: the nearer centre, the first one of equals."""
    out = points
    parts = {}
    for kind, off in ((0, 0.0), (1, 0.5)):
        cell = [F.rint(F.col(a) / pitch - off) for a in ("px", "py", "pz")]
        d = sum(F.pow(F.col(a) - (c + off) * pitch, F.lit(2)) for a, c in zip(("px", "py", "pz"), cell, strict=True))
        parts[kind] = (cell, F.round(d, 6))
    first = parts[0][1] <= parts[1][1]
    names = ("cx", "cy", "cz")
    return out.select("*", *(F.when(first, a).otherwise(b).cast("int").alias(n) for n, a, b in zip(names, parts[0][0], parts[1][0], strict=True)), F.when(first, 0).otherwise(1).alias("grid"))


def voxel_means(points: DataFrame, size: float) -> DataFrame:
    """Means of positions and colours of the points in each cube of that size."""
    cube = [F.floor(F.col(a) / size).cast("int").alias(n) for a, n in (("px", "vx"), ("py", "vy"), ("pz", "vz"))]
    return points.groupBy(*cube).agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in ("px", "py", "pz", "f0", "f1", "f2")))


def voxel_neighbours(voxels: DataFrame) -> DataFrame:
    """Pairs of occupied cubes that touch, each once: half of the 26 offsets, exploded, and an equi-join."""
    half = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if (x, y, z) > (0, 0, 0)]
    offsets = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z")) for x, y, z in half))
    away = voxels.select("vx", "vy", "vz", F.explode(offsets).alias("o")).select("vx", "vy", "vz", (F.col("vx") + F.col("o.x")).alias("wx"), (F.col("vy") + F.col("o.y")).alias("wy"), (F.col("vz") + F.col("o.z")).alias("wz"))
    return away.join(voxels.select(F.col("vx").alias("wx"), F.col("vy").alias("wy"), F.col("vz").alias("wz")), ["wx", "wy", "wz"])
