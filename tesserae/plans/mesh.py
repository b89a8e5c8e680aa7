"""Iterative plans over graphs: colouring, flood fill, vertex rings of a dual mesh, the mesh region driver."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.algebra import hash_unit
from ..operators.graph import both_ways, moments3d, params3d, running_total, update3d
from .loops import components, spread, stored


def coloured(edges: DataFrame, seed: int = 123) -> DataFrame:
    """v and colour: in each round the vertices of highest priority (degree, then a hash, then id) among their uncoloured
    neighbours take the least colour that no neighbour has."""
    once = stored(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct(), "edges")
    ends = both_ways(once)
    rank = F.struct("degree", hash_unit(F.lit(seed), F.col("u")).alias("h"), "u")
    left = stored(ends.groupBy("u").agg(F.count("*").alias("degree")).select(F.col("u").alias("v"), rank.alias("rank")), "ranks")
    pairs = once.join(left.select(F.col("v").alias("u"), F.col("rank").alias("a")), "u").join(left.select("v", F.col("rank").alias("b")), "v")
    after = F.col("a") < F.col("b")
    # each edge once: v waits for the colour of its neighbour of higher priority
    waits = stored(pairs.select(F.when(after, F.col("u")).otherwise(F.col("v")).alias("v"), F.when(after, F.col("v")).otherwise(F.col("u")).alias("on"), F.lit(None).cast("int").alias("colour")), "waits")
    left, done = left.select("v"), []
    lone = left.join(waits.select("v").distinct(), "v", "left_anti").select("v", F.lit(0).alias("colour"))
    while True:
        done.append(stored(lone, "colours"))
        waits = waits.join(done[-1].select("v"), "v", "left_anti")
        if waits.isEmpty():
            break
        now = done[-1].select(F.col("v").alias("on"), F.col("colour").alias("told"))
        waits = stored(waits.join(now, "on", "left").select("v", "on", F.coalesce("colour", "told").alias("colour")), "waits")
        used = waits.groupBy("v").agg(F.bool_and(F.col("colour").isNotNull()).alias("ready"), F.collect_set("colour").alias("used")).where("ready")
        lone = used.select("v", F.expr("array_min(array_except(sequence(0, cardinality(used)), used))").alias("colour"))
    return reduce(DataFrame.union, done)


def flood_filled(edges: DataFrame, cells: DataFrame, points: DataFrame) -> DataFrame:
    """v and spix: from the vertex nearest to each cell's centroid the cell spreads over its own vertices; pieces that
    it doesn't reach get regions of their own. Regions are numbered by their least vertex.

    cells: v and cell; points: v, px, py, pz.
    """
    own = stored(edges.join(cells.select(F.col("v").alias("u"), F.col("cell").alias("a")), "u").join(cells.select("v", F.col("cell").alias("b")), "v").where("a = b").select("u", "v"), "own")
    pieces = components(own).select(F.col("id").alias("v"), "component")
    axes = ("px", "py", "pz")
    placed = points.select("v", *axes, F.lit(True).alias("placed"))
    full = stored(cells.join(pieces, "v", "left").select("v", "cell", F.coalesce("component", "v").alias("piece")).join(placed, "v", "left"), "pieces")
    centre = full.where("placed").groupBy("cell").agg(*(F.avg(a).alias(f"m_{a}") for a in axes))
    far = full.where("placed").join(centre, "cell")
    d2 = F.round(sum(F.pow(F.col(a) - F.col(f"m_{a}"), F.lit(2)) for a in axes), 9)
    seeds = far.groupBy("cell").agg(F.min(F.struct(d2.alias("d"), "v", "piece"))["piece"].alias("main"))
    first = full.groupBy("piece").agg(F.min("v").alias("least"))
    numbered = running_total(first, "least", F.lit(1), "k").select("piece", (F.col("k") - 1).cast("int").alias("spix"))
    return full.join(numbered, "piece").join(seeds, "cell", "left").select("v", "spix", (F.col("piece") == F.col("main")).alias("reached"))


def vertex_rings(faces: DataFrame) -> DataFrame:
    """v and ring: the faces around each vertex in order, for vertices whose faces close to a ring (dual polygons)."""
    corners = faces.select("f", F.explode(F.array(*(F.struct(F.col(p).alias("v"), F.least(q, r).alias("p"), F.greatest(q, r).alias("q")) for p, q, r in (("a", "b", "c"), ("b", "a", "c"), ("c", "a", "b"))))).alias("k")).select("f", "k.v", "k.p", "k.q")

    near = F.sort_array(F.collect_list(F.struct("f", "p", "q")))
    each = spread(corners, "v").groupBy("v").agg(near.alias("k")).select("v", "k.f", "k.p", "k.q")
    # where every neighbour has two faces there are as many neighbours as faces
    maybe = each.where(F.size(F.array_distinct(F.concat("p", "q"))) == F.size("f"))

    def rings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(v, ring) for v, f, p, q in zip(batch["v"], batch["f"], batch["p"], batch["q"], strict=True) if (ring := _ring(f.tolist(), p.tolist(), q.tolist()))]
            if found:
                yield pd.DataFrame(found, columns=["v", "ring"])

    return maybe.mapInPandas(rings, "v int, ring array<int>")


def _ring(faces: list[int], p: list[int], q: list[int]) -> list[int] | None:
    """The faces in the order of a walk from the first one over the neighbours that two of them share; None if the walk
    doesn't close, or not around all."""
    at: dict[int, list[tuple[int, int]]] = {}
    for f, a, b in zip(faces, p, q, strict=True):
        at.setdefault(a, []).append((f, b))
        at.setdefault(b, []).append((f, a))
    if any(len(x) != 2 for x in at.values()):
        return None
    here, last, out = p[0], None, {}
    while True:
        f, there = next((x for x in at[here] if x[0] != last), (None, None))
        if f is None or f in out:
            break
        out[f] = None
        here, last = there, f
    return list(out) if len(out) == len(faces) and here == p[0] else None


def ring_walks(edges: DataFrame, vertices: DataFrame, most: int = 32) -> DataFrame:
    """v and is_simple of each vertex beside another label: whether a walk inside its label leads around it.

    Only a vertex with exactly two neighbours of its label can be simple. The walk goes from the larger to the smaller one,
    each time to the largest neighbour of the label but the one it came from, in at most so many steps. A vertex is
    reduced to its two largest neighbours first, so a step is one join by vertex, whatever the degrees.
    """
    lab = vertices.select("v", "spix")
    ends = edges.join(lab.select(F.col("v").alias("u"), F.col("spix").alias("own")), "u").join(lab, "v")
    near = stored(ends.select("u", "v", (F.col("own") == F.col("spix")).alias("alike")).where("alike IS NOT NULL"), "near")
    near = both_ways(near, "alike")
    border = near.groupBy("u").agg(F.count_if(~F.col("alike")).alias("unlike"), F.count_if("alike").alias("like")).where("unlike > 0").select("u", "like")
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("v")))
    two = near.where("alike").select("u", "v", rank.alias("k")).where("k <= 2")
    tops = stored(two.groupBy("u").agg(F.max("v").alias("first"), F.max(F.when(F.col("k") == 2, F.col("v"))).alias("second")), "tops")
    border = stored(border, "border")
    walks = border.where("like = 2").join(tops, "u").select(F.col("u").alias("v"), F.col("second").alias("goal"), F.col("u").alias("prev"), F.col("first").alias("at"))
    there = F.col("at") == F.col("goal")
    for step in range(most):
        nexts = walks.join(tops.select(F.col("u").alias("at"), "first", "second"), "at").withColumn("next", F.when(F.col("first") == F.col("prev"), F.col("second")).otherwise(F.col("first")))
        walks = nexts.where(there | F.col("next").isNotNull()).select("v", "goal", F.when(there, F.col("prev")).otherwise(F.col("at")).alias("prev"), F.when(there, F.col("at")).otherwise(F.col("next")).alias("at"))
        if step % 4 == 3:
            walks = stored(walks, "walks")
            if walks.where(~there).isEmpty():
                break
    found = walks.where(there).select("v", F.lit(True).alias("is_simple"))
    return border.select(F.col("u").alias("v")).join(found, "v", "left").select("v", F.coalesce("is_simple", F.lit(False)).alias("is_simple"))


def ring_from_least(ring: Column) -> Column:
    """The same ring from its least face on, towards the lesser of the two faces beside it."""
    n, k = F.size(ring), F.array_position(ring, F.array_min(ring)).cast("int")
    turned = F.concat(F.slice(ring, k, n - k + 1), F.slice(ring, F.lit(1), k - 1))
    back = F.concat(F.slice(turned, 1, 1), F.reverse(F.slice(turned, F.lit(2), n)))
    return F.when((n > 2) & (F.get(turned, n - 1) < F.get(turned, F.lit(1))), back).otherwise(turned)


def outlines(outline: DataFrame, points: DataFrame) -> DataFrame:
    """spix and path: the vertices of each region's outline from its least one on, at each step the one that goes
    straightest ahead (of equals the least), until no neighbour is left."""
    ends = outline.join(points.select(F.col("v").alias("u"), *(F.col(a).alias(f"u{a}") for a in ("px", "py", "pz"))), "u").join(points.select("v", *(F.col(a).alias(f"v{a}") for a in ("px", "py", "pz"))), "v")

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        place, near = {}, {}
        for r in part.itertuples():
            place[r.u], place[r.v] = np.array([r.upx, r.upy, r.upz]), np.array([r.vpx, r.vpy, r.vpz])
            near.setdefault(r.u, set()).add(r.v)
            near.setdefault(r.v, set()).add(r.u)
        path, ahead = [min(place)], np.zeros(3)
        seen = set(path)
        while left := [v for v in sorted(near[path[-1]]) if v not in seen]:
            steps = [place[v] - place[path[-1]] for v in left]
            k = max(range(len(left)), key=lambda i: (float(steps[i] @ ahead) / (np.linalg.norm(steps[i]) + 1e-6), -i))
            ahead = steps[k] / (np.linalg.norm(steps[k]) + 1e-6)
            path.append(left[k])
            seen.add(left[k])
        return pd.DataFrame({"spix": [int(part["spix"].iloc[0])], "path": [[int(v) for v in path]]})

    return ends.groupBy("spix").applyInPandas(walk, "spix int, path array<int>")


def segment_mesh(edges: DataFrame, vertices: DataFrame, rounds: int | None = None, side: int = 25, sigma2: float = 50.0, potts: float = 0.5, passes: int = 4) -> DataFrame:
    """v and spix after so many rounds (side of them if not given), each of parameters and then so many passes of label
    updates colour by colour. vertices: v, px-z, f0-2, spix.

    A pass that changes no label ends its round, and a round that changes none ends all: what would follow changes nothing.
    """
    edges = stored(edges, "edges")
    colours = coloured(edges)
    vertices = stored(vertices.join(colours, "v", "left").fillna(0, ["colour"]), "mesh")
    top = vertices.agg(F.max("colour")).first()[0] or 0
    part = _Part(edges, vertices) if top else None
    for _ in range(side if rounds is None else rounds):
        p = stored(params3d(moments3d(vertices), side), "mesh")
        mine = part.taken(vertices) if part else vertices
        for k in range(passes):
            moved = False
            for colour in range(top + 1):
                new = update3d(part.edges if part else edges, mine, p, sigma2, potts, (F.col("colour") == colour) & (F.col("inside") if part else F.lit(True))).select("v", F.col("spix").alias("new"))
                changed = stored(mine.join(new, "v").where("NOT new <=> spix").select("v", "new"), "changed")
                if not changed.isEmpty():
                    moved = True
                    mine = stored(mine.join(changed, "v", "left").withColumn("spix", F.coalesce("new", "spix")).drop("new"), "mesh")
                    if part:
                        mine = part.grown(changed, mine, vertices)
            if not moved:
                break
        now = mine.select("v", F.col("spix").alias("new"))
        vertices = stored(vertices.join(now, "v", "left").withColumn("spix", F.coalesce("new", "spix")).drop("new"), "mesh")
        if not k:
            break
    return vertices.select("v", "spix")


class _Part:
    """The part of a mesh where labels can change: the vertices inside have or had a neighbour of another label, or one that
    changed. edges are all those with an end inside; the vertices at their other ends are read only.

    A vertex whose neighbours all have its own label keeps it, so leaving it out changes nothing.
    """

    def __init__(self, edges: DataFrame, vertices: DataFrame):
        self.all = edges
        lab = vertices.select("v", "spix")
        both = edges.join(lab.select(F.col("v").alias("u"), F.col("spix").alias("own")), "u").join(lab, "v").where("NOT own <=> spix")
        self.inside = stored(both.select("u").union(both.select("v")).distinct().withColumnRenamed("u", "v"), "inside")
        self.edges = self._at(self.inside)

    def _at(self, some: DataFrame) -> DataFrame:
        """The edges with an end among some vertices."""
        marks = some.select("v", F.lit(True).alias("mark"))
        both = self.all.join(marks.select(F.col("v").alias("u"), F.col("mark").alias("a")), "u", "left").join(marks, "v", "left")
        return stored(both.where("a OR mark").select("u", "v"), "edges")

    def taken(self, vertices: DataFrame) -> DataFrame:
        """The rows of vertices that the edges need, with inside."""
        ends = both_ways(self.edges).select(F.col("u").alias("v")).distinct()
        return stored(vertices.join(ends, "v", "left_semi").join(self.inside.withColumn("inside", F.lit(True)), "v", "left").fillna(False, ["inside"]), "mesh")

    def grown(self, changed: DataFrame, mine: DataFrame, vertices: DataFrame) -> DataFrame:
        """mine with the neighbours of changed vertices inside, and what their edges need."""
        near = both_ways(self.edges).join(changed.select("v"), "v", "left_semi").select(F.col("u").alias("v")).distinct()
        fresh = stored(near.join(self.inside, "v", "left_anti"), "inside")
        if fresh.isEmpty():
            return mine
        more = self._at(fresh)
        for end in ("u", "v"):  # without those that are there
            more = more.join(self.inside.withColumnRenamed("v", end), end, "left_anti")
        self.edges = stored(self.edges.union(more.select("u", "v")), "edges")
        self.inside = stored(self.inside.union(fresh), "inside")
        kept = mine.select("v", F.col("spix").alias("new"))
        return stored(self.taken(vertices).join(kept, "v", "left").withColumn("spix", F.coalesce("new", "spix")).drop("new"), "mesh")
