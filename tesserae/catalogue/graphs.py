"""Queries over graphs, meshes, points and experiment tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import graph
from ..plans import loops
from ..sources.testdata import EDGE, FACE, VERTEX, edges, faces, vertices

QUERIES: dict = {}
ORACLES: dict = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rnd(df, digits, *names):
    return df.withColumns({n: F.round(n, digits) + F.lit(0.0) for n in names})


def stored_graph(spark, d):
    """Edges and vertices, each made once however often a plan reads them."""
    e = loops.stored(edges(spark, d), "edges")
    return e, loops.stored(vertices(spark, d, e), "vertices")


FE = FACE + ", fe AS (SELECT DISTINCT f, least(p, q) AS u, greatest(p, q) AS v FROM (SELECT f, a AS p, b AS q FROM face UNION ALL SELECT f, b, c FROM face UNION ALL SELECT f, a, c FROM face) WHERE p <> q)"
ADJ = EDGE + ", adj AS (SELECT u, v FROM edge UNION ALL SELECT v, u FROM edge)"
VADJ = VERTEX + ", adj AS (SELECT u, v FROM edge UNION ALL SELECT v, u FROM edge)"


@register(f"WITH {FE} SELECT DISTINCT u, v FROM fe")
def unique_edges(spark, d):
    return graph.unique_edges(faces(spark, d))


@register(f"WITH {ADJ} SELECT u AS v, count(*) AS degree FROM adj GROUP BY u")
def csr_degrees(spark, d):
    return graph.degrees(edges(spark, d))


@register(f"WITH {ADJ}, g AS (SELECT u AS v, count(*) AS degree FROM adj GROUP BY u) SELECT v, degree, CAST(sum(degree) OVER (ORDER BY v) AS BIGINT) AS stop FROM g")
def prefix_offsets(spark, d):
    return graph.prefix_offsets(edges(spark, d))


@register(f"WITH {EDGE} SELECT u, v FROM edge")
def csr_roundtrip(spark, d):
    return graph.from_both_ways(graph.both_ways(edges(spark, d)))


@register(f"WITH {FE} SELECT u, v, count(*) AS n, string_agg(CAST(f AS VARCHAR), ',' ORDER BY f) AS faces FROM fe GROUP BY u, v")
def rle_edges(spark, d):
    return graph.edge_runs(faces(spark, d)).withColumn("faces", F.array_join(F.transform("faces", lambda f: f.cast("string")), ","))


@register(f"WITH {FE} SELECT u, v, count(*) AS n FROM fe GROUP BY u, v HAVING count(*) > 2")
def nonmanifold_edges(spark, d):
    return graph.non_manifold(faces(spark, d))


@register(f"""WITH {FE}, r AS (SELECT f, row_number() OVER (PARTITION BY u, v ORDER BY f) AS k FROM fe), x AS (SELECT DISTINCT f FROM r WHERE k > 2), top AS (SELECT greatest(max(a), max(b), max(c)) + 1 AS top FROM face)
    SELECT face.f, CAST(CASE WHEN x.f IS NULL THEN a ELSE top + 3 * face.f END AS INTEGER) AS a, CAST(CASE WHEN x.f IS NULL THEN b ELSE top + 3 * face.f + 1 END AS INTEGER) AS b, CAST(CASE WHEN x.f IS NULL THEN c ELSE top + 3 * face.f + 2 END AS INTEGER) AS c FROM face CROSS JOIN top LEFT JOIN x ON x.f = face.f""")
def manifold_repair(spark, d):
    return graph.repaired(faces(spark, d))


@register(f"WITH {FE} SELECT DISTINCT p.f AS f1, q.f AS f2 FROM fe p JOIN fe q ON p.u = q.u AND p.v = q.v AND p.f < q.f")
def dual_edges(spark, d):
    return graph.dual_edges(faces(spark, d))


@register(f"WITH {FACE}, c AS (SELECT f, unnest([a, b, c]) AS v FROM face) SELECT f, round(avg(v % 17), 6) AS px, round(avg(v % 31), 6) AS f0 FROM c GROUP BY f")
def dual_vertices(spark, d):
    f = faces(spark, d)
    v = f.select(F.explode(F.array("a", "b", "c")).alias("v")).distinct().select("v", (F.col("v") % 17).cast("double").alias("px"), (F.col("v") % 31).cast("double").alias("f0"))
    return rnd(graph.dual_vertices(f, v, ("px", "f0")), 6, "px", "f0")


@register(f"WITH {VADJ} SELECT a.u AS v, bool_or(p.spix <> q.spix) AS is_border FROM adj a JOIN vertex p ON p.v = a.u JOIN vertex q ON q.v = a.v GROUP BY a.u")
def graph_border(spark, d):
    return graph.graph_border(edges(spark, d), vertices(spark, d))


@register(f"WITH {VADJ}, b AS (SELECT a.u AS v, bool_or(p.spix <> q.spix) AS k FROM adj a JOIN vertex p ON p.v = a.u JOIN vertex q ON q.v = a.v GROUP BY a.u) SELECT e.u, e.v, p.spix FROM edge e JOIN vertex p ON p.v = e.u JOIN vertex q ON q.v = e.v JOIN b x ON x.v = e.u AND x.k JOIN b y ON y.v = e.v AND y.k WHERE p.spix = q.spix")
def border_edges(spark, d):
    return graph.border_edges(edges(spark, d), vertices(spark, d))


@register(f"WITH {FACE}, c AS (SELECT DISTINCT f, unnest([a, b, c]) AS v FROM face), k AS (SELECT v, f % 5 AS spix, count(*) AS n FROM c GROUP BY ALL) SELECT v, CAST(arg_max(spix, row(n, -spix)) AS INTEGER) AS spix FROM k GROUP BY v")
def label_vote(spark, d):
    f = faces(spark, d)
    return graph.label_vote(f, f.select("f", (F.col("f") % 5).alias("spix")))


@register(f"""WITH {VADJ}, own AS (SELECT a.u, a.v FROM adj a JOIN vertex p ON p.v = a.u JOIN vertex q ON q.v = a.v WHERE p.spix = q.spix),
    pair AS (SELECT x.u AS c, x.v AS p, y.v AS q FROM own x JOIN own y ON x.u = y.u AND x.v < y.v),
    j AS (SELECT c, p, q, EXISTS (FROM own o WHERE o.u = pair.p AND o.v = pair.q) OR EXISTS (FROM own o JOIN own r ON r.u = o.v WHERE o.u = pair.p AND r.v = pair.q AND o.v <> pair.c) AS ok FROM pair)
    SELECT vertex.v, coalesce(bool_and(ok), true) AS is_simple FROM vertex LEFT JOIN j ON j.c = vertex.v GROUP BY vertex.v""")
def two_hop_simple(spark, d):
    return graph.removable(*stored_graph(spark, d))


_AX = ("px", "py", "pz")
_M3 = "count(*) AS n, " + ", ".join(f"sum({a}) AS s_{a}" for a in _AX) + ", " + ", ".join(f"sum(f{i}) AS s_f{i}" for i in range(3)) + ", " + ", ".join(f"sum({a} * {b}) AS s_{a}{b}" for i, a in enumerate(_AX) for b in _AX[i:])


@register(f"WITH {VERTEX} SELECT spix, {_M3} FROM vertex GROUP BY spix")
def moments3d(spark, d):
    return graph.moments3d(vertices(spark, d))


def _cov(a: str, b: str) -> str:
    return f"({'10000.0' if a == b else '0.0'} + s_{a}{b} - n * (s_{a} / n) * (s_{b} / n)) / (n + 5000.0 - 3)" if a != b else f"(10000.0 + s_{a}{b} - n * (s_{a} / n) * (s_{b} / n)) / (n + 5000.0 - 3)"


P3 = VERTEX + f""", m AS (SELECT spix, {_M3} FROM vertex GROUP BY spix), cv AS (SELECT *, {', '.join(f'{_cov(a, b)} AS {a[1]}{b[1]}' for i, a in enumerate(_AX) for b in _AX[i:])} FROM m),
    dt AS (SELECT *, xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz) AS det FROM cv),
    par AS (SELECT spix, n, s_px / n AS m_px, s_py / n AS m_py, s_pz / n AS m_pz, s_f0 / n AS m_f0, s_f1 / n AS m_f1, s_f2 / n AS m_f2, (yy * zz - yz * yz) / det AS ixx, (xx * zz - xz * xz) / det AS iyy, (xx * yy - xy * xy) / det AS izz,
        (xz * yz - xy * zz) / det AS ixy, (xy * yz - xz * yy) / det AS ixz, (xy * xz - xx * yz) / det AS iyz, ln(det) AS logdet FROM dt)"""
_P3 = ["ixx", "iyy", "izz", "ixy", "ixz", "iyz", "logdet"]


@register(f"WITH {P3} SELECT spix, n, round(m_px, 6) AS m_px, round(m_f0, 6) AS m_f0, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in _P3)} FROM par")
def params3d(spark, d):
    p = graph.params3d(graph.moments3d(vertices(spark, d)), 10)
    return rnd(p, 6, "m_px", "m_f0", *_P3).select("spix", "n", "m_px", "m_f0", *_P3)


_D = [f"(a.{x} - p.m_{x})" for x in _AX]


@register(f"""WITH {P3}, adj AS (SELECT u, v FROM edge UNION ALL SELECT v, u FROM edge), nb AS (SELECT a.u AS v, q.spix AS near FROM adj a JOIN vertex q ON q.v = a.v WHERE a.u % 3 = 0), k AS (SELECT v, near, count(*) AS k, sum(count(*)) OVER (PARTITION BY v) AS deg FROM nb GROUP BY v, near),
    s AS (SELECT k.v, near, round(-(pow(a.f0 - m_f0, 2) + pow(a.f1 - m_f1, 2) + pow(a.f2 - m_f2, 2)) / 50.0 - ({_D[0]} * {_D[0]} * ixx + {_D[1]} * {_D[1]} * iyy + {_D[2]} * {_D[2]} * izz + 2 * ({_D[0]} * {_D[1]} * ixy + {_D[0]} * {_D[2]} * ixz + {_D[1]} * {_D[2]} * iyz)) - logdet - 0.5 * (deg - k.k), 6) AS score FROM k JOIN vertex a ON a.v = k.v JOIN par p ON p.spix = near)
    SELECT v, arg_max(near, row(score, -near)) AS spix, max(score) AS score FROM s GROUP BY v""")
def estep3d_one_color(spark, d):
    v = vertices(spark, d)
    return graph.update3d(edges(spark, d), v, graph.params3d(graph.moments3d(v), 10), 50.0, 0.5, F.col("v") % 3 == 0)


def _bcc(off: str) -> str:
    return " + ".join(f"pow({a} - (round_even({a} / 5.0 - {off}, 0) + {off}) * 5.0, 2)" for a in _AX)


@register(f"""WITH {VERTEX}, g AS (SELECT v, round({_bcc('0.0')}, 6) AS d0, round({_bcc('0.5')}, 6) AS d1, px, py, pz FROM vertex)
    SELECT v, {', '.join(f'CAST(CASE WHEN d0 <= d1 THEN round_even({a} / 5.0, 0) ELSE round_even({a} / 5.0 - 0.5, 0) END AS INTEGER) AS c{a[1]}' for a in _AX)}, CASE WHEN d0 <= d1 THEN 0 ELSE 1 END AS grid FROM g""")
def bcc_init(spark, d):
    return graph.bcc_cells(vertices(spark, d), 5.0).select("v", "cx", "cy", "cz", "grid")


VOX = VERTEX + ", vox AS (SELECT CAST(floor(px / 4.0) AS INTEGER) AS vx, CAST(floor(py / 4.0) AS INTEGER) AS vy, CAST(floor(pz / 4.0) AS INTEGER) AS vz, * FROM vertex)"


@register(f"WITH {VOX} SELECT vx, vy, vz, count(*) AS n, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in ("px", "py", "pz", "f0", "f1", "f2")) + " FROM vox GROUP BY vx, vy, vz")
def voxel_mean(spark, d):
    return rnd(graph.voxel_means(vertices(spark, d), 4.0), 6, "px", "py", "pz", "f0", "f1", "f2")


@register(f"WITH {VOX}, o AS (SELECT DISTINCT vx, vy, vz FROM vox) SELECT a.vx, a.vy, a.vz, b.vx AS wx, b.vy AS wy, b.vz AS wz FROM o a JOIN o b ON row(b.vx - a.vx, b.vy - a.vy, b.vz - a.vz) > row(0, 0, 0) AND abs(a.vx - b.vx) <= 1 AND abs(a.vy - b.vy) <= 1 AND abs(a.vz - b.vz) <= 1")
def voxel_neighbors(spark, d):
    return graph.voxel_neighbours(graph.voxel_means(vertices(spark, d), 4.0).select("vx", "vy", "vz"))


@register(f"""WITH {VADJ}, n AS (SELECT a.u, count(*) AS n, count(*) FILTER (p.spix <> q.spix) AS k FROM adj a JOIN vertex p ON p.v = a.u JOIN vertex q ON q.v = a.v GROUP BY a.u)
    SELECT u AS v, k <= greatest(1.0, n * 0.2) OR (n - k = 1 AND n >= 2) AS is_simple FROM n""")
def count_simple(spark, d):
    return graph.removable_by_count(edges(spark, d), vertices(spark, d))


_OUT = FE + ", ext AS (SELECT f % 5 AS spix, u, v FROM (SELECT *, count(*) OVER (PARTITION BY f % 5, u, v) AS n FROM fe) WHERE n = 1)"


def _outline(spark, d):
    f = faces(spark, d)
    return graph.exterior_edges(f, f.select("f", (F.col("f") % 5).alias("spix")))


@register(f"WITH {_OUT} SELECT spix, u, v FROM ext")
def exterior_edges(spark, d):
    return _outline(spark, d)


@register(f"WITH {_OUT} SELECT spix, v, count(*) AS n FROM (SELECT spix, u AS v FROM ext UNION ALL SELECT spix, v FROM ext) GROUP BY spix, v")
def exterior_corners(spark, d):
    return graph.exterior_corners(_outline(spark, d))


_TURN = [0.0, -1.0, 0.0, 5.0, 1.0, 0.0, 0.0, -2.0, 0.0, 0.0, 1.0, 0.5, 0.0, 0.0, 0.0, 1.0]


@register(f"WITH {VERTEX} SELECT v, 5.0 - py AS x, px - 2.0 AS y, pz + 0.5 AS z FROM vertex")
def rigid_transform(spark, d):
    p = geometry.rigid((F.col("px"), F.col("py"), F.col("pz")), _TURN)
    return vertices(spark, d).select("v", *(c.alias(n) for n, c in zip("xyz", p, strict=True)))


_DOT, _LA, _LB = "(px * 1.0 + py * 2.0 + pz * 3.0)", "sqrt(px * px + py * py + pz * pz)", "sqrt(14.0::DOUBLE)"
_CR = ("(py * 3.0 - pz * 2.0)", "(pz * 1.0 - px * 3.0)", "(px * 2.0 - py * 1.0)")
_SC = f"(({_LA} + 1e-6) * ({_LB} + 1e-6))"
_AT = f"atan2(sqrt({_CR[0]} * {_CR[0]} + {_CR[1]} * {_CR[1]} + {_CR[2]} * {_CR[2]}) / {_SC}, least(greatest({_DOT} / {_SC}, -1.0), 1.0))"


@register(f"WITH {VERTEX} SELECT v, round(acos(least(greatest({_DOT} / ({_LA} * {_LB} + 1e-6), -1.0), 1.0)), 6) AS plain, round(CASE WHEN {_CR[2]} < 0 THEN 2 * pi() - {_AT} ELSE {_AT} END, 6) AS signed FROM vertex")
def vertex_angles(spark, d):
    zero, to = (F.lit(0.0),) * 3, (F.lit(1.0), F.lit(2.0), F.lit(3.0))
    p = (F.col("px"), F.col("py"), F.col("pz"))
    up = (F.lit(0.0), F.lit(0.0), F.lit(1.0))
    return vertices(spark, d).select("v", F.round(geometry.angle(zero, p, to), 6).alias("plain"), F.round(geometry.signed_angle(zero, p, to, up), 6).alias("signed"))


_MARKS = FE + """, cor AS (SELECT f, unnest([0, 1, 2]) AS k, unnest([a, b, c]) AS p, unnest([b, c, a]) AS q FROM face), ranked AS (SELECT f, k, p, dense_rank() OVER (PARTITION BY least(p, q), greatest(p, q) ORDER BY f) AS nth FROM cor WHERE p <> q),
    top AS (SELECT max(greatest(a, b, c)) + 1 AS top FROM face), mark AS (SELECT f, k, p AS old, CAST(top + row_number() OVER (ORDER BY f, k) - 1 AS INTEGER) AS new FROM ranked, top WHERE nth > 2),
    wide AS (SELECT face.f, a, b, c, max(new) FILTER (k = 0) AS n0, max(new) FILTER (k = 1) AS n1, max(new) FILTER (k = 2) AS n2 FROM face LEFT JOIN mark ON mark.f = face.f GROUP BY face.f, a, b, c)"""


def _corners(spark, d):
    f = faces(spark, d)
    return f, f.select(F.explode(F.array("a", "b", "c")).alias("v")).distinct().withColumn("px", F.col("v") % 17)


@register(f"WITH {_MARKS} SELECT f, coalesce(n0, a) AS a, coalesce(n1, b) AS b, coalesce(n2, c) AS c FROM wide")
def repaired_faces(spark, d):
    """Faces after the corner that begins a crowded edge has become a new vertex."""
    return graph.repaired_mesh(*_corners(spark, d))[0]


@register(f"WITH {_MARKS} SELECT v, v % 17 AS px FROM (SELECT a AS v FROM face UNION SELECT b FROM face UNION SELECT c FROM face) UNION ALL SELECT new, old % 17 FROM mark")
def repaired_vertices(spark, d):
    return graph.repaired_mesh(*_corners(spark, d))[1]


@register(f"""WITH {_MARKS}, more AS (SELECT n0 AS v, unnest([b, c]) AS u FROM wide WHERE n0 IS NOT NULL UNION ALL SELECT n1, unnest([c, coalesce(n0, a)]) FROM wide WHERE n1 IS NOT NULL UNION ALL SELECT n2, unnest([coalesce(n0, a), coalesce(n1, b)]) FROM wide WHERE n2 IS NOT NULL)
    SELECT u, v FROM fe GROUP BY u, v UNION ALL SELECT least(u, v), greatest(u, v) FROM more""")
def repaired_edges(spark, d):
    return graph.repaired_mesh(*_corners(spark, d))[2]


@register(f"""WITH RECURSIVE {VADJ}, near AS (SELECT a.u, a.v, p.spix = q.spix AS same FROM adj a JOIN vertex p ON p.v = a.u JOIN vertex q ON q.v = a.v),
    b AS (SELECT u, count(*) FILTER (same) AS k FROM near GROUP BY u HAVING count(*) FILTER (NOT same) > 0), own AS (SELECT u, max(v) AS first, min(v) AS least FROM near WHERE same GROUP BY u),
    walk(v, goal, prev, place, step) AS (SELECT b.u, least, b.u, first, 0 FROM b JOIN own ON own.u = b.u WHERE k = 2
        UNION ALL SELECT w.v, w.goal, w.place, n.nx, w.step + 1 FROM walk w, LATERAL (SELECT max(near.v) AS nx FROM near WHERE near.u = w.place AND same AND near.v <> w.prev) n WHERE w.place <> w.goal AND w.step < 32 AND n.nx IS NOT NULL)
    SELECT b.u AS v, coalesce(bool_or(place = goal), false) AS is_simple FROM b LEFT JOIN walk ON walk.v = b.u GROUP BY b.u""")
def ring_simple(spark, d):
    """Border vertices around which a walk inside the label leads."""
    from ..plans import mesh

    return mesh.ring_walks(*stored_graph(spark, d))
