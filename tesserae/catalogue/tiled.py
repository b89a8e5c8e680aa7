"""Queries over frames cut to tiles: the results of the whole-frame kernels, from tiles and their halos."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import regions
from ..plans import loops, tiles
from ..plans.frame import Options
from ..plans.tiles import Grid
from ..sources.testdata import HEIGHT, SEG, WIDTH, bands, pixels, segments
from . import plans, scores
from .pixels import holes

QUERIES: dict = {}
ORACLES: dict = {}
#: Tiles that no region fits into.
GRID = Grid(HEIGHT, WIDTH, 16)


def register(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _tiles(seg, halo: int):
    return loops.cut(tiles.widened(tiles.tiled(seg, GRID, {"labels": ["spix"], "image": ["c0", "c1", "c2"]}), GRID, halo))


def _fitted(cut, halo: int, propagated: bool = False):
    """Parameters under round priors of 25 pixels."""
    stats = tiles.sums_by_region(cut, GRID, halo)
    shapes = [F.lit(v).alias(f"{m}{k}") for m in "kv" for k, v in (("xx", 1.0), ("xy", 0.0), ("yy", 1.0))]
    priors = stats.select("video", "t", "spix", F.lit(25.0).alias("prior_count"), *shapes, F.lit(propagated).alias("propagated"))
    return loops.cut(regions.conditioned_parameters(stats, priors, 5, False))


@register(plans.ORACLES["estep_kernel"])
def estep_tiles(spark, d):
    """One phase of border moves on tiles."""
    cut = _tiles(segments(spark, d), 2)
    return tiles.unpacked(tiles.moved_borders(cut, GRID, _fitted(cut, 2), 2, 100.0, 10.0, 1, ((0, 0),)), GRID).select("t", "y", "x", "spix")


@register(plans.ORACLES["merge_kernel"])
def merge_tiles(spark, d):
    """One round of merges, downwards, on tiles."""
    cut = _tiles(plans.unit(segments(spark, d)), 0)
    return tiles.unpacked(tiles.merge(cut, GRID, 0, Options(sp_size=5), "s")[0], GRID).select("t", "y", "x", "spix")


@register(plans.ORACLES["components_8"])
def components_tiles(spark, d):
    """8-connected pieces, found in tiles and joined across their borders."""
    seg = pixels(spark, d).select("t", "y", "x", F.expr("cast(c1 % 9 AS int)").alias("spix"))
    return tiles.components_8(seg, GRID).select("t", "y", "x", "spix")


@register(plans.ORACLES["largest_pieces"])
def largest_pieces_tiles(spark, d):
    seg = pixels(spark, d).select("t", "y", "x", F.expr("cast(c1 % 9 AS int)").alias("spix"))
    cut = loops.cut(tiles.tiled(seg, GRID, {"labels": ["spix"]}))
    return tiles.unpacked(tiles.largest_pieces(cut, GRID), GRID).select("t", "y", "x", "spix")


@register(plans.ORACLES["fill_missing_full"])
def fill_tiles(spark, d):
    """Holes that go over several tiles, filled from their edges inwards."""
    return tiles.fill_missing(holes(spark, d), GRID).select("t", "y", "x", "spix")


@register(f"WITH {SEG} SELECT t, y, x, CAST(abs(x % 5 - 1) + abs(y % 5 - 2) AS INTEGER) AS near, CAST(abs(x % 5 - 3) + abs(y % 5 - 2) AS INTEGER) AS far FROM seg")
def geodesic_tiles(spark, d):
    """Steps inside each square from two seeds beside its centre, over the borders of tiles."""
    cut = _tiles(segments(spark, d), 0)
    walked = loops.cut(tiles.distances(cut, GRID, tiles.split_seeds(_fitted(cut, 0), 1, GRID)))
    near, far = (tiles.unpacked(walked, GRID, n, n) for n in ("near", "far"))
    return near.join(far, ["video", "t", "y", "x"]).select("t", "y", "x", "near", "far")


_SIDES = SEG + """, cut AS (SELECT t, y, x, spix, c0 / 255 AS c0, c1 / 255 AS c1, c2 / 255 AS c2, {moved} AS moved, {lost} AS lost FROM seg),
    mom AS (SELECT t, spix, moved, count(*) AS n, count(*) FILTER (lost) AS lost, """ + ", ".join(f"sum(c{i}) AS s{i}, sum(c{i} * c{i}) AS q{i}" for i in range(3)) + """ FROM cut GROUP BY ALL),
    b AS (SELECT k.t, k.spix, k.lost AS k_lost, s.lost AS s_lost, """ + ", ".join(f"k.{c} AS k_{c}, s.{c} AS s_{c}" for c in scores._COLS) + f""" FROM mom k JOIN mom s ON k.t = s.t AND k.spix = s.spix AND NOT k.moved AND s.moved),
    g AS (SELECT *, {scores._m('k_')} + {scores._m('s_')} - {scores._m('k_', 's_')} AS gain, s_lost < k_lost AS other, CASE WHEN s_lost < k_lost THEN s_lost / s_n ELSE k_lost / k_n END AS share FROM b)"""


def _split_sql(moved: str, lost: str, accept: str, swap: str) -> str:
    return "WITH " + _SIDES.format(moved=moved, lost=lost) + f""", ok AS (SELECT t, spix, other, row_number() OVER (PARTITION BY t ORDER BY spix) AS k FROM g WHERE {accept}), top AS (SELECT t, max(spix) AS top FROM seg GROUP BY t)
    SELECT cut.t, y, x, CAST(CASE WHEN ok.t IS NOT NULL AND moved <> ({swap}) THEN top + k ELSE cut.spix END AS INTEGER) AS spix FROM cut JOIN top ON top.t = cut.t LEFT JOIN ok ON ok.t = cut.t AND ok.spix = cut.spix"""


@register(_split_sql("x % 5 > 2", "false", "gain - 4.4 > -2", "false"))
def split_labels(spark, d):
    """Labels after one round of splits along x: the columns nearer to the second seed go where the colours call for it."""
    halo = 0
    cut = _tiles(plans.unit(segments(spark, d)), halo)
    out, _ = tiles.split(cut, GRID, halo, _fitted(cut, halo), Options(sp_size=5, split_alpha=-4.4), 1)
    return tiles.unpacked(out, GRID).select("t", "y", "x", "spix")


_WIDE = _split_sql("x % 10 > 4", "(x + 3 * y + t) % 7 < 3", "gain + 23 - 40 * (1 - share) > -2 AND k_n + s_n >= 64", "other").replace("(y // 5) * 10 + x // 5", "(y // 10) * 5 + x // 10")


@register(_WIDE)
def split_labels_propagated(spark, d):
    """The same along x for regions from a frame before: a cut pays for the valid share of the part that keeps the id, which
    is the one with fewer pixels that came into view."""
    seg = plans.unit(segments(spark, d, 10)).withColumn("lost", F.expr("cast((x + 3 * y + t) % 7 < 3 AS int)"))
    cut = _tiles(seg, 0)
    lost = loops.cut(tiles.tiled(seg, GRID, {"invalid": ["lost"]}))
    out, _ = tiles.split(cut, GRID, 0, _fitted(cut, 0, True), Options(sp_size=10, split_alpha=23.0, gamma=40.0), 1, lost)
    return tiles.unpacked(out, GRID).select("t", "y", "x", "spix")


@register(plans._BAND_COLOURS)
def segment_tiles(spark, d):
    """Three whole rounds on tiles (a split, a merge, border moves): regions end where the bands do, and are few."""
    px = bands(spark, d)
    return plans.region_colours(tiles.segment_tiled(px, GRID, Options(sp_size=7, niters=3, sigma_app=0.02)), px)
