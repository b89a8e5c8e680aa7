"""The frame algorithms on tiles, for frames that are too large for one task.

A frame is a table of square tiles (video, t, ty, tx and one binary column for each layer). Local work runs on a tile and
a halo around it, which the neighbours send before: a step that looks one pixel far can be repeated on a halo of so many
pixels as often, before what is wrong at its rim reaches the tile. So a whole update of borders (four passes of four
phases) costs one exchange of labels, and the colours around a tile are sent once for all rounds. What regions need
(parameters, targets of merges, new ids) is joined by frame and region to the tiles that show the region; what
they give (sums, neighbours) is added up by region. No task holds more than a tile, its halo and the rows of the regions there.
Tables by region take few bytes in files where regions are alike, by which the planner would broadcast them: they are joined by
sorting (hint merge).

Results equal those of the kernels of plans.frame on whole frames.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import regions
from . import frame as kernel
from . import loops
from .drivers import with_video
from .frame import PHASES, Options

KEY = ("video", "t", "ty", "tx")
KINDS = {"labels": "<i4", "image": "<f4", "wide": "<f4", "near": "<i4", "far": "<i4", "piece": "<i8", "invalid": "|u1"}
MOMENTS = ("n", "sx", "sy", "sxx", "sxy", "syy", "s0", "s1", "s2", "q0", "q1", "q2")


class Grid(NamedTuple):
    """Size of the frames and side of the tiles, which is even so that all tiles see the same checkerboard."""

    height: int
    width: int
    side: int = 256

    def box(self, ty: int, tx: int, halo: int = 0) -> tuple[int, int, int, int]:
        """First and last row and column (exclusive) of a tile and its halo, inside the frame."""
        return (max(0, ty * self.side - halo), min(self.height, (ty + 1) * self.side + halo), max(0, tx * self.side - halo), min(self.width, (tx + 1) * self.side + halo))


def layer(data: bytes, name: str, box: tuple[int, int, int, int]) -> np.ndarray:
    a = np.frombuffer(data, KINDS[name])
    shape = (box[1] - box[0], box[3] - box[2])
    return a.reshape(*shape, 3) if name in ("image", "wide") else a.reshape(shape)


def packed_bytes(a: np.ndarray, name: str) -> bytes:
    return np.ascontiguousarray(a, KINDS[name]).tobytes()


def _schema(layers: list[str], more: str = "") -> str:
    return ", ".join(["video string, t int, ty int, tx int", *(f"{n} binary" for n in layers)]) + more


def together(frames: Iterator[pd.DataFrame | dict], most: int = 64) -> Iterator[pd.DataFrame]:
    """Rows (dicts) or frames of so many tiles at a time as one frame: what is small goes out together."""
    held: list = []

    def joined() -> pd.DataFrame:
        return pd.DataFrame(held) if isinstance(held[0], dict) else pd.concat(held, ignore_index=True)

    for f in frames:
        held.append(f)
        if len(held) >= most:
            yield joined()
            held = []
    if held:
        yield joined()


def by_tile(rows: DataFrame, work: Callable, schema: str, *order: str) -> DataFrame:
    """work(key, rows) of the rows of each tile, which gives a dict or a frame.

    Tiles are spread over a fixed number of tasks. A task reads its tiles one after the other from a sorted stream, many in
    a batch: a group each would cost more than the work on a small tile.
    """

    def tiles(batches: Iterator[pd.DataFrame]) -> Iterator:
        rest = None
        for batch in batches:
            part = batch if rest is None or not len(rest) else pd.concat([rest, batch], ignore_index=True)
            if not len(part):
                continue
            at = [part[k].to_numpy() for k in KEY]
            new = np.flatnonzero(np.logical_or.reduce([a[1:] != a[:-1] for a in at])) + 1
            edges = [0, *new.tolist()]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                yield work((at[0][a], int(at[1][a]), int(at[2][a]), int(at[3][a])), part.iloc[a:b])
            rest = part.iloc[edges[-1] :]
        if rest is not None and len(rest):
            yield work((rest["video"].iloc[0], *(int(rest[k].iloc[0]) for k in KEY[1:])), rest)

    return loops.spread(rows, *KEY).sortWithinPartitions(*KEY, *order).mapInPandas(lambda batches: together(tiles(batches)), schema)


def tiled(pixels: DataFrame, grid: Grid, columns: dict[str, list[str]]) -> DataFrame:
    """Tiles of rows (video, t, y, x). columns: the columns of each layer; a missing pixel or value is -1."""
    if grid.side % 2:
        raise ValueError("the side of a tile is even")
    names = [c for cs in columns.values() for c in cs]
    rows = with_video(pixels).select("video", "t", "y", "x", *names, (F.floor(F.col("y") / grid.side)).cast("int").alias("ty"), (F.floor(F.col("x") / grid.side)).cast("int").alias("tx"))

    def pack(key: tuple, f: pd.DataFrame) -> dict:
        y0, y1, x0, x1 = grid.box(key[2], key[3])
        out = {}
        for name, cs in columns.items():
            a = np.full((y1 - y0, x1 - x0, len(cs)), -1.0)
            a[f["y"].to_numpy() - y0, f["x"].to_numpy() - x0] = f[cs].fillna(-1).to_numpy(float)
            out[name] = packed_bytes(a if len(cs) > 1 else a[..., 0], name)
        return _row(key, **out)

    return by_tile(rows, pack, _schema(list(columns)))


def unpacked(tiles: DataFrame, grid: Grid, name: str = "labels", column: str = "spix", kind: str = "int") -> DataFrame:
    """Rows (video, t, y, x and the layer's value)."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                box = grid.box(r.ty, r.tx)
                y, x = np.mgrid[box[0] : box[1], box[2] : box[3]]
                yield pd.DataFrame({"video": r.video, "t": np.int32(r.t), "y": y.ravel().astype(np.int32), "x": x.ravel().astype(np.int32), column: layer(getattr(r, name), name, box).ravel()})

    return tiles.select(*KEY, name).mapInPandas(lambda batches: together(unpack(batches)), f"video string, t int, y int, x int, {column} {kind}")


def exchange(tiles: DataFrame, grid: Grid, sent: list[str], halo: int, work: Callable, schema: str, kept: list[str] | None = None, table: DataFrame | None = None) -> DataFrame:
    """work(key, layers, origin, inner, rows) of every tile, which gives one DataFrame.

    layers: the sent ones with their halos, and those of the tile in kept; origin: the first row and column; inner:
    the slices of the tile itself; rows: what table (video, t, spix, ...) has of the regions seen, sorted by spix.
    """
    kept, named = kept or [], table is not None

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                box = grid.box(r.ty, r.tx)
                held = {n: layer(getattr(r, n), n, box) for n in sent}
                reach = -(-halo // grid.side)
                for ty in range(max(0, r.ty - reach), min(-(-grid.height // grid.side), r.ty + reach + 1)):
                    for tx in range(max(0, r.tx - reach), min(-(-grid.width // grid.side), r.tx + reach + 1)):
                        seen = grid.box(ty, tx, halo)
                        part = (max(box[0], seen[0]), min(box[1], seen[1]), max(box[2], seen[2]), min(box[3], seen[3]))
                        if part[0] >= part[1] or part[2] >= part[3]:
                            continue
                        at = np.s_[part[0] - box[0] : part[1] - box[0], part[2] - box[2] : part[3] - box[2]]
                        own = (ty, tx) == (r.ty, r.tx)
                        ids = np.unique(held["labels"][at]).tolist() if named else []
                        rows.append((r.video, r.t, ty, tx, list(part), [i for i in ids if i >= 0], *(packed_bytes(held[n][at], n) for n in sent), *(getattr(r, n) if own else None for n in kept)))
            yield pd.DataFrame(rows, columns=[*KEY, "part", "ids", *sent, *(f"own_{n}" for n in kept)])

    moved = tiles.select(*KEY, *dict.fromkeys([*sent, *kept])).mapInPandas(spread, f"video string, t int, ty int, tx int, part array<int>, ids array<int>, {', '.join([*(f'{n} binary' for n in sent), *(f'own_{n} binary' for n in kept)])}")

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame | dict:
        rows = None
        if named:
            known = f["spix"].notna().to_numpy()
            f, rows = f[~known], f.loc[known, columns].astype(kinds)
        seen, box = grid.box(key[2], key[3], halo), grid.box(key[2], key[3])
        held = {}
        for n in sent:
            parts = [(p, layer(data, n, p)) for p, data in zip(f["part"], f[n], strict=True)]
            kind = parts[0][1].dtype
            a = np.full((seen[1] - seen[0], seen[3] - seen[2], *parts[0][1].shape[2:]), 0 if kind.kind == "u" else -1, kind)
            for p, part in parts:
                a[p[0] - seen[0] : p[1] - seen[0], p[2] - seen[2] : p[3] - seen[2]] = part
            held[n] = a
        for n in kept:
            held[f"own_{n}"] = next(data for data in f[f"own_{n}"] if data is not None)
        inner = np.s_[box[0] - seen[0] : box[1] - seen[0], box[2] - seen[2] : box[3] - seen[2]]
        return work(key, held, (seen[0], seen[2]), inner, rows)

    if table is None:
        return by_tile(moved.drop("ids"), run, schema)
    columns = [c for c in table.columns if c not in ("video", "t")]
    kinds = {f.name: _NUMPY[f.dataType.typeName()] for f in table.schema if f.name in columns}
    needs = moved.select(*KEY, F.explode("ids").alias("spix")).distinct().join(table.hint("merge"), ["video", "t", "spix"])
    return by_tile(moved.drop("ids").unionByName(needs.select(*KEY, *columns), allowMissingColumns=True), run, schema, "spix")


#: Kinds of a region's columns, which pass through columns with nulls.
_NUMPY = {"integer": np.int32, "long": np.int64, "double": np.float64, "boolean": bool}


def _row(key: tuple, **values) -> dict:
    return dict(zip(KEY, key, strict=True)) | values


def widened(tiles: DataFrame, grid: Grid, halo: int) -> DataFrame:
    """Tiles whose layer wide holds the colours with so wide a halo, in place of image."""

    def work(key, held, origin, inner, rows):
        return _row(key, labels=held["own_labels"], wide=packed_bytes(held["image"], "wide"))

    return exchange(tiles, grid, ["image"], halo, work, _schema(["labels", "wide"]), ["labels"])


def sums_by_region(tiles: DataFrame, grid: Grid, halo: int, marks: str | None = None) -> DataFrame:
    """Moments of each region, added up over tiles that were widened by halo.

    marks: a 0/1 layer; the moments are then also told apart by its value (column marked).
    """

    def give(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                box, seen = grid.box(r.ty, r.tx), grid.box(r.ty, r.tx, halo)
                labels = layer(r.labels, "labels", box).astype(np.int64)
                image = layer(r.wide, "wide", seen)[box[0] - seen[0] : box[1] - seen[0], box[2] - seen[2] : box[3] - seen[2]].astype(float)
                y, x = np.mgrid[box[0] : box[1], box[2] : box[3]]
                mark = layer(getattr(r, marks), marks, box).astype(np.int64) if marks else np.zeros_like(labels)
                ok = labels >= 0
                ids, at = np.unique(2 * labels[ok] + mark[ok], return_inverse=True)
                y, x, c = y[ok].astype(float), x[ok].astype(float), image[ok]
                values = [np.ones(len(y)), x, y, x * x, x * y, y * y, *c.T, *(c * c).T]
                out = pd.DataFrame(dict(zip(MOMENTS, (np.bincount(at, v, len(ids)) for v in values), strict=True)))
                out.insert(0, "marked", (ids % 2).astype(np.int32))
                out.insert(0, "spix", (ids // 2).astype(np.int32))
                out.insert(0, "t", np.int32(r.t))
                out.insert(0, "video", r.video)
                yield out

    columns = [*KEY, "labels", "wide", *([marks] if marks else [])]
    parts = tiles.select(*columns).mapInPandas(lambda batches: together(give(batches)), f"video string, t int, spix int, marked int, {', '.join(f'{m} double' for m in MOMENTS)}")
    return parts.groupBy("video", "t", "spix", *(["marked"] if marks else [])).agg(*(F.sum(m).alias(m) for m in MOMENTS))


_PARAMS = ("mu0", "mu1", "mu2", "mx", "my", "ixx", "ixy", "iyy", "logdet")


def _numbered(labels: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Labels as places among the sorted ids; -1 and -2 stay."""
    return np.where(labels >= 0, np.searchsorted(ids, labels), labels)


def moved_borders(tiles: DataFrame, grid: Grid, params: DataFrame, halo: int, sigma2: float, potts: float, passes: int = 4, phases: tuple = PHASES) -> DataFrame:
    """The update of borders on tiles that were widened by halo, which is as many pixels as there are phases in all."""
    if passes * len(phases) > halo or halo % 2:
        raise ValueError("a halo is even and has a pixel for each phase")

    def work(key, held, origin, inner, rows):
        ids = rows["spix"].to_numpy()
        labels = _numbered(held["labels"].astype(np.int64), ids)
        empty = np.zeros(len(ids))
        p = kernel.Params(empty, rows[["mu0", "mu1", "mu2"]].to_numpy(), rows[["mx", "my"]].to_numpy() - (origin[1], origin[0]), rows[["ixx", "ixy", "iyy"]].to_numpy(), rows["logdet"].to_numpy(), empty, empty, empty, empty)
        image = layer(held["own_wide"], "wide", grid.box(key[2], key[3], halo)).astype(float)
        out = kernel.update_labels(image, labels, p, sigma2, potts, passes, phases)[inner]
        return _row(key, labels=packed_bytes(np.where(out >= 0, ids[np.maximum(out, 0)], -1), "labels"), wide=held["own_wide"])

    table = params.select("video", "t", "spix", *_PARAMS)
    return exchange(tiles, grid, ["labels"], halo, work, _schema(["labels", "wide"]), ["wide"], table)


def renamed(tiles: DataFrame, grid: Grid, names: DataFrame, layers: list[str]) -> DataFrame:
    """Labels replaced by the column name of names (video, t, spix, name), where a region has a row there."""

    def work(key, held, origin, inner, rows):
        labels, ids, to = held["labels"].astype(np.int64), rows["spix"].to_numpy(), rows["name"].to_numpy()
        if len(ids):
            at = np.minimum(np.searchsorted(ids, labels), len(ids) - 1)
            labels = np.where(ids[at] == labels, to[at], labels)
        return _row(key, labels=packed_bytes(labels, "labels"), **{n: held[f"own_{n}"] for n in layers})

    return exchange(tiles, grid, ["labels"], 0, work, _schema(["labels", *layers]), layers, names)


def merge_candidates(tiles: DataFrame, grid: Grid, direction: str) -> DataFrame:
    """For each region the largest other label beside it in one direction (s: below, w: to the left)."""

    def work(key, held, origin, inner, rows):
        labels = held["labels"].astype(np.int64)
        near = kernel.around(labels, direction)
        pair = (near[inner] >= 0) & (labels[inner] >= 0) & (near[inner] != labels[inner])
        found = pd.DataFrame({"spix": labels[inner][pair].astype(np.int32), "target": near[inner][pair].astype(np.int32)}).groupby("spix", as_index=False).max()
        return found.assign(video=key[0], t=np.int32(key[1]))[["video", "t", "spix", "target"]]

    return exchange(tiles, grid, ["labels"], 1, work, "video string, t int, spix int, target int").groupBy("video", "t", "spix").agg(F.max("target").alias("target"))


def distances(tiles: DataFrame, grid: Grid, seeds: DataFrame) -> DataFrame:
    """Tiles with the steps inside a region from its two seeds as layers near and far (-1 where none leads).

    seeds: video, t, spix, y0, x0, y1, x1. Each tile follows all paths inside it and its one-pixel halo to their ends;
    tiles exchange their rims until none finds a shorter way, which takes as many rounds as a region has tiles in a row.
    """

    def start(key, held, origin, inner, rows):
        labels = held["labels"].astype(np.int64)
        out = {}
        for k, name in enumerate(("near", "far")):
            a = np.full(labels.shape, -1)
            y, x = rows[f"y{k}"].to_numpy() - origin[0], rows[f"x{k}"].to_numpy() - origin[1]
            ok = (y >= 0) & (y < labels.shape[0]) & (x >= 0) & (x < labels.shape[1])
            a[y[ok], x[ok]] = 0
            out[name] = packed_bytes(a, name)
        return _row(key, labels=held["own_labels"], wide=held["own_wide"], **out, changed=True)

    def relax(key, held, origin, inner, rows):
        labels, out, changed = held["labels"].astype(np.int64), {}, False
        for name in ("near", "far"):
            before = held[name].astype(np.int64)
            d = np.where(before < 0, 1 << 40, before)
            while True:
                best = d
                for step in "nswe":
                    best = np.where(kernel.around(labels, step) == labels, np.minimum(best, kernel.around(d, step, 1 << 40) + 1), best)
                best = np.where(labels >= 0, best, d)
                if (best == d).all():
                    break
                d = best
            d = np.where(d >= 1 << 40, -1, d)
            changed |= bool((d[inner] != before[inner]).any())
            out[name] = packed_bytes(d[inner], name)
        return _row(key, labels=held["own_labels"], wide=held["own_wide"], **out, changed=changed)

    schema = _schema(["labels", "wide", "near", "far"], ", changed boolean")
    out = loops.stored(exchange(tiles, grid, ["labels"], 0, start, schema, ["labels", "wide"], seeds))
    while True:
        out = loops.stored(exchange(out, grid, ["labels", "near", "far"], 1, relax, schema, ["labels", "wide"]))
        if out.where("changed").isEmpty():
            return out.drop("changed")


def split_seeds(params: DataFrame, direction: int, grid: Grid) -> DataFrame:
    """Two places beside the whole part of each region's centre, along x by one (1) or along y by two (2) pixels."""
    dx, dy = (1, 0) if direction == 1 else (0, 2)
    x, y = F.col("mx").cast("int"), F.col("my").cast("int")

    def held(c: Column, most: int) -> Column:
        return F.least(F.greatest(c, F.lit(0)), F.lit(most - 1))

    return params.select("video", "t", "spix", *(held(c + sign * step, most).cast("int").alias(f"{n}{k}") for k, sign in enumerate((-1, 1)) for n, c, step, most in (("y", y, dy, grid.height), ("x", x, dx, grid.width))))


def split(tiles: DataFrame, grid: Grid, halo: int, params: DataFrame, o: Options, direction: int, invalid: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Tiles after one round of splits, and of each region that was cut: new id, which part kept the id, prior_count.

    params: parameters with prior_count and propagated. A region whose two seeds lie inside it is cut where the second
    one is nearer; the cut stands if the two parts explain the colours better. invalid: tiles whose layer invalid marks
    the pixels that newly came into view, in a propagated frame: a cut then pays for the valid share of the part that
    keeps the id, the part with fewer new pixels keeps it, and small regions stay whole. New ids follow the frame's last.
    """
    seeds, later = split_seeds(params, direction, grid), invalid is not None

    def inside(key, held, origin, inner, rows):
        labels = held["labels"]
        y, x, ids = (rows[c].to_numpy() for c in ("y", "x", "spix"))
        box = grid.box(key[2], key[3])
        here = (y >= box[0]) & (y < box[1]) & (x >= box[2]) & (x < box[3])
        good = np.zeros(len(ids), bool)
        good[here] = labels[y[here] - box[0], x[here] - box[2]] == ids[here]
        return pd.DataFrame({"video": key[0], "t": np.int32(key[1]), "spix": ids[good].astype(np.int32), "k": rows["k"].to_numpy()[good].astype(np.int32)})

    each = seeds.select("video", "t", "spix", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"y{k}").alias("y"), F.col(f"x{k}").alias("x")) for k in (0, 1)))).alias("s")).select("video", "t", "spix", "s.*")
    lies = exchange(tiles, grid, ["labels"], 0, inside, "video string, t int, spix int, k int", table=each)
    whole = lies.groupBy("video", "t", "spix").agg(F.count_distinct("k").alias("c")).where("c = 2").drop("c")
    seeds = loops.stored(seeds.join(whole.hint("merge"), ["video", "t", "spix"]))
    walked = distances(tiles, grid, seeds)
    if invalid is not None:
        walked = walked.join(invalid.select(*KEY, "invalid").hint("merge"), list(KEY))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                box = grid.box(r.ty, r.tx)
                near, far = layer(r.near, "near", box), layer(r.far, "far", box)
                rows.append((r.video, r.t, r.ty, r.tx, r.labels, r.wide, packed_bytes((near > far) & (far >= 0), "invalid"), r.invalid if later else packed_bytes(np.zeros(near.shape), "invalid")))
            yield pd.DataFrame(rows, columns=[*KEY, "labels", "wide", "invalid", "lost"])

    parted = loops.stored(walked.mapInPandas(cut, _schema(["labels", "wide", "invalid", "lost"])))
    parts = sums_by_region(parted, grid, halo, "invalid").withColumnRenamed("marked", "moved").join(seeds.select("video", "t", "spix").hint("merge"), ["video", "t", "spix"])

    def count_lost(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                box = grid.box(r.ty, r.tx)
                labels, moved, lost = layer(r.labels, "labels", box), layer(r.invalid, "invalid", box), layer(r.lost, "invalid", box)
                at = (labels >= 0) & (lost > 0)
                ids, n = np.unique(2 * labels[at].astype(np.int64) + moved[at], return_counts=True)
                yield pd.DataFrame({"video": r.video, "t": np.int32(r.t), "spix": (ids // 2).astype(np.int32), "moved": (ids % 2).astype(np.int32), "lost": n.astype(np.int64)})

    key = ["video", "t", "spix"]
    missing = parted.mapInPandas(lambda batches: together(count_lost(batches)), "video string, t int, spix int, moved int, lost long").groupBy(*key, "moved").agg(F.sum("lost").alias("lost"))
    parts = parts.join(missing.hint("merge"), [*key, "moved"], "left").fillna(0, ["lost"])
    columns = ["n", "lost", *(f"{c}{i}" for c in "sq" for i in range(3))]
    sides = [parts.where(F.col("moved") == k).select(*key, *(F.col(c).alias(f"{p}{c}") for c in columns)) for k, p in ((0, "k_"), (1, "s_"))]
    both = sides[0].join(sides[1].hint("merge"), key)
    other = F.col("s_lost") < F.col("k_lost") if invalid is not None else F.lit(False)
    share = F.when(other, F.col("s_lost") / F.col("s_n")).otherwise(F.col("k_lost") / F.col("k_n"))
    scored = regions.split_scores(both.withColumn("iperc", share), o.sigma_app, o.split_alpha, o.gamma if invalid is not None else 0.0, least_size=0 if invalid is None else 64)
    known = params.select(*key, "prior_count", "propagated")
    last = params.groupBy("video", "t").agg(F.max("spix").alias("last"))
    order = F.row_number().over(Window.partitionBy("video", "t").orderBy("spix"))
    half = F.greatest(F.col("prior_count") / 2, F.lit(8.0 if invalid is None else 36.0))
    taken = scored.where("accept").withColumn("other", other).join(known.hint("merge"), key).join(last.hint("merge"), ["video", "t"])
    accepted = loops.stored(taken.select(*key, (F.col("last") + order).cast("int").alias("name"), (F.col("other") & F.col("propagated")).alias("swap"), half.alias("half"), F.when(F.lit(invalid is None) | F.col("other"), half).otherwise(F.col("prior_count")).alias("prior_count")))

    def apply(key, held, origin, inner, rows):
        labels, moved = held["labels"].astype(np.int64), layer(held["own_invalid"], "invalid", grid.box(key[2], key[3])) > 0
        ids = rows["spix"].to_numpy()
        if len(ids):
            at = np.minimum(np.searchsorted(ids, labels), len(ids) - 1)
            flips = (ids[at] == labels) & (moved ^ rows["swap"].to_numpy()[at])
            labels = np.where(flips, rows["name"].to_numpy()[at], labels)
        return _row(key, labels=packed_bytes(labels, "labels"), wide=held["own_wide"])

    return loops.stored(exchange(parted, grid, ["labels"], 0, apply, _schema(["labels", "wide"]), ["wide", "invalid"], accepted)), accepted


def merge(tiles: DataFrame, grid: Grid, halo: int, o: Options, direction: str) -> tuple[DataFrame, DataFrame]:
    """Tiles after one round of merges, and the merges (video, t, spix, target)."""
    stats = sums_by_region(tiles, grid, halo)
    scores = regions.merge_scores(merge_candidates(tiles, grid, direction), stats.hint("merge"), o.sigma_app, o.alpha, o.merge_alpha)
    accepted = loops.stored(regions.merge_accepted(scores.hint("merge")))
    return loops.stored(renamed(tiles, grid, accepted.select("video", "t", "spix", F.col("target").alias("name")), ["wide"])), accepted


def pieces(tiles: DataFrame, grid: Grid) -> tuple[DataFrame, DataFrame]:
    """Tiles with the layer piece, 8-connected pieces of equal labels inside a tile by their least place (y * width + x),
    and the table of pieces (video, t, spix, piece, n, whole), whole being the least place of all that touch across tiles."""

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                box = grid.box(r.ty, r.tx)
                index, wide = kernel.pieces(layer(r.labels, "labels", box).astype(np.int64)), box[3] - box[2]
                place = np.where(index >= 0, (index // wide + box[0]) * grid.width + index % wide + box[2], -1)
                rows.append((r.video, r.t, r.ty, r.tx, r.labels, packed_bytes(place, "piece")))
            yield pd.DataFrame(rows, columns=[*KEY, "labels", "piece"])

    parted = loops.stored(tiles.select(*KEY, "labels").mapInPandas(local, _schema(["labels", "piece"])))

    def touch(key, held, origin, inner, rows):
        labels, piece = held["labels"].astype(np.int64), held["piece"]
        own = np.zeros(labels.shape, bool)
        own[inner] = True
        found = []
        for d in ("e", "sw", "s", "se"):  # the other directions are another tile's
            pair = own & (labels >= 0) & (kernel.around(labels, d) == labels)
            found.append(np.stack([piece[pair], kernel.around(piece, d)[pair]]))
        links = np.unique(np.concatenate(found, axis=1), axis=1)
        links = links[:, links[0] != links[1]]
        return pd.DataFrame({"video": key[0], "t": np.int32(key[1]), "a": links[0], "b": links[1]})

    links = exchange(parted, grid, ["labels", "piece"], 1, touch, "video string, t int, a long, b long")
    joined = loops.components(links.select(*(F.struct("video", "t", F.col(c).alias("piece")).alias(n) for c, n in (("a", "u"), ("b", "v")))))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                box = grid.box(r.ty, r.tx)
                labels, piece = layer(r.labels, "labels", box), layer(r.piece, "piece", box)
                ids, first, n = np.unique(piece[piece >= 0], return_index=True, return_counts=True)
                yield pd.DataFrame({"video": r.video, "t": np.int32(r.t), "spix": labels[piece >= 0][first].astype(np.int32), "piece": ids, "n": n.astype(np.int64)})

    counted = parted.mapInPandas(lambda batches: together(count(batches)), "video string, t int, spix int, piece long, n long")
    roots = joined.select("id.video", "id.t", "id.piece", F.col("component.piece").alias("whole"))
    return parted, counted.join(roots.hint("merge"), ["video", "t", "piece"], "left").withColumn("whole", F.coalesce("whole", "piece"))


def _with_pieces(parted: DataFrame, grid: Grid, table: DataFrame, value: str, kind: str) -> DataFrame:
    """Tiles whose pixels get a value of their piece; table has video, t, spix, piece and that value."""

    def work(key, held, origin, inner, rows):
        piece = layer(held["own_piece"], "piece", grid.box(key[2], key[3]))
        rows = rows.sort_values("piece")
        ids, to = rows["piece"].to_numpy(), rows[value].to_numpy()
        out = np.where(piece >= 0, to[np.minimum(np.searchsorted(ids, piece), max(0, len(ids) - 1))], -1) if len(ids) else np.full(piece.shape, -1)
        return _row(key, **{kind: packed_bytes(out, kind)})

    return exchange(parted, grid, ["labels"], 0, work, _schema([kind]), ["piece"], table.select("video", "t", "spix", "piece", value))


def components_8(seg: DataFrame, grid: Grid) -> DataFrame:
    """drivers.components_8 on tiles: rows (video, t, y, x, spix)."""
    parted, table = pieces(loops.stored(tiled(seg, grid, {"labels": ["spix"]})), grid)
    return unpacked(_with_pieces(parted, grid, table, "whole", "piece"), grid, "piece", "spix", "long").withColumn("spix", F.col("spix").cast("int"))


def largest_pieces(tiles: DataFrame, grid: Grid) -> DataFrame:
    """drivers.largest_pieces on tiles: only the largest piece of each label keeps it, the first one of equals."""
    parted, table = pieces(tiles, grid)
    sizes = table.groupBy("video", "t", "spix", "whole").agg(F.sum("n").alias("n"))
    best = sizes.groupBy("video", "t", "spix").agg(F.min(F.struct((-F.col("n")).alias("less"), "whole")).alias("best"))
    marked = table.join(best.hint("merge"), ["video", "t", "spix"]).withColumn("kept", F.when(F.col("whole") == F.col("best.whole"), F.col("spix")).otherwise(-1))
    return _with_pieces(parted, grid, marked, "kept", "labels")


def fill(tiles: DataFrame, grid: Grid, centres: DataFrame, passes: int = 8) -> DataFrame:
    """kernel.fill on tiles: rounds of so many passes each, in the tiles where pixels are missing, until none is or a round
    changes nothing. centres: video, t, spix, mx, my."""
    halo = 4 * passes

    def work(key, held, origin, inner, rows):
        labels, ids = held["labels"].astype(np.int64), rows["spix"].to_numpy()
        if not (labels < 0).any() or not len(ids):
            return _row(key, labels=packed_bytes(labels[inner], "labels"), filled=0, missing=int((labels[inner] < 0).sum()))
        centre = rows[["mx", "my"]].to_numpy() - (origin[1], origin[0])
        out = kernel.fill(_numbered(labels, ids), centre, passes, (grid.height, grid.width))[inner]
        out = np.where(out >= 0, ids[np.maximum(out, 0)], -1)
        return _row(key, labels=packed_bytes(out, "labels"), filled=int(((out >= 0) & (labels[inner] < 0)).sum()), missing=int((out < 0).sum()))

    now = tiles.select(*KEY, "labels")
    while True:
        now = loops.stored(exchange(now, grid, ["labels"], halo, work, _schema(["labels"], ", filled long, missing long"), table=centres))
        if now.where("missing > 0").isEmpty() or now.where("filled > 0").isEmpty():
            return now.select(*KEY, "labels")


def fill_missing(seg: DataFrame, grid: Grid) -> DataFrame:
    """drivers.fill_missing on tiles: rows (video, t, y, x, spix). Filled, cut to the largest pieces, and filled again."""
    rows = with_video(seg)
    centres = loops.stored(rows.where("spix >= 0").groupBy("video", "t", "spix").agg(F.avg("x").alias("mx"), F.avg("y").alias("my")))
    once = fill(loops.stored(tiled(rows, grid, {"labels": ["spix"]})), grid, centres)
    return unpacked(fill(largest_pieces(once, grid), grid, centres), grid)


def segment_tiled(pixels: DataFrame, grid: Grid, options: Options | None = None) -> DataFrame:
    """drivers.segment_frames on tiles: rows (video, t, y, x, spix).

    A round fits the regions (one sum by region), splits or merges by turns, and moves borders after one exchange of
    labels. The priors' weights live in a table by region. Labels are cut to the shared folder once or twice a round.
    """
    o = options or Options()
    halo = len(PHASES) * o.niters_seg
    cells = loops.stored(regions.hex_cells(with_video(pixels), o.sp_size, grid.width, grid.height))
    rank = F.dense_rank().over(Window.partitionBy("video", "t").orderBy("spix")) - 1
    ids = cells.select("video", "t", "spix").distinct().withColumn("name", rank)
    named = cells.join(ids.hint("merge"), ["video", "t", "spix"]).withColumn("spix", F.col("name").cast("int"))
    tiles = loops.stored(widened(tiled(named, grid, {"labels": ["spix"], "image": ["c0", "c1", "c2"]}), grid, halo))
    key, count = ["video", "t", "spix"], 0
    cells_per = ids.groupBy("video", "t").agg(F.count("*").alias("c"))
    priors = loops.stored(ids.join(cells_per.hint("merge"), ["video", "t"]).select("video", "t", F.col("name").cast("int").alias("spix"), F.floor(F.lit(grid.height * grid.width) / F.col("c")).cast("double").alias("prior_count")))

    def fitted() -> DataFrame:
        stats = sums_by_region(tiles, grid, halo).join(priors.hint("merge"), key)
        shape = stats.select("*", *(F.lit(v).alias(f"{m}{k}") for m in "kv" for k, v in (("xx", 1.0), ("xy", 0.0), ("yy", 1.0))), F.lit(False).alias("propagated"))
        moments = shape.select(*key, *MOMENTS)
        return loops.stored(regions.conditioned_parameters(moments, shape.select(*key, "prior_count", "propagated", *(f"{m}{k}" for m in "kv" for k in ("xx", "xy", "yy"))).hint("merge"), o.sp_size, False))

    for step in range(o.rounds):
        params = fitted()
        if o.use_sm and step > o.sm_start and step % 4 == 0:
            tiles, made = split(tiles, grid, halo, params, o, count % 2 + 1)
            new = made.select("video", "t", F.col("name").alias("spix"), F.col("half").alias("prior_count"))
            old = made.select(*key, F.col("prior_count").alias("lower"))
            priors = loops.stored(priors.join(old.hint("merge"), key, "left").select(*key, F.coalesce("lower", "prior_count").alias("prior_count")).union(new))
            count += 1
            params = fitted()
        elif o.use_sm and step > o.sm_start and step % 4 == 2:
            tiles, gone = merge(tiles, grid, halo, o, "s" if count % 2 else "w")
            to = gone.select(*key, "target")
            moved = priors.join(to.hint("merge"), key, "left").withColumn("spix", F.coalesce("target", "spix"))
            priors = loops.stored(moved.groupBy(*key).agg(F.sum("prior_count").alias("prior_count")))
            params = fitted()
        tiles = loops.stored(moved_borders(tiles, grid, params, halo, o.sigma2, o.potts, o.niters_seg))
    live = sums_by_region(tiles, grid, halo).select(*key).withColumn("name", rank)
    return unpacked(renamed(tiles, grid, live, []), grid)
