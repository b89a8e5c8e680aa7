"""The region algorithms over tables of pixels: frames in parallel, or each video as a stream of frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frame as kernel
from .frame import Options
from .loops import spread

LABELS = "video string, t int, y int, x int, spix int"
FRAMES = "video string, t int, height int, width int, image binary, flow binary"


def raster(frame: pd.DataFrame, columns: list[str]) -> np.ndarray:
    """Rows of one frame as an array (height, width, columns)."""
    h, w = int(frame["y"].max()) + 1, int(frame["x"].max()) + 1
    out = np.zeros((h, w, len(columns)))
    out[frame["y"].to_numpy(), frame["x"].to_numpy()] = frame[columns].to_numpy(float)
    return out


def rows(video: str, t: int, labels: np.ndarray) -> pd.DataFrame:
    y, x = np.mgrid[: labels.shape[0], : labels.shape[1]]
    return pd.DataFrame({"video": video, "t": np.int32(t), "y": y.ravel().astype(np.int32), "x": x.ravel().astype(np.int32), "spix": labels.ravel().astype(np.int32)})


def with_video(df: DataFrame) -> DataFrame:
    return df if "video" in df.columns else df.withColumn("video", F.lit(""))


def _each(pixels: DataFrame, work) -> DataFrame:
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return rows(frame["video"].iloc[0], frame["t"].iloc[0], work(frame))

    return spread(with_video(pixels), "video", "t").groupBy("video", "t").applyInPandas(run, LABELS)


def packed(pixels: DataFrame, flows: DataFrame | None = None) -> DataFrame:
    """One row a frame: colours and the motion into this frame as float32 bytes. Motion has a row a pixel too, however few
    bytes its files have, so it isn't broadcast."""
    px = with_video(pixels).select("video", "t", "y", "x", "c0", "c1", "c2")
    if flows is not None:
        motion = with_video(flows).select("video", (F.col("t") + 1).alias("t"), "y", "x", "fx", "fy")
        px = px.join(motion.hint("merge"), ["video", "t", "y", "x"], "left").fillna(0.0, ["fx", "fy"])
    else:
        px = px.withColumns({"fx": F.lit(0.0), "fy": F.lit(0.0)})

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        image = raster(f, ["c0", "c1", "c2"])
        return pd.DataFrame({"video": [f["video"].iloc[0]], "t": [np.int32(f["t"].iloc[0])], "height": [np.int32(image.shape[0])], "width": [np.int32(image.shape[1])], "image": [image.astype("<f4").tobytes()], "flow": [raster(f, ["fx", "fy"]).astype("<f4").tobytes()]})

    return spread(px, "video", "t").groupBy("video", "t").applyInPandas(pack, FRAMES)


def image_of(row) -> tuple[np.ndarray, np.ndarray]:
    """Colours and motion of a packed frame."""
    return tuple(np.frombuffer(data, "<f4").reshape(row.height, row.width, -1).astype(float) for data in (row.image, row.flow))


def segment_frames(pixels: DataFrame, options: Options | None = None) -> DataFrame:
    """Labels of every frame on its own: one task a frame, nothing shared between frames."""
    o = options or Options()
    return _each(pixels, lambda f: kernel.segment_image(raster(f, ["c0", "c1", "c2"]), o)[0])


def trace_frames(pixels: DataFrame, options: Options | None = None) -> DataFrame:
    """The labels of every frame after every step of segment_frames: video, t, step (split, merge or bndy), seq, y, x, spix."""
    o = options or Options()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        parts: list[pd.DataFrame] = []

        def log(step: str, labels: np.ndarray, merges: tuple | None = None) -> None:
            snapshot = rows(frame["video"].iloc[0], frame["t"].iloc[0], labels)
            parts.append(snapshot.assign(step=step, seq=np.int32(len(parts))))

        kernel.segment_image(raster(frame, ["c0", "c1", "c2"]), o, log)
        return pd.concat(parts)[["video", "t", "step", "seq", "y", "x", "spix"]]

    return spread(with_video(pixels), "video", "t").groupBy("video", "t").applyInPandas(run, "video string, t int, step string, seq int, y int, x int, spix int")


TRACE = "video string, t int, step string, seq int, height int, width int, labels binary, merges array<struct<spix:int, target:int, h:double, accepted:boolean>>"


class Traced:
    """Rows of TRACE, made of what a frame's kernel logs."""

    def __init__(self, video: str, t: int):
        self.video, self.t, self.rows = video, t, []

    def __call__(self, step: str, labels: np.ndarray, merges: tuple | None = None) -> None:
        told = [dict(zip(("spix", "target", "h", "accepted"), (int(a), int(b), float(h), bool(ok)), strict=True)) for a, b, h, ok in zip(*merges, strict=True)] if merges else []
        self.rows.append((self.video, np.int32(self.t), step, np.int32(len(self.rows)), np.int32(labels.shape[0]), np.int32(labels.shape[1]), labels.astype("<i4").tobytes(), told))

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame(self.rows, columns=["video", "t", "step", "seq", "height", "width", "labels", "merges"])


def trace_videos(pixels: DataFrame, flows: DataFrame | None = None, options: Options | None = None) -> DataFrame:
    """What happens in each frame of segment_videos, one row a step (TRACE): shifted, filled, split, relabel, merge, bndy.

    One pass over each video gives all steps; traced_labels and traced_merges read their kinds out of it.
    """
    o = options or Options()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        video, state = None, None
        for batch in batches:
            for r in batch.itertuples():
                image, flow = image_of(r)
                if r.video != video:
                    video, state = r.video, None
                log = Traced(video, r.t)
                if state is None or state.labels.shape != image.shape[:2]:
                    state = kernel.first_frame(image, o, log)
                else:
                    state = kernel.next_frame(image, flow, state, o, log)
                log("final", state.labels)
                yield log.frame()

    return spread(packed(pixels, flows), "video").sortWithinPartitions("video", "t").mapInPandas(run, TRACE)


def trace_steps(seg: DataFrame, flows: DataFrame, options: Options | None = None) -> DataFrame:
    """TRACE of taking each frame's given labels along the motion into the next frame: one task a frame.

    seg: [video,] t, y, x, c0-2, spix. The rows are those of the frame that is entered; the last frame enters none.
    """
    o = options or Options()
    key = ["video", "t", "y", "x"]
    px = with_video(seg)
    before = px.select("video", (F.col("t") + 1).cast("int").alias("t"), "y", "x", F.col("spix").alias("was"), *(F.col(f"c{i}").alias(f"b{i}") for i in range(3)))
    motion = with_video(flows).select("video", (F.col("t") + 1).cast("int").alias("t"), "y", "x", "fx", "fy")
    both = px.select(*key, "c0", "c1", "c2").join(before, key).join(motion, key, "left").fillna(0.0, ["fx", "fy"])

    def run(f: pd.DataFrame) -> pd.DataFrame:
        image, old, flow = (raster(f, columns) for columns in (["c0", "c1", "c2"], ["b0", "b1", "b2"], ["fx", "fy"]))
        labels = raster(f.fillna({"was": -1}), ["was"])[..., 0].astype(int)
        size = int(labels.max()) + 1
        live = max(1, len(np.unique(labels[labels >= 0])))
        p = kernel.parameters(old, labels, np.full(size, float(labels.size // live)), np.zeros(size, bool), o.sp_size)
        log = Traced(f["video"].iloc[0], int(f["t"].iloc[0]))
        log("final", kernel.next_frame(image, flow, kernel.state_of(labels, p), o, log).labels)
        return log.frame()

    return spread(both, "video", "t").groupBy("video", "t").applyInPandas(run, TRACE)


def traced_labels(trace: DataFrame) -> DataFrame:
    """Rows (video, t, step, seq, y, x, spix) of a trace."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                out = rows(r.video, r.t, np.frombuffer(r.labels, "<i4").reshape(r.height, r.width))
                yield out.assign(step=r.step, seq=np.int32(r.seq))[["video", "t", "step", "seq", "y", "x", "spix"]]

    return trace.drop("merges").mapInPandas(unpack, "video string, t int, step string, seq int, y int, x int, spix int")


def traced_merges(trace: DataFrame) -> DataFrame:
    """Rows (video, t, seq, spix, target, h, accepted) of every merge that was proposed."""
    return trace.select("video", "t", "seq", F.explode("merges").alias("m")).select("video", "t", "seq", "m.*")


def largest_pieces(seg: DataFrame) -> DataFrame:
    """Only the largest 8-connected piece of each label keeps it, the first one of equals; the rest get -1."""
    return _each(seg, lambda f: kernel.largest_pieces(raster(f.fillna({"spix": -1}), ["spix"])[..., 0].astype(int)))


def segment_frames_batched(pixels: DataFrame, options: Options | None = None) -> DataFrame:
    """segment_frames without splits and merges."""
    from dataclasses import replace

    return segment_frames(pixels, replace(options or Options(), use_sm=False))


def controlled_count(pixels: DataFrame, target: int, options: Options | None = None) -> DataFrame:
    from dataclasses import replace

    return segment_frames(pixels, replace(options or Options(), target_nspix=target))


def merge_only(seg: DataFrame, options: Options | None = None, rounds: int = 8) -> DataFrame:
    """Merges the regions of seg (t, y, x, c0-2, spix) by turns along both axes."""
    o = options or Options()
    return _each(seg, lambda f: kernel.merge_only(raster(f, ["c0", "c1", "c2"]), raster(f, ["spix"])[..., 0].astype(int), o, rounds))


def merge_loop(seg: DataFrame, options: Options | None = None, rounds: int = 4) -> DataFrame:
    """Downward merges of the regions of seg (t, y, x, c0-2, spix), round after round; see frame.merge_loop."""
    o = options or Options()
    return _each(seg, lambda f: kernel.merge_loop(raster(f, ["c0", "c1", "c2"]), raster(f, ["spix"])[..., 0].astype(int), o, rounds))


def merge_loop_table(seg: DataFrame, options: Options | None = None, rounds: int = 4) -> tuple[DataFrame, DataFrame]:
    """merge_loop without a group a frame: candidates, scores and choices as joins and sums by region.

    Gives the labels (seg with spix renamed) and the accepted merges (round, t, spix, target). Each round ends in files.
    """
    from ..operators import regions, stencil
    from .loops import stored

    o, accepted = options or Options(), []
    extent = seg.groupBy(*stencil.frame_key(seg)).agg(F.max("y").alias("__last"))
    for k in range(rounds):
        stats = regions.moments(seg, squares=True)
        near = stencil.neighbours(seg, diagonal=False).join(extent, stencil.frame_key(seg)).where("s IS NOT NULL AND s <> spix AND y > 1 AND y < __last - 1")
        asked = near.groupBy(*regions.region_key(seg)).agg(F.max("s").alias("target"))
        found = stored(regions.merge_accepted(regions.merge_scores(asked, stats, o.sigma_app, o.alpha, o.merge_alpha)).withColumn("round", F.lit(k)), "merges")
        accepted.append(found)
        names = found.select(*regions.region_key(seg), F.col("target").alias("name"))
        seg = stored(seg.join(names, regions.region_key(seg), "left").withColumn("spix", F.coalesce("name", "spix")).drop("name"), "merged")
    out = accepted[0]
    for more in accepted[1:]:
        out = out.union(more)
    return seg, out


def fill_missing(seg: DataFrame) -> DataFrame:
    """Fills all pixels without a label from their regions' centres; disconnected pieces but the largest are filled anew."""

    def work(f: pd.DataFrame) -> np.ndarray:
        labels = raster(f.fillna({"spix": -1}), ["spix"])[..., 0].astype(int)
        size = max(1, int(labels.max()) + 1)
        y, x = np.mgrid[: labels.shape[0], : labels.shape[1]].astype(float)
        n = np.maximum(kernel.sums(labels, np.ones(labels.shape), size), 1)
        centre = np.stack([kernel.sums(labels, x, size) / n, kernel.sums(labels, y, size) / n], 1)
        return kernel.fill(kernel.largest_pieces(kernel.fill(labels, centre)), centre)

    return _each(seg, work)


def components_8(seg: DataFrame) -> DataFrame:
    """8-connected pieces of equal labels, named by their least pixel index."""
    return _each(seg, lambda f: kernel.pieces(raster(f.fillna({"spix": -1}), ["spix"])[..., 0].astype(int)))


def segment_videos(pixels: DataFrame, flows: DataFrame | None = None, options: Options | None = None) -> DataFrame:
    """Labels with stable ids through each video. flows: fx, fy of the motion from frame t to t + 1.

    Frames are packed in parallel, one row each; then a task reads the frames of its videos in order as a stream and holds
    one frame and the video's state, however long the video is. A missing frame is skipped and the state kept.
    """
    o = options or Options()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        video, state = None, None
        for batch in batches:
            for r in batch.itertuples():
                image, flow = image_of(r)
                if r.video != video:
                    video, state = r.video, None
                if state is None or state.labels.shape != image.shape[:2]:
                    state = kernel.first_frame(image, o)
                else:
                    state = kernel.next_frame(image, flow, state, o)
                yield rows(video, r.t, state.labels)

    return spread(packed(pixels, flows), "video").sortWithinPartitions("video", "t").mapInPandas(run, LABELS)
