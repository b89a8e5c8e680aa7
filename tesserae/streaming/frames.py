"""Stable regions on a stream of frames: one keyed state for each video, which holds a row for each region."""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..plans import frame as kernel
from ..plans.drivers import FRAMES, image_of, packed  # noqa: F401
from ..plans.frame import Options, State
from ..plans.loops import spread, stored

OUTPUT = "video string, t int, late boolean, height int, width int, labels binary"
#: What is kept of each id: State's arrays, flat.
_WIDTHS = {"n": 1, "mu": 3, "centre": 2, "inverse": 3, "sample": 3, "prior_count": 1}
#: Bytes of frames that a task holds until they are put aside, of a part of those in the store, and of rows given at once.
_HELD, _PART, _GIVEN = 1 << 25, 1 << 18, 1 << 22
_REGION = ", ".join(f"{name}{i} double" for name, width in _WIDTHS.items() for i in range(width))


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that keyed collections need; where the session has another one, it is set for streams started later."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def unpacked(labelled: DataFrame) -> DataFrame:
    """Rows (video, t, y, x, spix) of the frames that weren't late."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                y, x = np.mgrid[: r.height, : r.width]
                yield pd.DataFrame({"video": r.video, "t": np.int32(r.t), "y": y.ravel().astype(np.int32), "x": x.ravel().astype(np.int32), "spix": np.frombuffer(r.labels, "<i4")})

    return spread(labelled.where("NOT late"), "video", "t").mapInPandas(unpack, "video string, t int, y int, x int, spix int")


def write_backlog(frames: DataFrame, folder: str, least: int = 4, most_files: int = 25) -> None:
    """Writes FRAMES rows as files in the order of t, for a stream that takes one file a micro-batch: so many frames in a
    file, and more where the files would be too many. A micro-batch costs the same however few frames it has."""
    frames = stored(frames, "backlog")
    each = max(least, -(-frames.count() // most_files))
    frames.repartition(1).sortWithinPartitions("t").write.option("maxRecordsPerFile", each).parquet(folder)


class Given:
    """OUTPUT rows of a video until they are given, many at once."""

    def __init__(self, video: str):
        self.video, self.held, self.size = video, [], 0

    def add(self, t: int, late: bool, height: int, width: int, labels: bytes) -> None:
        self.held.append((self.video, np.int32(t), late, np.int32(height), np.int32(width), labels))
        self.size += 100 + len(labels)

    def rows(self) -> pd.DataFrame:
        out = pd.DataFrame(self.held, columns=["video", "t", "late", "height", "width", "labels"])
        self.held, self.size = [], 0
        return out


class Regions(StatefulProcessor):
    """State of a video: the last frame's number and labels; a row for each id ever seen; frames that wait for their turn.

    The frames of a micro-batch are held up to a number of bytes; of more, sorted runs are put aside in the store, a few frames
    in a part, and merged in order of t, so a task holds one part of each run however many frames arrive together. A frame not
    after the last one is late: it gives a row without labels and leaves the state alone. A frame that never comes is skipped.
    After a micro-batch the rows of those ids are written that were alive in it.
    """

    def __init__(self, options: Options):
        self.options = options

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "t int, height int, width int, labels binary")
        self.regions = handle.getMapState("regions", "spix int", _REGION)
        self.waiting = handle.getMapState("waiting", "run int, part int", "frames binary")

    def _load(self) -> tuple[int, State | None]:
        if not self.last.exists():
            return -1, None
        t, height, width, blob = self.last.get()
        held = {key[0]: value for key, value in self.regions.iterator()}
        size = max(held) + 1 if held else 0
        table = np.zeros((size, sum(_WIDTHS.values())))
        for i, value in held.items():
            table[i] = value
        columns, at = {}, 0
        for name, wide in _WIDTHS.items():
            columns[name] = table[:, at] if wide == 1 else table[:, at : at + wide]
            at += wide
        return t, State(np.frombuffer(blob, "<i4").reshape(height, width).astype(np.int64), **{k: v.copy() for k, v in columns.items()})

    def _store(self, last: int, state: State, alive: np.ndarray) -> None:
        table = np.column_stack([getattr(state, name) for name in _WIDTHS])
        for i in alive.tolist():
            self.regions.updateValue((i,), tuple(table[i].tolist()))
        self.last.update((last, *state.labels.shape, state.labels.astype("<i4").tobytes()))

    def _put_aside(self, run: int, frames: list[tuple]) -> Iterator[tuple]:
        """Puts frames into the store, in order of t; gives them back part by part, and the store forgets them."""
        parts: list[list[tuple]] = [[]]
        size = 0
        for f in sorted(frames, key=lambda f: f[0]):
            if size > _PART:
                parts.append([])
                size = 0
            parts[-1].append(f)
            size += len(f[3]) + len(f[4])
        for i, part in enumerate(parts):
            self.waiting.updateValue((run, i), (pickle.dumps(part),))
        return self._back(run, len(parts))

    def _back(self, run: int, n: int) -> Iterator[tuple]:
        for i in range(n):
            (data,) = self.waiting.getValue((run, i))
            self.waiting.removeKey((run, i))
            yield from pickle.loads(data)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, state = self._load()
        turns, alive, runs, held, size, given = set(), set(), [], [], 0, Given(key[0])
        for batch in rows:
            for r in batch.itertuples():
                if r.t <= last or r.t in turns:
                    given.add(r.t, True, r.height, r.width, b"")
                    if given.size > _GIVEN:
                        yield given.rows()
                    continue
                turns.add(int(r.t))
                held.append((int(r.t), int(r.height), int(r.width), r.image, r.flow))
                size += len(r.image) + len(r.flow)
                if size > _HELD:
                    runs.append(self._put_aside(len(runs), held))
                    held, size = [], 0
        for t, height, width, image, flow in heapq.merge(*runs, sorted(held, key=lambda f: f[0]), key=lambda f: f[0]):
            image, flow = (np.frombuffer(data, "<f4").reshape(height, width, -1).astype(float) for data in (image, flow))
            if state is None or state.labels.shape != image.shape[:2]:
                self.regions.clear()
                state, alive = kernel.first_frame(image, self.options), set()
            else:
                state = kernel.next_frame(image, flow, state, self.options)
            last = t
            alive.update(np.unique(state.labels).tolist())
            given.add(t, False, height, width, state.labels.astype("<i4").tobytes())
            if given.size > _GIVEN:
                yield given.rows()
        if given.held:
            yield given.rows()
        if turns:
            self._store(last, state, np.array(sorted(alive), np.int64))

    def close(self) -> None:
        pass


def labelled(frames: DataFrame, options: Options | None = None) -> DataFrame:
    """A stream of FRAMES rows to a stream of OUTPUT rows: labels, and late frames as rows of their own.

    No watermark is needed, as t only counts up.
    """
    use_rocksdb(frames.sparkSession)
    return frames.groupBy("video").transformWithStateInPandas(Regions(options or Options()), OUTPUT, "Append", "None")
