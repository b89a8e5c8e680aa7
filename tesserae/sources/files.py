"""Readers and writers of the on-disk forms: images, motion fields, label matrices, point lists, meshes, results.

Files are listed and read by Spark (``binaryFile``, ``image``, ``csv``), so any path that Spark reads will do; a file is
decoded in one task. Files are written by the tasks that hold them. The engine's own storage form is Parquet partitioned
by video.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.color import lab_to_rgb, rgb_to_lab
from ..operators.stencil import frame_key
from ..plans.drivers import raster

PIXELS = "video string, t int, y int, x int, c0 float, c1 float, c2 float"
#: The tag of a motion file, which read as a float is 202021.25.
FLOW_TAG = b"PIEH"


def numbered(files: DataFrame, column: str = "path") -> DataFrame:
    """files with video (the folder's name) and t (the rank of the file's name in its folder)."""
    parts = files.withColumns({"video": F.element_at(F.split(column, "/"), -2), "name": F.element_at(F.split(column, "/"), -1)})
    return parts.withColumn("t", (F.row_number().over(Window.partitionBy("video").orderBy("name")) - 1).cast("int"))


def by_number(files: DataFrame, column: str = "path") -> DataFrame:
    """files with video and t, the five digits of the file's name; files without them are left out."""
    out = files.withColumns({"video": F.element_at(F.split(column, "/"), -2), "t": F.regexp_extract(column, r"(\d{5})\.[^/]*$", 1)})
    return out.where("t <> ''").withColumn("t", F.col("t").cast("int"))


def read_video(spark: SparkSession, path: str, order: str = "rgb") -> DataFrame:
    """Pixels of the images below path, 0 to 255; first three channels, in the order asked for."""
    images = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path).select("image.*")
    rows = numbered(images, "origin").select("video", "t", "height", "width", "nChannels", "data")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                a = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)
                a = np.repeat(a, 3, axis=2) if r.nChannels == 1 else a[..., :3]
                a = (a if order == "bgr" else a[..., ::-1]).reshape(-1, 3).astype(np.float32)
                y, x = np.mgrid[: r.height, : r.width]
                yield pd.DataFrame({"video": r.video, "t": np.int32(r.t), "y": y.ravel().astype(np.int32), "x": x.ravel().astype(np.int32), "c0": a[:, 0], "c1": a[:, 1], "c2": a[:, 2]})

    return rows.mapInPandas(decode, PIXELS)


def read_image(spark: SparkSession, path: str) -> DataFrame:
    """Pixels of one image, 0 to 1."""
    return read_video(spark, path).withColumns({f"c{i}": F.col(f"c{i}") / 255 for i in range(3)})


def read_truth(spark: SparkSession, path: str, threshold: int | None = 128) -> DataFrame:
    """Ground truth from the first channel: 0 or 1 by a threshold, or the raw value."""
    px = read_video(spark, path)
    gt = F.when(F.col("c0") >= threshold, 1).otherwise(0) if threshold is not None else F.col("c0")
    return px.select("video", "t", "y", "x", gt.cast("int").alias("gt"))


def read_truth_objects(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One folder an object: gt is the number (from 1) of the last object, by folder name, that covers a pixel."""
    parts = [read_truth(spark, p, 1).where("gt > 0").select("t", "y", "x", F.lit(k + 1).alias("gt")) for k, p in enumerate(sorted(paths))]
    grid = read_truth(spark, sorted(paths)[0], 1).select("t", "y", "x")
    union = parts[0]
    for p in parts[1:]:
        union = union.union(p)
    return grid.join(union.groupBy("t", "y", "x").agg(F.max("gt").alias("gt")), ["t", "y", "x"], "left").fillna(0, ["gt"])


def resize(pixels: DataFrame, height: int, width: int, from_height: int, from_width: int) -> DataFrame:
    """Bilinear: each target pixel is the weighted sum of four source pixels, found by an equi-join on their place."""
    sy, sx = from_height / height, from_width / width
    spark = pixels.sparkSession
    grid = spark.range(height * width).select(F.expr(f"cast(id div {width} AS int)").alias("ty"), F.expr(f"cast(id % {width} AS int)").alias("tx"))
    grid = grid.withColumns({"fy": F.greatest((F.col("ty") + 0.5) * sy - 0.5, F.lit(0.0)), "fx": F.greatest((F.col("tx") + 0.5) * sx - 0.5, F.lit(0.0))})
    corners = F.array(*(F.struct(F.least(F.floor("fy") + j, F.lit(from_height - 1)).cast("int").alias("y"), F.least(F.floor("fx") + i, F.lit(from_width - 1)).cast("int").alias("x"), (((F.col("fy") - F.floor("fy")) if j else (1 - (F.col("fy") - F.floor("fy")))) * ((F.col("fx") - F.floor("fx")) if i else (1 - (F.col("fx") - F.floor("fx"))))).alias("w")) for j in (0, 1) for i in (0, 1)))
    taps = grid.select("ty", "tx", F.explode(corners).alias("k")).select("ty", "tx", "k.y", "k.x", "k.w")
    keys = [c for c in ("video", "t") if c in pixels.columns]
    out = pixels.join(taps, ["y", "x"]).groupBy(*keys, "ty", "tx").agg(*(F.sum(F.col(f"c{i}") * F.col("w")).alias(f"c{i}") for i in range(3)))
    return out.withColumnsRenamed({"ty": "y", "tx": "x"})


def decode_flow(content: bytes, precision: int = 32) -> np.ndarray:
    """(height, width, 2) of a motion file; a wrong tag, size or a value that is no number is an error."""
    if content[:4] != FLOW_TAG:
        raise ValueError("not a motion file")
    width, height = struct.unpack("<ii", content[4:12])
    kind = np.dtype("<f4" if precision == 32 else "<f2")
    if width <= 0 or height <= 0 or len(content) < 12 + width * height * 2 * kind.itemsize:
        raise ValueError("a motion file of the wrong size")
    out = np.frombuffer(content, kind, width * height * 2, 12).reshape(height, width, 2).astype(np.float32)
    if np.isnan(out).any():
        raise ValueError("a motion file with values that are no numbers")
    return out


def encode_flow(flow: np.ndarray) -> bytes:
    h, w = flow.shape[:2]
    return FLOW_TAG + struct.pack("<ii", w, h) + np.ascontiguousarray(flow, "<f4").tobytes()


def read_flows(spark: SparkSession, path: str, precision: int = 32) -> DataFrame:
    files = numbered(spark.read.format("binaryFile").option("pathGlobFilter", "*.flo").option("recursiveFileLookup", True).load(path).select("path", "content"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                a = decode_flow(r.content, precision)
                y, x = np.mgrid[: a.shape[0], : a.shape[1]]
                yield pd.DataFrame({"video": r.video, "t": np.int32(r.t), "y": y.ravel().astype(np.int32), "x": x.ravel().astype(np.int32), "fx": a[..., 0].ravel(), "fy": a[..., 1].ravel()})

    return files.select("video", "t", "content").mapInPandas(decode, "video string, t int, y int, x int, fx float, fy float")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label matrices without header, one file a frame, named by five digits; -1 becomes null."""
    files = by_number(spark.read.format("binaryFile").option("pathGlobFilter", "[0-9][0-9][0-9][0-9][0-9].csv").option("recursiveFileLookup", True).load(path).select("path", "content"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                a = np.array([[int(float(v)) for v in line.split(",")] for line in r.content.decode().splitlines() if line], np.int32)
                y, x = np.mgrid[: a.shape[0], : a.shape[1]]
                yield pd.DataFrame({"video": r.video, "t": np.int32(r.t), "y": y.ravel().astype(np.int32), "x": x.ravel().astype(np.int32), "spix": a.ravel()})

    out = files.select("video", "t", "content").mapInPandas(decode, "video string, t int, y int, x int, spix int")
    return out.withColumn("spix", F.when(F.col("spix") >= 0, F.col("spix")))


def label_matrices(seg: DataFrame) -> DataFrame:
    """[video,] t and content: each frame's labels as comma-separated lines, null as -1. Rows are put together natively."""
    frame = frame_key(seg)
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", F.coalesce("spix", F.lit(-1)).alias("s")))), lambda p: p["s"].cast("string")), ",")
    rows = seg.groupBy(*frame, "y").agg(line.alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "line"))), lambda r: r["line"]), "\n")
    return rows.groupBy(*frame).agg(F.concat(text, F.lit("\n")).alias("content"))


def write_files(contents: DataFrame, folder: str, suffix: str) -> int:
    """Writes content (string or binary) to folder/[video/]%05d + suffix, or for scenes to folder/scene + suffix; returns
    how many files there are.

    The tasks that hold the contents write them through pyarrow's file systems (local, hdfs, s3, gs by the folder's
    scheme). A file is written under a name of its own and then moved, so a task that runs twice leaves whole files.
    """
    name = F.col("scene") if "scene" in contents.columns else F.format_string("%05d", "t")
    parts = [F.col("video"), name] if "video" in contents.columns else [name]
    rows = contents.select(F.concat(F.concat_ws("/", *parts), F.lit(suffix)).alias("name"), F.col("content").cast("binary").alias("content"))
    where = re.sub(r"^file:/*", "file:///", folder) if folder.startswith("file:") else folder if "://" in folder else f"file://{folder}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(where)
        for batch in batches:
            for k in range(len(batch)):
                path = f"{base}/{batch.column(0)[k].as_py()}"
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                fresh = f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
                with system.open_output_stream(fresh) as out:
                    out.write(batch.column(1)[k].as_py())
                system.move(fresh, path)
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], names=["n"])

    return rows.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def png(image: np.ndarray) -> bytes:
    """An 8-bit RGB image (height, width, 3) as PNG."""
    h, w = image.shape[:2]

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    lines = b"".join(b"\0" + np.ascontiguousarray(image[y], np.uint8).tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def images(pixels: DataFrame, scale: float = 1.0) -> DataFrame:
    """[video,] t and content: each frame as PNG bytes."""
    return _packed(pixels, lambda f: png(np.clip(raster(f, ["c0", "c1", "c2"]) * scale, 0, 255).round().astype(np.uint8)))


def _packed(rows: DataFrame, encode) -> DataFrame:
    """[video,] t and content, which encode makes of the rows of a frame."""
    frame = frame_key(rows)

    def pack(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({**{c: [v] for c, v in zip(frame, key, strict=True)}, "content": [encode(f)]}).astype({"t": "int32"})

    return rows.groupBy(*frame).applyInPandas(pack, ", ".join(f"{c} {'int' if c == 't' else 'string'}" for c in frame) + ", content binary")


def flow_files(flows: DataFrame) -> DataFrame:
    """[video,] t and content: each frame's motion as the bytes of a motion file."""
    return _packed(flows, lambda f: encode_flow(raster(f, ["fx", "fy"])))


#: The columns of a file of region parameters.
PARAMETER_COLUMNS = ("label", "mu_i.x", "mu_i.y", "mu_i.z", "p_mu_i.x", "p_mu_i.y", "p_mu_i.z", "mu_s.x", "mu_s.y", "sigma_s.x", "sigma_s.y", "sigma_s.z", "prior_icov.x", "prior_icov.y", "prior_icov.z", "count", "prior_count")


def parameter_table(params: DataFrame, prior_count: float) -> DataFrame:
    """Region parameters under the names of PARAMETER_COLUMNS, ready for ``write.csv(header=True)``."""
    mu = [F.col(f"mu{i}") for i in range(3)]
    values = [F.col("spix"), *mu, *mu, F.col("mx"), F.col("my"), F.col("ixx"), F.col("ixy"), F.col("iyy"), F.lit(1.0), F.lit(0.0), F.lit(1.0), F.col("n"), F.lit(float(prior_count))]
    return params.select(*(v.alias(n) for n, v in zip(PARAMETER_COLUMNS, values, strict=True)))


_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}


def decode_ply(content: bytes) -> dict[str, dict]:
    """Elements of a PLY file (ascii or little-endian binary): columns by element; list properties as lists."""
    end = content.index(b"end_header") + len(b"end_header")
    end = content.index(b"\n", end - 1) + 1
    head = content[:end].decode("ascii", "replace").split("\n")
    ascii_form = any(x.startswith("format ascii") for x in head)
    elements: list[tuple[str, int, list]] = []
    for x in head:
        w = x.split()
        if w[:1] == ["element"]:
            elements.append((w[1], int(w[2]), []))
        elif w[:1] == ["property"]:
            elements[-1][2].append((w[-1], _TYPES[w[-2]], _TYPES[w[2]] if w[1] == "list" else None))
    out: dict[str, dict] = {}
    if ascii_form:
        words = iter(content[end:].split())
        for name, n, props in elements:
            columns: dict = {p: [] for p, _, _ in props}
            for _ in range(n):
                for p, kind, size in props:
                    read = float if kind[0] == "f" else int
                    columns[p].append([read(next(words)) for _ in range(int(next(words)))] if size else read(next(words)))
            out[name] = columns
        return out
    at = end
    for name, n, props in elements:
        if all(s is None for _, _, s in props):
            kind = np.dtype([(p, "<" + k) for p, k, _ in props])
            a = np.frombuffer(content, kind, n, at)
            at += n * kind.itemsize
            out[name] = {p: a[p].tolist() for p, _, _ in props}
            continue
        columns = {p: [] for p, _, _ in props}
        for _ in range(n):
            for p, k, s in props:
                if s is None:
                    columns[p].append(np.frombuffer(content, "<" + k, 1, at)[0].item())
                    at += np.dtype(k).itemsize
                else:
                    m = int(np.frombuffer(content, "<" + s, 1, at)[0])
                    at += np.dtype(s).itemsize
                    columns[p].append(np.frombuffer(content, "<" + k, m, at).tolist())
                    at += m * np.dtype(k).itemsize
        out[name] = columns
    return out


def encode_ply(elements: dict[str, tuple[list[tuple[str, str]], list[tuple]]]) -> bytes:
    """A binary PLY: by element its properties (name, type; "list" for int lists) and its rows."""
    head, body = ["ply", "format binary_little_endian 1.0"], []
    for name, (props, rows) in elements.items():
        head += [f"element {name} {len(rows)}", *(f"property list uchar int {p}" if k == "list" else f"property {k} {p}" for p, k in props)]
        for row in rows:
            for (_, k), v in zip(props, row, strict=True):
                body.append(struct.pack("<B", len(v)) + np.array(v, "<i4").tobytes() if k == "list" else np.array(v, "<" + _TYPES[k]).tobytes())
    return "\n".join([*head, "end_header", ""]).encode() + b"".join(body)


def read_scenes(spark: SparkSession, path: str, lab: bool = True) -> tuple[DataFrame, DataFrame]:
    """Vertices (scene, v, px, py, pz, f0-2: Lab, or RGB from 0 to 1) and faces (scene, f, verts) of PLY files; an
    ``axisAlignment`` line of 16 numbers in a .txt file of the same name moves the vertices."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ply").option("recursiveFileLookup", True).load(path)
    files = files.select(F.regexp_extract("path", r"([^/]+)\.ply$", 1).alias("scene"), "content")
    notes = spark.read.text(path, pathGlobFilter="*.txt", recursiveFileLookup=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("scene"), "value").where("value LIKE 'axisAlignment%'")
    files = files.join(notes.groupBy("scene").agg(F.first("value").alias("turn")), "scene", "left")

    def points(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                v = decode_ply(r.content)["vertex"]
                xyz = np.stack([np.array(v[k], float) for k in "xyz"], 1).reshape(-1, 3)
                if isinstance(r.turn, str):
                    m = np.array([float(x) for x in re.findall(r"[-+.\deE]+", r.turn.split("=", 1)[-1])][:16]).reshape(4, 4)
                    xyz = xyz @ m[:3, :3].T + m[:3, 3]
                rgb = np.stack([np.array(v.get(k, [0] * len(xyz)), float) / 255 for k in ("red", "green", "blue")], 1)
                yield pd.DataFrame({"scene": r.scene, "v": np.arange(len(xyz), dtype=np.int32), **{f"p{k}": xyz[:, i] for i, k in enumerate("xyz")}, **{f"f{i}": rgb[:, i] for i in range(3)}})

    def polygons(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                faces = next(iter(decode_ply(r.content).get("face", {"": []}).values()))
                yield pd.DataFrame({"scene": r.scene, "f": np.arange(len(faces), dtype=np.int32), "verts": pd.Series(faces, dtype=object)})

    vertices = files.mapInPandas(points, "scene string, v int, px double, py double, pz double, f0 double, f1 double, f2 double")
    if lab:
        vertices = vertices.withColumns({f"f{i}": c for i, c in enumerate(rgb_to_lab(F.col("f0"), F.col("f1"), F.col("f2")))})
    return vertices, files.select("scene", "content").mapInPandas(polygons, "scene string, f int, verts array<int>")


def scene_files(vertices: DataFrame, faces: DataFrame, edges: DataFrame | None = None, lab: bool = False) -> DataFrame:
    """scene and content: binary PLY with colours (f0-2: RGB from 0 to 1, or Lab), gcolor and label where vertices have them.

    vertices: scene, v, px, py, pz, f0-2[, gcolor][, spix]; faces: scene, f, verts; edges: scene, u, v, written as their
    own element. One task a scene.
    """
    if lab:
        vertices = vertices.withColumns({f"f{i}": c for i, c in enumerate(lab_to_rgb(F.col("f0"), F.col("f1"), F.col("f2")))})
    ends = faces.groupBy("scene").agg(F.collect_list(F.struct("f", "verts")).alias("faces"))
    if edges is not None:
        ends = ends.join(edges.groupBy("scene").agg(F.array_sort(F.collect_list(F.struct("u", "v"))).alias("edges")), "scene", "full")
    extra = [(c, k, n) for c, k, n in (("gcolor", "uchar", "gcolor"), ("spix", "uint", "label")) if c in vertices.columns]

    def pack(key: tuple, v: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        v = v.sort_values("v")
        rgb = np.clip(v[["f0", "f1", "f2"]].to_numpy(float) * 255, 0, 255).round().astype(int)
        props = [("x", "float"), ("y", "float"), ("z", "float"), ("red", "uchar"), ("green", "uchar"), ("blue", "uchar"), ("alpha", "uchar"), *((n, k) for _, k, n in extra)]
        rows = [(*p, *c, 255, *e) for p, c, e in zip(v[["px", "py", "pz"]].to_numpy(float).tolist(), rgb.tolist(), v[[c for c, _, _ in extra]].to_numpy().astype(int).tolist() if extra else [()] * len(v), strict=True)]
        found = sorted((int(x["f"]), list(x["verts"])) for cell in f["faces"] if cell is not None for x in cell)
        elements = {"vertex": (props, rows), "face": ([("vertex_indices", "list")], [(x,) for _, x in found])}
        if "edges" in f:
            elements["edge"] = ([("vertex1", "int"), ("vertex2", "int")], [(int(x["u"]), int(x["v"])) for cell in f["edges"] if cell is not None for x in cell])
        content = encode_ply(elements)
        return pd.DataFrame({"scene": [key[0]], "content": [content]})

    return vertices.groupBy("scene").cogroup(ends.groupBy("scene")).applyInPandas(pack, "scene string, content binary")


def region_files(regions: DataFrame) -> DataFrame:
    """scene and content: a PLY of regions with their position, variances, covariances and colour.

    regions: scene, spix, m_px-z, ixx, iyy, izz, ixy, ixz, iyz, m_f0-2.
    """
    names = ["x", "y", "z", "var_x", "var_y", "var_z", "cov_xy", "cov_xz", "cov_yz"]
    columns = ["m_px", "m_py", "m_pz", "ixx", "iyy", "izz", "ixy", "ixz", "iyz"]

    def pack(key: tuple, r: pd.DataFrame) -> pd.DataFrame:
        r = r.sort_values("spix")
        rgb = np.clip(r[["m_f0", "m_f1", "m_f2"]].to_numpy(float) * 255, 0, 255).round().astype(int)
        props = [*((n, "float") for n in names), ("red", "uchar"), ("green", "uchar"), ("blue", "uchar"), ("alpha", "uchar")]
        return pd.DataFrame({"scene": [key[0]], "content": [encode_ply({"vertex": (props, [(*p, *c, 255) for p, c in zip(r[columns].to_numpy(float).tolist(), rgb.tolist(), strict=True)])})]})

    return regions.groupBy("scene").applyInPandas(pack, "scene string, content binary")


def boxes(vertices: DataFrame) -> DataFrame:
    return vertices.groupBy("scene").agg(*(f(c).alias(n + c[1]) for c in ("px", "py", "pz") for f, n in ((F.min, "min_"), (F.max, "max_"))))


def read_off(spark: SparkSession, path: str) -> DataFrame:
    """cloud, i, x, y, z of the points of OFF files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.off").option("recursiveFileLookup", True).load(path).select(F.regexp_extract("path", r"([^/]+)\.off$", 1).alias("cloud"), "content")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                words = r.content.decode().split()
                if words[0] != "OFF":
                    raise ValueError("not an OFF file")
                n = int(words[1])
                a = np.array(words[4 : 4 + 3 * n], float).reshape(n, 3)
                yield pd.DataFrame({"cloud": r.cloud, "i": np.arange(n, dtype=np.int32), "x": a[:, 0], "y": a[:, 1], "z": a[:, 2]})

    return files.mapInPandas(decode, "cloud string, i int, x double, y double, z double")


def unit_cube(points: DataFrame) -> DataFrame:
    """Each cloud moved and scaled, alike on all axes, into the unit cube."""
    ends = points.groupBy("cloud").agg(*(f(c).alias(n + c) for c in "xyz" for f, n in ((F.min, "lo_"), (F.max, "hi_"))))
    side = F.greatest(*(F.col(f"hi_{c}") - F.col(f"lo_{c}") for c in "xyz"), F.lit(1e-12))
    return points.join(F.broadcast(ends), "cloud").select("cloud", "i", *(((F.col(c) - F.col(f"lo_{c}")) / side).alias(c) for c in "xyz"))


def every_nth(points: DataFrame, step: int) -> DataFrame:
    return points.where(F.col("i") % step == 0)


def read_results(spark: SparkSession, path: str) -> DataFrame | None:
    """A CSV file of results with a header; None where there is no file, or no header that names columns."""
    try:
        found = spark.read.csv(path, header=True, inferSchema=True)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    return found if found.columns else None


def write_results(results: DataFrame, path: str, keys: tuple[str, ...] = ("group", "id", "rep")) -> None:
    """Adds results, partitioned by their keys; those with the same keys are replaced."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def append_trace(seg: DataFrame, path: str, step: str, seq: int) -> None:
    """Adds a snapshot of labels to a log that is partitioned by step."""
    seg.select("t", "y", "x", "spix", F.lit(seq).alias("seq"), F.lit(step).alias("step")).write.mode("append").partitionBy("step").parquet(path)


def label_changes(trace: DataFrame) -> DataFrame:
    """step, seq, t, old, new and n of the labels that change from one snapshot to the next."""
    was = F.lag("spix").over(Window.partitionBy("step", "t", "y", "x").orderBy("seq"))
    return trace.withColumn("old", was).where("old <> spix").groupBy("step", "seq", "t", "old", F.col("spix").alias("new")).agg(F.count("*").alias("n"))
