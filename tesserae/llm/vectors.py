"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Rotations learned on a bounded sample turn vectors into balanced codes of 64 bits a rotation. Codes are cut into pieces,
one table each; a bucket holds the codes with one value of a piece, and is compared with itself and with the buckets
whose value differs in one bit. The width of a piece grows with the logarithm of the number of vectors of a label, so
that buckets stay about as large; the number of tables follows from the width, so that vectors at the least cosine are
missed by all tables with a probability of MISS at most (by none for pieces of 8 bits, up to RADIUS bits). Pairs of codes
found are packed into tiles of at most SIDE x SIDE vectors, and the tiles are reranked with the original vectors. A tile
gives back counts and a spanning set of its links, so the pairs of a dense group are counted but never written out. Equal
vectors of a label are one, with a weight.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, signed, stored
from .components import components

LEAST_COSINE, RADIUS, SIDE = 0.93, 15, 256
#: Width of a piece up to 2 ** (8 + SPARE) vectors of a label; at most WIDEST.
NARROWEST, WIDEST, SPARE, MISS = 8, 32, 7, 0.01
#: Codes in a part of a table's bucket; a larger bucket is split into parts that are compared two by two.
PART = 4096
SAMPLE, BROADCAST_BUCKETS = 20_000, 1_000_000


def tables_of(n: int) -> tuple[int, int]:
    """Width of a piece and number of tables for labels of up to n vectors."""
    width = min(WIDEST, max(NARROWEST, math.ceil(math.log2(max(n, 1))) - SPARE))
    if width == NARROWEST:
        return width, 64 // NARROWEST
    p = math.acos(LEAST_COSINE) / math.pi  # that a bit differs
    near = (1 - p) ** width + width * p * (1 - p) ** (width - 1)
    return width, math.ceil(math.log(MISS) / math.log(1 - near))


def unit_rows(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of that many components scaled to length 1 in double precision, and which rows are usable."""
    n = len(column)
    out, usable = np.zeros((n, width)), np.zeros(n, bool)
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), width), False)
    at, flat = np.flatnonzero(fits.to_numpy(zero_copy_only=False)), pc.list_flatten(column.filter(fits))
    if len(at) and width:
        out[at] = pc.fill_null(flat.cast(pa.float64()), math.nan).to_numpy(zero_copy_only=False).reshape(-1, width)
        usable[at] = True
    with np.errstate(over="ignore", invalid="ignore"):
        top = np.abs(out).max(axis=1, initial=0)
        usable &= np.isfinite(top) & (top > 0)
        out[~usable] = 0
        out /= np.where(usable, top, 1)[:, None]
        out /= np.maximum(np.sqrt((out * out).sum(axis=1)), 1e-300)[:, None]
    return out, usable


class Rotation:
    """Principal axes and learned rotations of 64 bits each; encode() gives the codes' bytes.

    Vectors aren't centred: links are angles at the origin, and a group that holds most of the sample would else sit
    on all the planes that cut the codes. Each rotation is learned from a random start of its own.
    """

    def __init__(self, sample: np.ndarray, words: int = 1, rounds: int = 30, seed: int = 0):
        width = sample.shape[1]
        _, main = np.linalg.eigh(sample.T @ sample / max(1, len(sample)) + 1e-12 * np.eye(width))
        turns = []
        for word in range(words):
            axes, rng = main[:, ::-1][:, :64], np.random.default_rng(seed + word)
            if axes.shape[1] < 64:  # fewer components than bits: the rest of the bits are random directions
                axes = np.hstack([axes, rng.normal(size=(width, 64 - axes.shape[1]))])
            turn = np.linalg.qr(rng.normal(size=(64, 64)))[0]
            flat = sample @ axes
            for _ in range(rounds if len(sample) else 0):
                u, _, v = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
                turn = (u @ v).T
            turns.append(axes @ turn)
        self.turn = np.hstack(turns)

    def encode(self, unit: np.ndarray) -> np.ndarray:
        """The codes of the vectors, one row of bytes each."""
        return np.packbits(unit @ self.turn > 0, axis=1, bitorder="little")


def learn(vectors: DataFrame, width: int, words: int, sample: int = SAMPLE) -> Rotation:
    """Fits on the driver to the usable vectors among so many rows at most, picked by a hash of vec_id."""
    rows = vectors.where("embedding IS NOT NULL").select("embedding", F.xxhash64("vec_id").alias("o"), "vec_id").orderBy("o", "vec_id").limit(sample).select("embedding")
    table = rows.toArrow()
    unit, usable = unit_rows(table.column(0).combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.float32())), width)
    return Rotation(unit[usable], words)


def pieces_of(codes: np.ndarray, width: int, tables: int) -> np.ndarray:
    """The values of the codes' pieces, one row a code."""
    bits = np.unpackbits(codes, axis=1, bitorder="little")[:, : width * tables].reshape(len(codes), tables, width)
    return bits.astype(np.int64) @ (np.int64(1) << np.arange(width, dtype=np.int64))


def encode(vectors: DataFrame, rotations: dict[int, Rotation], width: int, tables: int) -> DataFrame:
    """vec_id, weight, label, size, code and the values of its pieces, of the rows that can link, each size under its own rotation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column(3))
            for size in set(sizes.to_pylist()) & rotations.keys():
                part = batch.filter(pc.equal(sizes, size))
                unit, usable = unit_rows(part.column(3), size)
                part, codes = part.filter(pa.array(usable)), rotations[size].encode(unit[usable])
                pieces = pa.array(pieces_of(codes, width, tables).tolist(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(3)), pa.array(np.full(len(part), size, np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pieces], names=["vec_id", "weight", "label", "size", "code", "pieces"])

    kind = vectors.schema["label"].dataType.simpleString()
    rows = vectors.where("vec_id IS NOT NULL AND label IS NOT NULL").select("vec_id", "weight", "label", "embedding")
    return rows.mapInArrow(run, f"vec_id long, weight long, label {kind}, size int, code binary, pieces array<long>")


def cells(codes: DataFrame, width: int) -> DataFrame:
    """cell, tab, self, side, vec_id, weight, code: every code in the cells of its bucket with itself and with each bucket
    that differs in one bit. Buckets of more than PART codes are split into parts, which are paired too."""
    rows = codes.select("vec_id", "weight", F.struct("label", "size").alias("label"), "code", F.posexplode("pieces").alias("tab", "own"))
    buckets = rows.groupBy("label", "tab", "own").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    if buckets.count() <= BROADCAST_BUCKETS:
        buckets = F.broadcast(buckets)
    rows = rows.join(buckets, ["label", "tab", "own"]).withColumnRenamed("parts", "own_parts")
    rows = rows.withColumn("other", F.explode(F.expr(f"transform(sequence(0, {width}), b -> IF(b = {width}, own, own ^ shiftleft(1L, b)))")))
    rows = rows.join(buckets.withColumnRenamed("own", "other"), ["label", "tab", "other"])
    rows = rows.withColumn("part", F.expr("cast(pmod(xxhash64(vec_id), own_parts) AS int)")).withColumn("facing", F.explode(F.expr("sequence(0, parts - 1)")))
    low = F.expr("own < other OR own = other AND part <= facing")
    return rows.select(F.xxhash64("label", "tab", F.least("own", "other"), F.greatest("own", "other"), F.when(low, F.col("part")).otherwise(F.col("facing")), F.when(low, F.col("facing")).otherwise(F.col("part"))).alias("cell"), "tab", F.expr("own = other AND part = facing").alias("self"), F.when(low, 0).otherwise(1).alias("side"), "vec_id", "weight", "code")


def near_codes(x: np.ndarray, y: np.ndarray, tab: int, width: int) -> np.ndarray:
    """Which pairs of codes (rows of bytes) are within RADIUS bits of 64 and meet in no table before this one."""
    differ = x[:, None, :] ^ y[None, :, :]
    near = np.bitwise_count(differ).sum(axis=2, dtype=np.int32) <= RADIUS * x.shape[1] // 8
    i, j = np.nonzero(near)
    bits = np.unpackbits(differ[i, j], axis=1, bitorder="little")[:, : width * tab].reshape(len(i), tab, width)
    near[i, j] = (bits.sum(axis=2, dtype=np.int32) > 1).all(axis=1)
    return near


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of the rows of each key in the first column; the rows come sorted by it."""
    held: list[np.ndarray] = []
    for batch in batches:
        columns = [np.asarray(c) if not pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held:
            columns = [np.append(h, c) for h, c in zip(held, columns, strict=True)]
        if not len(columns[0]):
            continue
        edge = np.flatnonzero(np.append(True, columns[0][1:] != columns[0][:-1]))
        for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            yield [c[s:e] for c in columns]
        held = [c[edge[-1] :] for c in columns]
    if held:
        yield held


def code_rows(codes: np.ndarray) -> np.ndarray:
    """Codes of one length as rows of bytes."""
    return np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)


def _tiles(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """tile, tab, self, side, vec_id, weight, code of the vectors with a near code in a cell, SIDE x SIDE of them at most."""
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["tile", "tab", "self", "side", "vec_id", "weight", "code"])

    for cell, tab, own, side, vec, weight, code in _groups(batches):
        if len(vec) < 2 or not own[0] and (side[0] == side[-1]):
            continue
        bits = code_rows(code)
        left, right = (np.arange(len(vec)),) * 2 if own[0] else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        for a in range(0, len(left), SIDE):
            for b in range(a if own[0] else 0, len(right), SIDE):
                x, y = left[a : a + SIDE], right[b : b + SIDE]
                near = near_codes(bits[x], bits[y], int(tab[0]), width)
                within = bool(own[0]) and a == b
                if within:
                    near = np.triu(near, 1)
                rows, columns = near.any(axis=1), near.any(axis=0)
                if not rows.any():
                    continue
                tile = signed(mix(np.array([cell[0]]).view(np.uint64) + np.uint64(a * 1_000_003 + b)))[0]
                members = [(x[rows | columns], 0)] if within else [(x[rows], 0), (y[columns], 1)]
                for m, s in members:
                    out.append((np.full(len(m), tile), np.full(len(m), tab[0], np.int32), np.full(len(m), within), np.full(len(m), s, np.int32), vec[m], weight[m], code[m]))
        if sum(len(o[0]) for o in out[-1:]) and len(out) > 2000:
            yield flush()
            out = []
    if out:
        yield flush()


def _rerank(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """a, b, n: a counts n further links (b null), or a and b belong to one component (n = 0)."""
    for _, tab, own, side, vec, weight, code, unit in _groups(batches):
        order = np.lexsort((vec, side))
        vec, weight, bits, side = vec[order], weight[order], code_rows(code[order]), side[order]
        unit = np.stack([np.frombuffer(u, np.float64) for u in unit[order]])
        if own[0]:
            x = y = np.arange(len(vec))
        else:
            x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        near = near_codes(bits[x], bits[y], int(tab[0]), width) & (unit[x] @ unit[y].T >= LEAST_COSINE) & (vec[x][:, None] != vec[y][None, :])
        if own[0]:
            near = np.triu(near, 1)
        counts = np.zeros(len(vec), np.int64)
        counts[x] += near @ weight[y]
        counts[y] += weight[x] @ near
        root = np.arange(len(vec))
        first = [(x[i], y[j]) for i, j in zip(*np.nonzero(near), strict=True)] if near.sum() < 4096 else None
        links = []
        if first is None:  # dense: grow each component from its vertices, row by row of the matrix
            full = np.zeros((len(vec), len(vec)), bool)
            full[np.ix_(x, y)] = near
            full |= full.T
            seen = np.zeros(len(vec), bool)
            for s in range(len(vec)):
                todo = [] if seen[s] else [s]
                seen[s] = True
                while todo:
                    v = todo.pop()
                    fresh = np.flatnonzero(full[v] & ~seen)
                    seen[fresh] = True
                    links += [(v, w) for w in fresh.tolist()]
                    todo += fresh.tolist()
        else:
            for a, b in first:
                while root[a] != a:
                    a = root[a]
                while root[b] != b:
                    b = root[b]
                if a != b:
                    root[max(a, b)] = min(a, b)
                    links.append((a, b))
        some = np.flatnonzero(counts)
        a = np.append(vec[some], vec[[p for p, _ in links]] if links else vec[:0])
        b = np.append(np.zeros(len(some), np.int64), vec[[q for _, q in links]] if links else vec[:0])
        empty = np.arange(len(a)) < len(some)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=empty), pa.array(np.append(counts[some], np.zeros(len(links), np.int64)))], names=["a", "b", "n"])


def near_vectors(vectors: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id (smallest vec_id reachable by links) and kept.

    Vectors link if their labels are equal and not null and their cosine, in double precision, is LEAST_COSINE or more
    (among codes within RADIUS bits; tests hold the recall against brute force). Vectors that are null, empty, zero, or that
    hold null or non-finite components link with nothing, and vectors of different widths don't link; rows with a null
    vec_id link with nothing, have a null component and are kept. Rows that share a vec_id are taken as one vector, the one with the
    least label and components, and get its result. An empty table gives none. Other columns are not looked at.
    vec_id must be an integer.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    own = rows.where("vec_id IS NOT NULL")
    if not own.groupBy("vec_id").count().where("count > 1").isEmpty():
        own = own.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("v")).select("vec_id", "v.label", "v.embedding")
    print_of = F.sha2(F.to_json(F.struct("embedding")), 256)
    linkable = own.where("label IS NOT NULL AND size(embedding) > 0").withColumn("print", print_of)
    classes = stored(linkable.groupBy("label", "print").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight")), "vector-classes")
    firsts = own.join(classes.select("vec_id", "weight"), "vec_id")
    sizes = [r["size"] for r in firsts.groupBy(F.size("embedding").alias("size")).count().collect()]  # one row a size
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    width, tables = tables_of(most)
    rotations = {w: learn(firsts.where(F.size("embedding") == w), w, -(-width * tables // 64), sample) for w in sizes}
    codes = stored(encode(firsts, rotations, width, tables), "codes")
    met = cells(codes, width).repartition("cell").sortWithinPartitions("cell", "side")
    tiles = stored(met.mapInArrow(lambda batches: _tiles(batches, width), "tile long, tab int, self boolean, side int, vec_id long, weight long, code binary"), "tiles")

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column(1))
            for width in set(sizes.to_pylist()):
                part = batch.filter(pc.equal(sizes, width))
                unit, _ = unit_rows(part.column(1), width)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([u.tobytes() for u in unit], pa.binary())], names=["vec_id", "unit"])

    needed = own.join(tiles.select("vec_id").distinct(), "vec_id", "left_semi").select("vec_id", "embedding").mapInArrow(units, "vec_id long, unit binary")
    full = tiles.join(needed, "vec_id").select("tile", "tab", "self", "side", "vec_id", "weight", "code", "unit").repartition("tile").sortWithinPartitions("tile")
    found = stored(full.mapInArrow(lambda batches: _rerank(batches, width), "a long, b long, n long"), "links")
    counts = found.where("n > 0").groupBy(F.col("a").alias("vec_id")).agg(F.sum("n").alias("n_links"))
    roots = components(found.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("id", "vec_id")
    per_class = codes.select("vec_id", "weight").join(counts, "vec_id", "left").join(roots, "vec_id", "left")
    per_class = per_class.select("vec_id", (F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component"))
    found = classes.join(per_class, "vec_id").select("label", "print", "n_links", "component")
    members = linkable.select("vec_id", "label", "print").join(found, ["label", "print"]).select("vec_id", "n_links", "component")
    out = rows.select("vec_id").join(members, "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"), F.coalesce(F.coalesce("component", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"))
