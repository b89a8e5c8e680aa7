"""Product codes of vectors by dual-tree Lloyd rounds on integers.

Vectors are cut into equal parts, and every part position has a codebook of entries. A task packs its vectors into blocks
once: for every part position a block holds its parts in the order of a balanced tree (halved at the median of its
widest component), with the box, the sum and the count of each node. Blocks are written to the shared folder, so that
every round reads trees in place of building them. A round builds a tree over the distinct entries of each codebook and
walks pairs of nodes from both roots, level by level. A pair goes when the least distance between its boxes exceeds the
largest distance from the part node's box to some other entry node's; a part node that is left with one entry is assigned
as a whole, by its cached sum; leaves that are left with several compare integer distances, ties to the lower index.
Rounds send one sum for each component of an entry to the driver: these depend on the codebooks' size alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import sha_hex, stored

#: Vectors in a block, parts in a leaf of its trees; scaled components beyond +-MOST are taken as +-MOST.
BLOCK, LEAF, MOST = 1 << 11, 8, 1 << 26
#: Bytes of a row group of stored blocks, so that readers hold few of the large rows at a time.
GROUP = 1 << 25
#: Labels up to which their sums are broadcast (a few dozen bytes each); salts of the join beyond.
BROADCAST_LABELS, SALTS = 100_000, 32


def usable(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label and e, the integers floor(scale * x) of vectors without null or non-finite components."""
    x = F.col("embedding").cast("array<double>")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    ints = F.transform(x, lambda v: F.least(F.greatest(F.floor(F.least(F.greatest(v, F.lit(-1e12)), F.lit(1e12)) * scale), F.lit(-MOST)), F.lit(MOST)).cast("int"))
    return vectors.select("vec_id", "label", "embedding").where(F.col("embedding").isNotNull() & whole).select("vec_id", "label", ints.alias("e"))


def _cut(rows: np.ndarray, parts: int) -> np.ndarray:
    """[vector, part, component]; a width that parts don't divide is filled up with zeros."""
    n, width = rows.shape
    each = max(1, -(-width // parts))
    out = np.zeros((n, parts * each), np.int64)
    out[:, :width] = rows
    return out.reshape(n, parts, each)


def tree_order(points: np.ndarray, leaf: int) -> np.ndarray:
    """The order of points, a power of two times leaf of them, in which each aligned half is a node of a balanced tree."""
    order, size = np.arange(len(points))[None, :], len(points)
    while size > leaf:
        held = points[order]
        axis = (held.max(axis=1) - held.min(axis=1)).argmax(axis=1)
        by = np.take_along_axis(held, axis[:, None, None], axis=2)[:, :, 0]
        order = np.take_along_axis(order, np.argsort(by, axis=1, kind="stable"), axis=1).reshape(-1, size // 2)
        size //= 2
    return order.ravel()


def node_boxes(points: np.ndarray, leaf: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Least and largest components of the nodes of each level, from the root to the leaves."""
    low = points.reshape(-1, leaf, points.shape[1]).min(axis=1)
    high = points.reshape(-1, leaf, points.shape[1]).max(axis=1)
    out = [(low, high)]
    while len(low) > 1:
        low, high = np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2])
        out.append((low, high))
    return out[::-1]


def node_sums(points: np.ndarray, real: np.ndarray, leaf: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sums of components and counts of the nodes of each level; points that fill a block up count for nothing."""
    total = (points * real[:, None]).reshape(-1, leaf, points.shape[1]).sum(axis=1)
    count = real.reshape(-1, leaf).sum(axis=1)
    out = [(total, count)]
    while len(count) > 1:
        total, count = total[::2] + total[1::2], count[::2] + count[1::2]
        out.append((total, count))
    return out[::-1]


class EntryTree:
    """A tree over a codebook's distinct entries; a leaf is one entry, known by its lowest index."""

    def __init__(self, book: np.ndarray):
        distinct, first = np.unique(book, axis=0, return_index=True)
        size = 1 << max(0, len(distinct) - 1).bit_length()
        rows = np.concatenate([np.arange(len(distinct)), np.full(size - len(distinct), len(distinct) - 1)])
        rows = rows[tree_order(distinct[rows], 1)]
        self.points, self.index = distinct[rows], first[rows]
        self.boxes = node_boxes(self.points, 1)
        # an entry that fills the tree up stands several times; leaves behind its first one are left out
        seen = np.zeros(size, bool)
        seen[np.unique(rows, return_index=True)[1]] = True
        self.real = [seen]
        while len(self.real[0]) > 1:
            self.real.insert(0, self.real[0][::2] | self.real[0][1::2])
        self.depth = len(self.boxes) - 1


def assign(points: np.ndarray, boxes: list, tree: EntryTree, leaf: int) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Nodes assigned as a whole (level, nodes, entries), then points of uncertain leaves and their entries."""
    whole, deepest = [], len(boxes) - 1
    node, entry, level, below = np.zeros(1, np.int64), np.zeros(1, np.int64), 0, 0
    while True:
        low, high = boxes[level][0][node], boxes[level][1][node]
        elow, ehigh = tree.boxes[below][0][entry], tree.boxes[below][1][entry]
        least = (np.maximum(np.maximum(low - ehigh, elow - high), 0) ** 2).sum(axis=1)
        most = (np.maximum(high - elow, ehigh - low) ** 2).sum(axis=1)
        first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        near = np.repeat(np.minimum.reduceat(most, first), np.diff(np.r_[first, len(node)]))
        node, entry = node[least <= near], entry[least <= near]
        if below == tree.depth:
            first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            single = np.diff(np.r_[first, len(node)]) == 1
            if single.any():
                at = first[single]
                whole.append((level, node[at], tree.index[entry[at]]))
                keep = np.repeat(~single, np.diff(np.r_[first, len(node)]))
                node, entry = node[keep], entry[keep]
            if level == deepest or not len(node):
                break
        # both nodes of each pair are halved, as long as they can be
        if below < tree.depth:
            below += 1
            node, entry = np.repeat(node, 2), np.stack([2 * entry, 2 * entry + 1], 1).ravel()
            node, entry = node[tree.real[below][entry]], entry[tree.real[below][entry]]
        if level < deepest:
            level += 1
            node, entry = np.concatenate([2 * node, 2 * node + 1]), np.concatenate([entry, entry])
            order = np.argsort(node, kind="stable")
            node, entry = node[order], entry[order]
    if not len(node):
        return whole, np.zeros(0, np.int64), np.zeros(0, np.int64)
    # integer distances of each pair's points, then the least one and the lowest index with it, of each node's pairs
    held, far = points.reshape(-1, leaf, points.shape[1]), np.zeros((len(node), leaf), np.int64)
    for c in range(points.shape[1]):
        far += (held[node, :, c] - tree.points[entry, c][:, None]) ** 2
    first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    near = np.repeat(np.minimum.reduceat(far, first, axis=0), np.diff(np.r_[first, len(node)]), axis=0)
    found = np.minimum.reduceat(np.where(far == near, tree.index[entry][:, None], 1 << 30), first, axis=0)
    return whole, (node[first][:, None] * leaf + np.arange(leaf)).ravel(), found.ravel()


def _add(total: np.ndarray, entries: np.ndarray, values: np.ndarray) -> None:
    """Adds each row of values to its entry's row."""
    if len(entries):
        order = np.argsort(entries, kind="stable")
        first = np.flatnonzero(np.diff(entries[order], prepend=-1))
        total[entries[order][first]] += np.add.reduceat(values[order], first, axis=0)


def _int32(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, "<i4").tobytes()


class Block:
    """Vectors of one width with a tree for each part position."""

    def __init__(self, n: int, width: int, trees: list[bytes], parts: int):
        self.n, self.parts, self.each = n, parts, max(1, -(-width // parts))
        self.size = LEAF << max(0, -(-n // LEAF) - 1).bit_length()
        self.trees = []
        for raw in trees:
            held = np.frombuffer(raw, "<i4").astype(np.int64)
            order, points = held[: self.size], held[self.size : self.size * (1 + self.each)].reshape(self.size, self.each)
            boxes, at = [], self.size * (1 + self.each)
            for k in range((self.size // LEAF).bit_length()):
                half = self.each << k
                boxes.append((held[at : at + half].reshape(-1, self.each), held[at + half : at + 2 * half].reshape(-1, self.each)))
                at += 2 * half
            self.trees.append((order, points, boxes))

    @staticmethod
    def pack(rows: np.ndarray, parts: int) -> list[bytes]:
        n = len(rows)
        size = LEAF << max(0, -(-n // LEAF) - 1).bit_length()
        cut, out = _cut(rows, parts), []
        fill = np.r_[np.arange(n), np.full(size - n, n - 1)]
        for p in range(parts):
            order = fill[tree_order(cut[fill, p], LEAF)]
            points = cut[order, p]
            # what fills the block up follows a row's first place and has no place of its own
            place = np.full(size, -1)
            place[np.unique(order, return_index=True)[1]] = np.unique(order)
            out.append(_int32(np.concatenate([place, points.ravel(), *(x.ravel() for pair in node_boxes(points, LEAF) for x in pair)])))
        return out

    def sums(self, books: np.ndarray) -> np.ndarray:
        """[part, entry, component sums and the count] of the nearest entries."""
        out = np.zeros((self.parts, books.shape[1], self.each + 1), np.int64)
        for p, (order, points, boxes) in enumerate(self.trees):
            cached = node_sums(points, (order >= 0).astype(np.int64), LEAF)
            whole, at, entry = assign(points, boxes, EntryTree(books[p]), LEAF)
            for level, nodes, entries in whole:
                _add(out[p], entries, np.column_stack([cached[level][0][nodes], cached[level][1][nodes]]))
            real = order[at] >= 0
            _add(out[p], entry[real], np.column_stack([points[at[real]], np.ones(real.sum(), np.int64)]))
        return out

    def codes(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[vector, part] of the nearest entries' indices, and the summed squared distances."""
        codes, error = np.zeros((self.n, self.parts), np.int64), np.zeros(self.n, np.int64)
        for p, (order, points, boxes) in enumerate(self.trees):
            whole, at, entry = assign(points, boxes, EntryTree(books[p]), LEAF)
            near = np.zeros(self.size, np.int64)
            for level, nodes, entries in whole:
                span = self.size >> level
                near.reshape(-1, span)[nodes] = entries[:, None]
            near[at] = entry
            real = order >= 0
            codes[order[real], p] = near[real]
            error[order[real]] += ((points[real] - books[p][near[real]]) ** 2).sum(axis=1)
        return codes, error


def _pack(kept: DataFrame, parts: int) -> DataFrame:
    """One row per block: its vec_ids, labels, width and trees."""
    ids, labels = (kept.schema[c].dataType.simpleString() for c in ("vec_id", "label"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[pa.Table]] = {}

        def block(width: int) -> pa.RecordBatch:
            t = pa.concat_tables(waiting.pop(width)).combine_chunks()
            flat = t["e"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), width)
            lists = [pa.array([t[c].to_pylist()], pa.list_(t[c].type)) for c in ("vec_id", "label")]
            return pa.RecordBatch.from_arrays([*lists, pa.array([width], pa.int32()), pa.array([Block.pack(flat, parts)], pa.list_(pa.binary()))], names=["ids", "labels", "width", "trees"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            widths = np.asarray(pc.list_value_length(t["e"]))
            for width in np.unique(widths).tolist():
                rows = t.filter(pa.array(widths == width))
                while len(rows):
                    room = BLOCK - sum(map(len, waiting.get(width, [])))
                    waiting.setdefault(width, []).append(rows.slice(0, room))
                    if len(rows) >= room:
                        yield block(width)
                    rows = rows.slice(room)
        for width in list(waiting):
            yield block(width)

    return kept.mapInArrow(pack, f"ids array<{ids}>, labels array<{labels}>, width int, trees array<binary>")


def _first_books(kept: DataFrame, parts: int, entries: int) -> dict[int, np.ndarray]:
    """[part, entry, component] by width, from the vectors with the smallest ids."""
    rank = F.row_number().over(Window.partitionBy("width").orderBy(F.col("vec_id").asc_nulls_last(), "e"))
    rows = kept.select("vec_id", "e", F.size("e").alias("width")).withColumn("k", rank).where(F.col("k") <= entries).select("width", "k", "e").collect()
    by: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["width"], r["k"])):
        by.setdefault(r["width"], []).append(r["e"])
    return {w: _cut(np.array(e, np.int64).reshape(len(e), w), parts).swapaxes(0, 1) for w, e in by.items()}


def _moved(blocks: DataFrame, books: dict[int, np.ndarray], parts: int) -> dict[int, np.ndarray]:
    """The codebooks after one round."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k in range(len(batch)):
                n, width, trees = (batch.column(c)[k].as_py() for c in range(3))
                total[width] = total.get(width, 0) + Block(n, width, trees, parts).sums(books[width])
        for width, found in total.items():
            flat = found.ravel()
            at = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), width), pa.int32()), pa.array(at), pa.array(flat[at])], names=["width", "slot", "value"])

    parted = blocks.select(F.size("ids").alias("n"), "width", "trees").mapInArrow(sums, "width int, slot long, value long")
    found = {w: np.zeros((*b.shape[:2], b.shape[2] + 1), object) for w, b in books.items()}
    for r in parted.groupBy("width", "slot").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():  # one row per number of the codebooks
        found[r["width"]].reshape(-1)[r["slot"]] = int(r["value"])
    out = {}
    for w, b in books.items():
        count = found[w][:, :, -1:]
        used = count[:, :, 0] > 0
        out[w] = b.copy()
        out[w][used] = (found[w][:, :, :-1][used] // count[used]).astype(np.int64)
    return out


def vector_codes(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """vec_id, label, width, code and error of every usable vector, and the codebooks by width as [part, entry, component].

    vectors: vec_id, label and embedding. A vector that is null or holds null or non-finite components is left out.
    Components become floor(256 * x), at most 2**26 in size. Codebooks start as the parts of the vectors with the
    smallest vec_ids (null ids last, equal ids by their components); each round assigns all parts to their nearest
    entries and moves an entry to the floored mean of its parts; unused entries stay. code: one byte for each part in
    two hex digits. error: the squared distances, summed over the parts. Vectors of each width have codebooks of their
    own (one set of numbers a width goes through the driver); a width that parts don't divide is filled up with zeros.
    Fewer vectors than entries make shorter codebooks; repeated rows count each time; an empty table gives no rows and
    no codebooks. Other columns are not looked at, whatever their names.
    """
    kept = usable(vectors)
    books = _first_books(kept, parts, entries)
    blocks = stored(_pack(kept, parts), "vector-blocks", {"parquet.block.size": str(GROUP), "parquet.page.size.row.check.min": "1"})
    for _ in range(rounds):
        books = _moved(blocks, books, parts)
    ids, labels = (kept.schema[c].dataType.simpleString() for c in ("vec_id", "label"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                held, tags, width, trees = (batch.column(c)[k] for c in range(4))
                codes, error = Block(len(held), width.as_py(), trees.as_py(), parts).codes(books[width.as_py()])
                digits = [row.tobytes().hex() for row in codes.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([held.values, tags.values, pa.array(np.full(len(held), width.as_py()), pa.int32()), pa.array(digits, pa.string()), pa.array(error)], names=["vec_id", "label", "width", "code", "error"])

    return blocks.mapInArrow(encode, f"vec_id {ids}, label {labels}, width int, code string, error long"), books


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of the decimal components by part, entry and position, joined by commas."""
    return sha_hex(",".join(map(str, books.ravel().tolist())).encode())


def code_report(vectors: DataFrame, **settings) -> DataFrame:
    """vec_id, code, error, label_error (the errors of all vectors with the same label, nulls together) and codebooks_sha256.

    What vector_codes states holds here. Sums over labels are aggregated before their shuffle and joined back by a
    broadcast up to BROADCAST_LABELS labels, by a salted shuffle beyond, so a frequent label is no task of its own.
    """
    coded, books = vector_codes(vectors, **settings)
    coded = stored(coded, "vector-codes")
    totals = stored(coded.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error")), "label-errors")
    same = F.col("label").eqNullSafe(F.col("__label"))
    if totals.count() <= BROADCAST_LABELS:
        joined = coded.join(F.broadcast(totals), same)
    else:
        salted = totals.withColumn("__salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        own = F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS))
        joined = coded.join(salted, same & (own == F.col("__salt")))
    digest = F.lit(None).cast("string")
    for width, held in books.items():
        digest = F.when(F.col("width") == width, F.lit(books_digest(held))).otherwise(digest)
    return joined.select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))
