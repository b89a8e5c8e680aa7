"""MinHash near-duplicates by a chosen-path set similarity join.

A document's set holds its distinct five-word shingles. Equal sets are one class. In each of several independent
trees a class takes the branches of a few minwise coordinates, which a hash of the node selects so that a node has
1/threshold branches on average; a branch is named by the coordinate and the class's minwise token there. Nodes at
the last level hold classes that share all tokens of their path. Small nodes are compared exhaustively. Of a large
node every member is first compared with a few pivots; links found that way are contracted to components, and then
all pairs of members of different components are compared, so no link between components is lost. Members are laid out
by the sizes of their sets, and sets too different in size to be linked don't meet. A pair of sketches that the threshold
all but excludes is skipped; every link is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, lower_bytes, mix, signed, space_words, stored, text_buffers, word_hashes
from .components import components

WORDS, THRESHOLD = 5, (75, 100)
COORDINATES, TREES, ROOT_BRANCHES, DEPTH = 64, 14, 2, 3
SMALL_NODE, PIVOTS, LEAST_BITS, SALT_ROWS, SIDE = 8, 2, 42, 512, 256

_RNG = np.random.default_rng(75)
_STEP = _RNG.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHORT = np.uint64(_RNG.integers(1, 1 << 63))
_MINWISE = _RNG.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, joined, and where each text's begin and end."""
    low = lower_bytes(data)
    start, end = space_words(low, offsets)
    word = word_hashes(low, start, end)
    n = len(offsets) - 1
    first = np.searchsorted(start, offsets)
    count = np.diff(first)
    if len(word) >= WORDS:
        rolled = sum(word[i : len(word) - WORDS + 1 + i] * _STEP[i] for i in range(WORDS))
        rolled = mix(rolled)
    else:
        rolled = np.zeros(0, np.uint64)
    out, sizes = [], np.zeros(n + 1, np.int64)
    for d in range(n):
        a, c = first[d], count[d]
        if c >= WORDS:
            got = np.sort(rolled[a : a + c - WORDS + 1])
            keep = np.ones(len(got), bool)
            keep[1:] = got[1:] != got[:-1]
            out.append(got[keep])
        elif c:
            out.append(mix((word[a : a + c] * _STEP[:c]).sum(dtype=np.uint64, keepdims=True) + _SHORT + np.uint64(c)))
        else:
            out.append(rolled[:0])
        sizes[d + 1] = len(out[-1])
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.cumsum(sizes)


def minwise(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """COORDINATES minwise tokens (32 bits) of each non-empty set; zeros for an empty one."""
    out = np.zeros((len(bounds) - 1, COORDINATES), np.uint32)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        for k in range(COORDINATES):
            out[some, k] = np.minimum.reduceat(((shingles * _MINWISE[k]) >> np.uint64(32)).astype(np.uint32), bounds[some])
    return out


def paths(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last-level nodes of each row of tokens: row and node."""
    n = len(tokens)
    limit = np.uint64(int(2**64 * THRESHOLD[1] / (THRESHOLD[0] * COORDINATES)))
    order = np.random.default_rng(7).permutation(COORDINATES)
    wide, steps = tokens.astype(np.uint64), np.arange(1, COORDINATES + 1, dtype=np.uint64) * _MINWISE[0]
    rows, nodes = [], []
    for t in range(TREES):
        for b in range(ROOT_BRANCHES):
            k = order[(t * ROOT_BRANCHES + b) % COORDINATES]
            row, node = np.arange(n), mix(wide[:, k] + (np.uint64(t * COORDINATES + k + 1) << np.uint64(32)))
            for _ in range(DEPTH - 1):
                more_rows, more_nodes = [], []
                for i in range(COORDINATES):
                    chosen = mix(node + steps[i]) < limit
                    more_rows.append(row[chosen])
                    more_nodes.append(mix(node[chosen] * np.uint64(3) + wide[row[chosen], i] + (np.uint64(i + 1) << np.uint64(40))))
                row, node = np.concatenate(more_rows), np.concatenate(more_nodes)
            rows.append(row)
            nodes.append(node)
    return np.concatenate(rows), np.concatenate(nodes)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, a 128-bit print of the set (p, q), and its minwise tokens (binary; null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j in chunks(offsets):
                shingles, bounds = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                sums = np.zeros((2, len(shingles) + 1), np.uint64)
                np.cumsum(shingles, out=sums[0, 1:])
                np.cumsum(mix(shingles ^ _SHORT), out=sums[1, 1:])
                prints = sums[:, bounds[1:]] - sums[:, bounds[:-1]]
                tokens, sizes = minwise(shingles, bounds), np.diff(bounds)
                binary = pa.array([tokens[d].tobytes() if sizes[d] else None for d in range(j - i)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(sizes), pa.array(signed(prints[0])), pa.array(signed(prints[1])), binary], names=["doc_id", "n_shingles", "p", "q", "tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, p long, q long, tokens binary")


def _branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, len(batch), 2000):
            part = batch.slice(i, 2000)
            tokens = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(-1, COORDINATES)
            sketch = np.packbits((tokens & 1).astype(np.uint8), axis=1).view(np.int64)[:, 0]
            row, node = paths(tokens)
            yield pa.RecordBatch.from_arrays([pa.array(signed(node)), part.column(0).take(pa.array(row)), pa.array(sketch[row])], names=["node", "id", "sketch"])


def _pairs(i: np.ndarray, j: np.ndarray, x: np.ndarray, y: np.ndarray, sx: np.ndarray, sy: np.ndarray) -> tuple:
    """kind 0 rows for the pairs x[i], y[j] that the sketches don't exclude."""
    fit = (np.bitwise_count((sx[i] ^ sy[j]).view(np.uint64)) <= COORDINATES - LEAST_BITS) & (x[i] != y[j])
    a, b = x[i[fit]], y[j[fit]]
    return np.zeros(len(a), np.int32), np.minimum(a, b), np.maximum(a, b), np.zeros(len(a), np.int64)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by node. kind 0: a pair to confirm; kind 1: a large node, a member and its sketch.

    Holds a batch, the rows of a node that may still be small, and the pivots of a large node that goes on.
    """
    held = tuple(np.zeros(0, np.int64) for _ in range(3))
    open_node, pivots = None, None

    def large(node: int, x: np.ndarray, sx: np.ndarray) -> list[tuple]:
        i, j = (k.ravel() for k in np.meshgrid(np.arange(len(pivots[0])), np.arange(len(x)), indexing="ij"))
        return [_pairs(i, j, pivots[0], x, pivots[1], sx), (np.ones(len(x), np.int32), np.full(len(x), node), x, sx)]

    def batch_of(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names=["kind", "a", "b", "sketch"])

    def work(nodes: np.ndarray, ids: np.ndarray, sketches: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, open_node, pivots
        if not len(nodes):
            return
        parts: list[tuple] = []
        start = np.flatnonzero(np.append(True, nodes[1:] != nodes[:-1]))
        size = np.diff(np.append(start, len(nodes)))
        whole = np.ones(len(start), bool)
        whole[-1] = last
        if nodes[0] == open_node:
            parts += large(open_node, ids[: size[0]], sketches[: size[0]])
            begun = 1
        else:
            begun = 0
        rest_start, rest_size, rest_whole = start[begun:], size[begun:], whole[begun:]
        small = rest_whole & (rest_size > 1) & (rest_size <= SMALL_NODE)
        for n in np.unique(rest_size[small]):
            at = rest_start[small & (rest_size == n)]
            i, j = np.triu_indices(n, 1)
            parts.append(_pairs((at[:, None] + i).ravel(), (at[:, None] + j).ravel(), ids, ids, sketches, sketches))
        for s, n in zip(rest_start[rest_size > SMALL_NODE].tolist(), rest_size[rest_size > SMALL_NODE].tolist(), strict=True):
            open_node, pivots = nodes[s], (ids[s : s + PIVOTS].copy(), sketches[s : s + PIVOTS].copy())
            parts += large(open_node, ids[s : s + n], sketches[s : s + n])
        if open_node is not None and nodes[-1] != open_node:
            open_node = None
        keep = len(nodes) if last or nodes[-1] == open_node else int(start[-1])
        held = nodes[keep:], ids[keep:], sketches[keep:]
        yield from batch_of([p for p in parts if len(p[0])])

    for batch in batches:
        yield from work(*(np.append(h, np.asarray(batch.column(k))) for k, h in enumerate(held)), False)
    yield from work(*held, True)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (pivot, salt, member, id, text) come sorted so that a pivot's own rows precede those to compare with it."""
    now, sets = None, []
    for batch in batches:
        pivot, salt, member, ids = (np.asarray(batch.column(k)) for k in range(4))
        data, offsets = text_buffers(batch.column(4))
        a, b = [], []
        for i, j in chunks(offsets):
            shingles, bounds = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            for d in range(i, j):
                own = shingles[bounds[d - i] : bounds[d - i + 1]]
                key = (pivot[d], salt[d])
                if key != now:
                    now, sets = key, []
                if not member[d]:
                    sets.append(own.copy())
                elif any(_similar(s, own) for s in sets):
                    a.append(pivot[d])
                    b.append(ids[d])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether 100 * shared >= 75 * all, for sorted distinct x and y."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if not len(small) or THRESHOLD[1] * len(small) < THRESHOLD[0] * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    shared = int((large[at] == small).sum())
    return THRESHOLD[1] * shared >= THRESHOLD[0] * (len(x) + len(y) - shared)


def confirm(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b: doc_ids) whose full shingle sets are similar enough.

    A document's text goes once to each of its partners' groups; a group of more than SALT_ROWS is split, with its
    pivot's text in each part. Tasks stream their rows and hold one pivot's set.
    """
    n = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT_ROWS).alias("salts"))
    salted = pairs.join(n, "a").select(F.col("a").alias("pivot"), F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(True).alias("member"), F.col("b").alias("id"))
    heads = n.select(F.col("a").alias("pivot"), F.explode(F.expr("sequence(0, cast(salts AS int) - 1)")).alias("salt"), F.lit(False).alias("member"), F.col("a").alias("id"))
    rows = salted.union(heads).join(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), "id")
    rows = rows.select("pivot", "salt", "member", "id", "text").repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "member")
    return rows.mapInArrow(_confirm, "a long, b long")


def _tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tile, id, root, side, sketch, text) come sorted by tile: spanning links between members of different roots.

    side 0 and 1 are compared with each other, side 2 (a tile of one part) with itself.
    """

    def work(ids: np.ndarray, root: np.ndarray, side: np.ndarray, sketch: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        open_pairs = (np.bitwise_count((sketch[:, None] ^ sketch[None, :]).view(np.uint64)) <= COORDINATES - LEAST_BITS) & (root[:, None] != root[None, :])
        open_pairs &= np.triu(np.ones_like(open_pairs), 1) if side[0] == 2 else (side[:, None] == 0) & (side[None, :] == 1)
        size = np.array([len(x) for x in sets])
        less, more = np.minimum(size[:, None], size[None, :]), np.maximum(size[:, None], size[None, :])
        open_pairs &= (less > 0) & (THRESHOLD[1] * less >= THRESHOLD[0] * more)
        if not open_pairs.any():
            return []
        owner = np.repeat(np.arange(len(ids)), size)
        values, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        several = n > 1  # what only one set holds isn't shared
        owner, column, values = owner[several[column]], (np.cumsum(several) - 1)[column[several[column]]], values[several]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        shared = np.zeros((len(ids), len(ids)), np.float32)
        for c in range(0, len(values), 4096):
            a, b = np.searchsorted(column, (c, c + 4096))
            block = np.zeros((len(ids), min(4096, len(values) - c)), np.float32)
            block[owner[a:b], column[a:b] - c] = 1
            shared += block @ block.T
        linked = open_pairs & (THRESHOLD[1] * shared >= THRESHOLD[0] * (size[:, None] + size[None, :] - shared))
        joined = {r: r for r in root.tolist()}

        def find(r: int) -> int:
            while joined[r] != r:
                joined[r] = r = joined[joined[r]]
            return r

        out = []
        for i, j in zip(*(k.tolist() for k in np.nonzero(linked)), strict=True):
            p, q = find(int(root[i])), find(int(root[j]))
            if p != q:
                joined[max(p, q)] = min(p, q)
                out.append((int(ids[i]), int(ids[j])))
        return out

    now, held = None, []
    for batch in batches:
        tile, ids, root, side, sketch = (np.asarray(batch.column(k)) for k in range(5))
        data, offsets = text_buffers(batch.column(5))
        found: list[tuple[int, int]] = []
        for i, j in chunks(offsets):
            shingles, bounds = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            for d in range(i, j):
                if tile[d] != now:
                    if len(held) > 1:
                        found += work(*(np.array(c) for c in list(zip(*held, strict=True))[:4]), [h[4] for h in held])
                    now, held = tile[d], []
                held.append((ids[d], root[d], side[d], sketch[d], shingles[bounds[d - i] : bounds[d - i + 1]].copy()))
        yield _links(found)
    if len(held) > 1:
        yield _links(work(*(np.array(c) for c in list(zip(*held, strict=True))[:4]), [h[4] for h in held]))


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def resolve(placed: DataFrame, docs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Links between the different roots in each node of placed (node, id, sketch, root), compared in tiles.

    sizes: id, and the least and greatest size (low, high) of its texts' sets. A part of a group holds members that follow
    each other by size; only parts that have sizes near enough for a link are compared.
    """
    least = placed.groupBy("node").agg(F.min("id").alias("a"))
    groups = components(placed.join(least, "node").select("a", F.col("id").alias("b")))
    members = placed.select("id", "sketch", "root").distinct().join(groups, "id").withColumnRenamed("component", "group").join(sizes, "id")
    place = F.row_number().over(Window.partitionBy("group").orderBy("low", "id"))
    members = stored(members.withColumn("part", F.floor((place - 1) / SIDE).cast("int")), "unresolved")
    parts = members.groupBy("group", "part").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    near = F.col("p.part").alias("part"), F.col("q.part").alias("other")
    fit = (THRESHOLD[1] * F.col("p.high") >= THRESHOLD[0] * F.col("q.low")) & (THRESHOLD[1] * F.col("q.high") >= THRESHOLD[0] * F.col("p.low"))
    met = parts.alias("p").join(parts.alias("q"), (F.col("p.group") == F.col("q.group")) & fit).select(F.col("p.group").alias("group"), *near)
    rows = members.join(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), "id").join(met, ["group", "part"])
    low, high = F.least("part", "other"), F.greatest("part", "other")
    side = F.when(F.col("part") == F.col("other"), 2).when(F.col("part") < F.col("other"), 0).otherwise(1)
    rows = rows.select(F.xxhash64("group", low, high).alias("tile"), "id", "root", side.alias("side"), "sketch", "text")
    return rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(_tile, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links) and kept.

    Links: at least 75 of 100 distinct five-word shingles shared (of those in either). Texts of fewer words are one
    shingle; null texts and those without words are empty and link with nothing. Rows that share a doc_id count as
    linked; rows with a null doc_id link with nothing, have a null component and are kept. An empty table gives none.
    Columns other than doc_id and text are not looked at. doc_id must be an integer.
    """
    rows = stored(signatures(docs), "signatures")
    classes = rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("n_shingles", "p", "q").agg(F.min("doc_id").alias("id"))
    firsts = rows.join(classes.select(F.col("id").alias("doc_id"), "n_shingles", "p", "q"), ["doc_id", "n_shingles", "p", "q"], "left_semi").select(F.col("doc_id").alias("id"), "tokens")
    nodes = firsts.mapInArrow(_branch, "node long, id long, sketch long").repartition("node").sortWithinPartitions("node", F.xxhash64("id"), "id")
    found = stored(nodes.mapInArrow(_compare, "kind int, a long, b long, sketch long"), "candidates")
    texts = docs.where(F.col("doc_id").isNotNull())
    links = stored(confirm(found.where("kind = 0").select("a", "b").distinct(), texts), "links")
    large = found.where("kind = 1").select(F.col("a").alias("node"), F.col("b").alias("id"), "sketch")
    if not large.isEmpty():
        roots = components(links)
        placed = large.join(roots, "id", "left").select("node", "id", "sketch", F.coalesce("component", "id").alias("root"))
        mixed = placed.groupBy("node").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("node")
        placed = stored(placed.join(mixed, "node", "left_semi"), "mixed-nodes")
        if not placed.isEmpty():
            sizes = rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"))
            links = stored(links.union(resolve(placed, texts, sizes)), "links")
    roots = components(links)
    own = classes.join(roots, "id", "left").select("n_shingles", "p", "q", F.coalesce("component", "id").alias("component_id"))
    shared = rows.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    out = rows.select("doc_id", "n_shingles", "p", "q").join(own, ["n_shingles", "p", "q"], "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    if not shared.isEmpty():
        joint = components(out.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")))
        out = out.join(joint, out["component_id"] == joint["id"], "left").select("doc_id", "n_shingles", F.coalesce("component", "component_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs, all columns kept, without the documents that near_duplicates doesn't keep.

    Of rows that share a doc_id the least one stays (by all columns in order). Rows with a null doc_id, null texts and
    texts without words all stay. An empty table stays empty; columns of any names are kept.
    """
    gone = near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias("__gone"))
    left = docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
    shared = left.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("__n")).where("__n > 1").select(F.col("doc_id").alias("__d"))
    if shared.isEmpty():
        return left
    single = left.join(shared, left["doc_id"] == shared["__d"], "left_anti")
    several = left.join(shared, left["doc_id"] == shared["__d"], "left_semi").groupBy(F.col("doc_id").alias("__d")).agg(F.min(F.struct(*left.columns)).alias("__row"))
    return single.union(several.select("__row.*"))
