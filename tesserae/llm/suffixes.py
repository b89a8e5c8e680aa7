"""Suffix-array dedup: bytes that stand in a string of so many bytes which also starts elsewhere.

Every string of LENGTH bytes is dealt by its anchor, the least hash among its K-byte grams, so equal strings meet.
Successive starts with one anchor form a run of text; only runs whose anchor occurs twice go on, once for each
distinct content. Their suffixes are sorted in an enhanced suffix array (bounded by the run), and a stack scan of its
common-prefix intervals, with a test of the bytes to the left, gives the maximal repeats with all their occurrences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, chunks, signed, stored, text_buffers

LENGTH, K = 200, 40
#: An anchor with more distinct runs has each of its strings dealt by itself.
MOST_KINDS = 5000
_BATCH = 1 << 18
_ALL, _ALL_LEVEL = 112, 5


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Where the least of each width successive values stands, by their upper 32 bits, the leftmost of equals."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    blocks = np.full(-(-len(values) // width) * width, ~np.uint64(0))
    packed = blocks[: len(values)]
    np.bitwise_and(values, np.uint64(0xFFFFFFFF00000000), out=packed)
    packed |= np.arange(len(values), dtype=np.uint64)
    grid = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & np.uint64(0xFFFFFFFF)).view(np.int64)


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple:
    """Runs of starts with one anchor: document, start in it, number of starts, hash of the anchor, the text's BLAKE2b digest of
    128 bits. Runs count as equal if their digests are."""
    if len(data) < LENGTH:
        return *(np.zeros(0, np.int64) for _ in range(4)), []
    rolling = Rolling(data)
    grams = rolling.every(K, finish=False)
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xD6E8FEB86659FD93)
    anchor = sliding_argmin(grams, LENGTH - K + 1)
    new = np.zeros(len(anchor) + 1, bool)
    new[0] = True
    np.not_equal(anchor[1:], anchor[:-1], out=new[1 : len(anchor)])
    new[np.minimum(offsets, len(anchor))] = True  # a run ends with its document
    last = np.maximum(offsets[1:] - LENGTH + 1, offsets[:-1])  # where a document's starts end
    new[np.minimum(last, len(anchor))] = True
    first = np.flatnonzero(new[:-1])
    count = np.diff(np.append(first, len(anchor)))
    doc = np.searchsorted(offsets, first, "right") - 1
    valid = first < last[doc]
    first, count, doc = first[valid], count[valid], doc[valid]
    gram = grams[anchor[first]]
    raw, end = memoryview(data.tobytes()), (first + count - 1 + LENGTH).tolist()
    text = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(first.tolist(), end, strict=True)]
    return doc, first - offsets[doc], count, signed(gram), text


def suffix_array(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]], np.ndarray]:
    """Ranks of suffixes by their first 7, 14, 28 ... bytes, as far as texts reach; a suffix ends with its text.

    Beyond _ALL bytes only the suffixes at starts get finer ranks. Returns the last ranks (equal at starts only for
    suffixes that are equal to their ends), all levels, and bytes left at each place.
    """
    n = len(data)
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)
    padded = np.zeros(n + 7, np.uint64)
    padded[:n] = data
    key = np.zeros(n, np.uint64)
    for i in range(7):
        key = key << np.uint64(8) | np.where(left > i, padded[i : n + i], np.uint64(0))
    key = key << np.uint64(8) | np.minimum(left, 7).astype(np.uint64)
    order = np.argsort(key)
    rank = np.zeros(n, np.int64)
    tied = _rank(key[order], order, rank, np.zeros(1, np.int64))
    levels = [(7, rank.astype(np.int32))]
    width, longest = 7, int(left.max()) if n else 0
    wanted = np.zeros(n, bool)
    wanted[starts] = True
    while width < longest and len(tied):
        if width == _ALL:
            tied = tied[wanted[tied]]
        after = np.where(left[tied] > width, levels[min(len(levels), _ALL_LEVEL) - 1][1][np.minimum(tied + width, n - 1)].astype(np.int64) + 1, 0)
        key = rank[tied] << 32 | after
        by = np.argsort(key)
        order = tied[by]
        tied = _rank(key[by], order, rank, None)
        width += min(width, _ALL)
        levels.append((width, rank.astype(np.int32)))
    return rank, levels, left


def _rank(key: np.ndarray, order: np.ndarray, rank: np.ndarray, base: np.ndarray | None) -> np.ndarray:
    """Gives the places in order their new ranks (that of a group: how many come before it); returns those still tied."""
    n = len(order)
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    if base is None:  # a group of equal old ranks keeps its place
        old = key >> 32
        fresh = np.ones(n, bool)
        fresh[1:] = old[1:] != old[:-1]
        begin = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        rank[order] = old + first - begin
    else:
        rank[order] = first
    single = new.copy()
    single[:-1] &= new[1:]
    return order[~single]


def common_prefixes(a: np.ndarray, b: np.ndarray, data: np.ndarray, levels: list[tuple[int, np.ndarray]], left: np.ndarray) -> np.ndarray:
    """How many bytes the suffixes at a and b share."""
    n = len(data)
    most = np.minimum(left[a], left[b])
    out = np.zeros(len(a), np.int64)
    for width, rank in reversed(levels):
        for _ in range(3 if width == _ALL else 1):
            more = (out < most) & ((width <= _ALL) | (out == 0))
            i, j = np.minimum(a + out, n - 1), np.minimum(b + out, n - 1)
            out = np.where(more & (rank[i] == rank[j]), np.minimum(out + width, most), out)
    for _ in range(7):
        i, j = np.minimum(a + out, n - 1), np.minimum(b + out, n - 1)
        out += (out < most) & (data[i] == data[j])
    return out


def intervals(shared: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Common-prefix intervals (from, to, length) of at least that length, inner ones first, by a stack scan.

    shared[i]: what suffix i shares with suffix i - 1; shared[0] is 0.
    """
    out: list[tuple[int, int, int]] = []
    stack: list[tuple[int, int]] = []
    values = shared.tolist()
    for i, value in enumerate([*values, 0]):
        begin = i - 1
        while stack and stack[-1][0] > value:
            length, begin = stack.pop()
            out.append((begin, i - 1, length))
        if value >= least and (not stack or stack[-1][0] < value):
            stack.append((value, begin))
    return out


def maximal_repeats(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, least: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The starts in suffix order, and the maximal repeats (from, to, length) among them: all that begin at starts.

    An interval counts if its occurrences are preceded by different bytes, or one begins its text.
    """
    rank, levels, left = suffix_array(data, offsets, starts)
    starts = starts[np.argsort(rank[starts], kind="stable")]
    shared = np.zeros(len(starts), np.int64)
    shared[1:] = common_prefixes(starts[:-1], starts[1:], data, levels, left)
    head = np.zeros(len(data) + 1, bool)
    head[offsets[:-1]] = True
    before = np.where(head[starts], -1 - np.arange(len(starts)), data[starts - 1].astype(np.int64))
    changes = np.zeros(len(starts), np.int64)
    changes[1:] = np.cumsum(before[1:] != before[:-1])
    found: list[tuple[int, int, int]] = []
    close = shared >= least
    edge = np.flatnonzero(close & ~np.append(False, close[:-1]))
    stop = np.flatnonzero(close & ~np.append(close[1:], False))
    pair = edge == stop
    diverse = pair & (changes[edge] != changes[edge - 1])
    found += zip((edge[diverse] - 1).tolist(), edge[diverse].tolist(), shared[edge[diverse]].tolist(), strict=True)
    for s, e in zip(edge[~pair].tolist(), stop[~pair].tolist(), strict=True):
        if changes[e] == changes[s - 1]:
            continue  # what holds for the widest interval holds for all inside it
        found += [(s - 1 + a, s - 1 + b, n) for a, b, n in intervals(np.append(0, shared[s : e + 1]), least) if changes[s - 1 + b] != changes[s - 1 + a]]
    return starts, found


def repeated_starts(texts: list[bytes], counts: np.ndarray) -> list[np.ndarray]:
    """Of each run (its first counts[i] places are starts): which starts begin a string that another run holds too."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    offsets = np.append(0, np.cumsum(sizes))
    data = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.repeat(offsets[:-1] - np.append(0, np.cumsum(counts)[:-1]), counts) + np.arange(counts.sum())
    starts, found = maximal_repeats(data, offsets, begin, LENGTH)
    reach = np.zeros(len(data) + 1, np.int64)
    for a, b, length in found:
        at = starts[a : b + 1]
        reach[at] = np.maximum(reach[at], length)
    change = np.zeros(len(data) + 2, np.int64)
    hit = np.flatnonzero(reach)
    np.add.at(change, hit, 1)
    np.add.at(change, hit + reach[hit] - LENGTH + 1, -1)
    covered = np.cumsum(change)[: len(data)] > 0
    return [covered[o : o + c] for o, c in zip(offsets[:-1].tolist(), counts.tolist(), strict=True)]


def _runs(docs: DataFrame) -> DataFrame:
    """did and h (a document's key), start, n_starts, gram (hash) and text (digest) of each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            for i, j in chunks(offsets):
                doc, start, count, gram, text = runs(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                where = pa.array(doc + i)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where), pa.array(start), pa.array(count.astype(np.int32)), pa.array(gram), pa.array(text, pa.binary())], names=["did", "h", "start", "n_starts", "gram", "text"])

    return docs.select("did", "h", "body").mapInArrow(run, "did long, h int, start long, n_starts int, gram long, text binary")


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 300) -> Iterator[pa.RecordBatch]:
    return (batch.slice(i, rows) for batch in batches for i in range(0, len(batch), rows))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the runs of each document (wanted: start, n_starts, gram, text, split); split ones string by string."""
    for batch in _parts(batches):
        data, offsets = text_buffers(batch.column(0))
        shard, text, at, count, body = [], [], [], [], []
        for d, wanted in enumerate(batch.column(1).to_pylist()):
            own = data[offsets[d] : offsets[d + 1]]
            for w in wanted:
                piece = own[w["start"] : w["start"] + w["n_starts"] - 1 + LENGTH]
                if not w["split"]:
                    shard.append(w["gram"])
                    text.append(w["text"])
                    at.append(0)
                    count.append(w["n_starts"])
                    body.append(piece.tobytes())
                    continue
                for k, name in enumerate(signed(Rolling(piece).every(LENGTH)).tolist()):
                    shard.append(name)
                    text.append(w["text"])
                    at.append(k)
                    count.append(1)
                    body.append(piece[k : k + LENGTH].tobytes())
            if len(body) > 20_000:
                yield _cut_batch(shard, text, at, count, body)
                shard, text, at, count, body = [], [], [], [], []
        yield _cut_batch(shard, text, at, count, body)


def _cut_batch(shard: list, text: list, at: list, count: list, body: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(text, pa.binary()), pa.array(at, pa.int32()), pa.array(count, pa.int32()), pa.array(body, pa.binary())], names=["shard", "text", "at", "n_starts", "body"])


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard; whole shards are put together up to about _BATCH bytes.

    A shard of a split anchor holds one string many times: two of its rows go into the suffix array, and the others,
    which must be repeated too, are passed on at once, so a shard of any number of rows is read as a stream.
    """
    shards: list[int] = []
    texts: list[bytes] = []
    at: list[int] = []
    counts: list[int] = []
    bodies: list[bytes] = []
    size = 0

    def work(n: int) -> pa.RecordBatch:
        covered = repeated_starts(bodies[:n], np.array(counts[:n], np.int64))
        rows = [(texts[i], at[i], c) for i, c in enumerate(covered) if c.any()]
        spans: list[list[int]] = []
        for _, a, c in rows:
            edge = np.flatnonzero(np.diff(np.concatenate(([0], c.view(np.int8), [0]))))
            spans.append((edge + a).tolist())
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array(spans, pa.list_(pa.int32()))], names=["text", "edges"])

    for batch in batches:
        echoes: list[tuple[bytes, list[int]]] = []
        for s, t, a, c, b in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if c == 1 and shards[-2:] == [s, s] and bodies[-1] == b == bodies[-2]:
                echoes.append((t, [a, a + 1]))
                continue
            if size > _BATCH and s != shards[-1]:
                yield work(len(shards))
                shards, texts, at, counts, bodies, size = [], [], [], [], [], 0
            shards.append(s)
            texts.append(t)
            at.append(a)
            counts.append(c)
            bodies.append(b)
            size += len(b)
        if echoes:
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in echoes], pa.binary()), pa.array([e for _, e in echoes], pa.list_(pa.int32()))], names=["text", "edges"])
    if shards:
        yield work(len(shards))


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _parts(batches):
        sizes, removed, spans, kept = [], [], [], []
        for body, places in zip(batch.column(1), batch.column(2), strict=True):
            data = np.frombuffer((body.as_py() or "").encode(), np.uint8)
            change = np.zeros(len(data) + 1, np.int64)
            for p in places.as_py() or []:
                edges = p["edges"] or [0, p["n_starts"]]
                for a, b in zip(edges[::2], edges[1::2], strict=True):
                    change[p["start"] + a] += 1
                    change[p["start"] + b - 1 + LENGTH] -= 1
            gone = np.cumsum(change)[: len(data)] > 0
            edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
            sizes.append(len(data))
            removed.append(int(gone.sum()))
            spans.append(edge.reshape(-1, 2).tolist())
            kept.append(data[~gone].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])


def remove_repeats(docs: DataFrame, digest: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, spans (removed runs, in bytes) and kept (the bytes left).

    A byte is removed if a string of LENGTH bytes that holds it starts anywhere else too, in any document or the same
    one; strings don't cross documents and are judged on the input. With digest, n_spans and kept_sha256 take the
    place of spans and kept. Null text is empty: nothing is removed. Texts shorter than LENGTH stay as they are.
    Rows with equal doc_id and text count as two documents and get the same result; a null doc_id is a document like
    others. An empty table gives none; other columns are not looked at. doc_id must be an integer.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("body"))
    keyed = keyed.withColumns({"did": F.coalesce("doc_id", F.xxhash64("body")), "h": F.hash("body")})
    every = stored(_runs(keyed), "runs")
    counted = every.groupBy("gram", "text").agg(F.count("*").alias("n"))
    by_gram = counted.groupBy("gram").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).where("total > 1")
    known = stored(counted.join(by_gram.select("gram", "kinds"), "gram"), "repeated-runs")
    places = stored(every.join(known.select("text", "n", "kinds"), "text"), "places")
    firsts = places.where("kinds > 1").groupBy("text").agg(F.min(F.struct("did", "h", "start")).alias("f"), F.first("gram").alias("gram"), F.first("n_starts").alias("n_starts"), F.first("kinds").alias("kinds"))
    wanted = firsts.groupBy(F.col("f.did").alias("did"), F.col("f.h").alias("h")).agg(F.collect_list(F.struct(F.col("f.start").alias("start"), "n_starts", "gram", "text", (F.col("kinds") > MOST_KINDS).alias("split"))).alias("wanted"))
    cut = keyed.join(wanted, ["did", "h"]).dropDuplicates(["did", "h"]).select("body", "wanted")
    cut = cut.mapInArrow(_cut, "shard long, text binary, at int, n_starts int, body binary")
    shared = cut.repartition("shard").sortWithinPartitions("shard").mapInArrow(_sorted_runs, "text binary, edges array<int>")
    shared = stored(shared.groupBy("text").agg(F.flatten(F.collect_list("edges")).alias("edges")), "shared-runs")
    # a run that occurs twice is repeated as a whole; others as far as the intervals say
    hit = places.where("n > 1").select("did", "h", "start", "n_starts", F.lit(None).cast("array<int>").alias("edges"))
    hit = hit.union(places.where("n = 1").join(shared, "text").select("did", "h", "start", "n_starts", "edges"))
    per_doc = hit.groupBy("did", "h").agg(F.collect_list(F.struct("start", "n_starts", "edges")).alias("places"))
    rows = keyed.join(per_doc, ["did", "h"], "left").select("doc_id", "body", "places")
    out = rows.mapInArrow(_strip, "doc_id long, n_bytes long, n_removed long, spans array<array<long>>, kept binary")
    if digest:
        return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    return out
