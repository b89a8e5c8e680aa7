"""Benchmark decontamination with DataFrame functions only.

The word windows of the benchmark form a hash set that is broadcast. A document's words are scanned once; only
places where a window's anchor (its three longest successive words) stands are looked up in the set, which skips
no window, since a window holds its anchor. Hits are verified against the window's text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PIECES = r"(?<=[\x00-\x2F\x3A-\x60\x7B-\x7F])(?=[^\x00-\x2F\x3A-\x60\x7B-\x7F])"


def words_of(text: Column) -> Column:
    """The words of a text: A-Z lower-cased, then runs of digits, letters a-z and characters beyond ASCII."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def windows(benchmark: DataFrame, n: int = 13) -> DataFrame:
    """gram, size, items (sorted ids), anchor and offset (the anchor's place) of each distinct window."""
    rows = benchmark.select("item_id", words_of(F.col("text")).alias("w")).where("size(w) > 0").withColumn("size", F.least(F.size("w"), F.lit(n)))
    rows = rows.select("item_id", "size", F.explode(F.expr("transform(sequence(0, size(w) - size), i -> slice(w, i + 1, size))")).alias("g"))
    rows = rows.groupBy("g", "size").agg(F.array_sort(F.transform(F.collect_set(F.struct("item_id")), lambda x: x["item_id"])).alias("items"))
    best = F.expr("array_max(transform(sequence(0, greatest(size - 3, 0)), i -> struct(length(array_join(slice(g, i + 1, 3), '')) AS long, -i AS at)))")
    rows = rows.withColumn("offset", -best["at"])
    return rows.select(F.array_join("g", " ").alias("gram"), "size", "items", "offset", F.least("size", F.lit(3)).alias("reach"), F.expr("xxhash64(get(g, offset), get(g, offset + 1), get(g, offset + 2))").alias("anchor"))


def _places(scanned: DataFrame, anchors: DataFrame, reach: int, small: bool) -> DataFrame:
    """doc_id, h, w, begin and size of the places where a window may stand: its anchor is there.

    Beyond the size that is broadcast, only a word's document, place and anchor are shuffled; the words of a document
    follow once, for documents that hold an anchor.
    """
    nth = ["word", "get(w, at + 1)", "get(w, at + 2)"][:reach]
    words = scanned.select("doc_id", "h", "w", F.posexplode("w").alias("at", "word")).withColumn("anchor", F.expr(f"xxhash64({', '.join(nth)})"))
    begin = (F.col("at") - F.col("offset")).alias("begin")
    if small:
        return words.join(F.broadcast(anchors), "anchor").select("doc_id", "h", "w", begin, "size")
    met = words.select("doc_id", "h", "at", "anchor").join(anchors, "anchor").select(F.col("doc_id").alias("__d"), F.col("h").alias("__h"), begin, "size")
    met = met.groupBy("__d", "__h").agg(F.collect_set(F.struct("begin", "size")).alias("found"))
    texts = scanned.dropDuplicates(["doc_id", "h"])
    both = texts.join(met, texts["doc_id"].eqNullSafe(met["__d"]) & (texts["h"] == met["__h"]))
    return both.select("doc_id", "h", "w", F.explode("found").alias("f")).select("doc_id", "h", "w", "f.begin", "f.size")


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = 13, most_bytes: int = 1 << 26, permille: int = 50) -> DataFrame:
    """One row per document: doc_id, h (a hash of the text), n_words, n_hit, items (sorted ids), spans (from, to in words) and contaminated.

    A window is n successive words of an item, or all words of a shorter one. spans: the merged places of windows.
    contaminated: n_hit > 0 and n_hit at least so many thousandths of n_words. Null and empty texts have no words, and
    an item without words no window. Rows with the same doc_id and text have the same result; rows with a null
    doc_id or item_id are treated like others (all null item_ids are one, which comes last in items). Empty tables give
    no rows or no hits. Other columns are not looked at, whatever their names.
    The set is broadcast if it takes most_bytes at most as rows in memory, by its measured lengths, else it is joined by
    a shuffle.
    """
    grams = windows(benchmark, n)
    weight = F.octet_length("gram") + 16 * F.size("items") + 160
    sizes = grams.groupBy("reach").agg(F.sum(weight).alias("bytes")).collect()  # three rows at most
    small = sum(r["bytes"] for r in sizes) <= most_bytes
    scanned = docs.select("doc_id", F.xxhash64("text").alias("h"), words_of(F.col("text")).alias("w"))
    anchors = grams.select("anchor", "offset", "size", "reach").distinct()
    parts = [_places(scanned, anchors.where(F.col("reach") == reach).drop("reach"), reach, small) for reach in sorted(r["reach"] for r in sizes)]
    key = [docs["doc_id"].alias("doc_id"), F.xxhash64(docs["text"]).alias("h"), F.size(words_of(docs["text"])).cast("long").alias("n_words")]
    out = docs.select(*key)
    if parts:
        places = reduce(DataFrame.union, parts).where("begin >= 0 AND begin + size <= size(w)").select("doc_id", "h", "begin", "size", F.expr("array_join(slice(w, greatest(begin, 0) + 1, size), ' ')").alias("gram"))
        known = grams.select("gram", "size", "items")
        hits = places.join(F.broadcast(known) if small else known, ["gram", "size"])
        hits = hits.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set(F.struct("begin", (F.col("begin") + F.col("size")).alias("to")))).alias("found"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
        merged = "aggregate(found, cast(array() as array<struct<begin:int,to:int>>), (l, x) -> if(size(l) > 0 AND element_at(l, -1).to >= x.begin, concat(slice(l, 1, size(l) - 1), array(named_struct('begin', element_at(l, -1).begin, 'to', greatest(element_at(l, -1).to, x.to)))), concat(l, array(x))))"
        hits = hits.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "items", F.expr(merged).alias("spans"))
        out = out.join(hits, out["doc_id"].eqNullSafe(hits["d"]) & (out["h"] == hits["g"]), "left").drop("d", "g")
    else:
        out = out.withColumns({"items": F.lit(None).cast(f"array<{benchmark.schema['item_id'].dataType.simpleString()}>"), "spans": F.lit(None).cast("array<struct<begin:int,to:int>>")})
    out = out.withColumns({"items": F.expr("coalesce(items, slice(items, 1, 0), array())"), "spans": F.coalesce("spans", F.array().cast("array<struct<begin:int,to:int>>"))})
    out = out.withColumn("n_hit", F.expr("aggregate(spans, 0L, (n, s) -> n + s.to - s.begin)"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (1000 * F.col("n_hit") >= permille * F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", **settings) -> DataFrame:
    """docs, all columns kept, without contaminated documents, or with remove="spans" without the words inside windows.

    Null and empty texts stay as they are, and so does any row, repeated ones and null doc_ids included, whose text holds
    no window. An empty table stays empty, and an empty benchmark removes nothing. Columns of any other names are kept.
    """
    found = find_contamination(docs, benchmark, **settings)
    keyed = docs.withColumn("__h", F.xxhash64("text"))
    if remove == "documents":
        bad = found.where("contaminated").select(F.col("doc_id").alias("__d"), F.col("h").alias("__g"))
        return keyed.join(bad, keyed["doc_id"].eqNullSafe(bad["__d"]) & (keyed["__h"] == bad["__g"]), "left_anti").drop("__h")
    if remove != "spans":
        raise ValueError("remove is documents or spans")
    cut = found.where("n_hit > 0").select(F.col("doc_id").alias("__d"), F.col("h").alias("__g"), F.col("spans").alias("__spans")).dropDuplicates(["__d", "__g"])
    joined = keyed.join(cut, keyed["doc_id"].eqNullSafe(cut["__d"]) & (keyed["__h"] == cut["__g"]), "left")
    pieces = joined.withColumn("__p", F.split("text", _PIECES))
    shift = F.when(F.col("text").rlike("^" + SEPARATORS), 1).otherwise(0)
    kept = F.expr("array_join(filter(__p, (p, i) -> NOT exists(__spans, s -> i - __k >= s.begin AND i - __k < s.to)), '')")
    text = pieces.withColumn("__k", shift).withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(kept))
    return text.select(*docs.columns)
