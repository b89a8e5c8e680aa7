"""Near-duplicate lines by a segment-partition edit join, with DataFrame functions only.

Lines may differ by one edit for each ten characters of the shorter one, by two at most. Two lines within T edits share
one of the T + 1 segments that the shorter one is split into, at a place that the lengths and the number of the segment
bound. Each distinct line is indexed by (length, segment number, segment) and
probes the indexes of lengths up to T below its own with the few substrings that can be that segment (the multi-match
selection). Candidates are verified by a bit-parallel automaton over the 2 T + 1 diagonals of the edit matrix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components

EDITS, PER_EDIT, BROADCAST_IDS, HOT = 2, 10, 1_000_000, 8


def allowed(length: Column, edits: int, per_edit: int) -> Column:
    """How many edits a line of that length, the shorter one of a pair, may differ by: one for each per_edit characters."""
    return F.least(F.lit(edits), F.floor(length / per_edit).cast("int"))


def segment(length: Column, i: int, edits: int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment i (from 0) of a line of that length; the longer segments come last."""
    base, longer = F.floor(length / (edits + 1)).cast("int"), length % (edits + 1)
    first_longer = edits + 1 - longer
    return base * i + F.greatest(F.lit(0), F.lit(i) - first_longer) + 1, base + F.when(F.lit(i) >= first_longer, 1).otherwise(0)


def index_keys(text: Column, length: Column, edits: int, per_edit: int) -> Column:
    """Keys of the segments of a line, as many as it may have edits and one more."""
    keys = F.array().cast("array<bigint>")
    for t in range(1, edits + 1):
        own = [segment(length, i, t) for i in range(t + 1)]
        keys = F.when(allowed(length, edits, per_edit) == t, F.array(*(F.xxhash64(length, F.lit(i), text.substr(start, size)) for i, (start, size) in enumerate(own)))).otherwise(keys)
    return keys


def probe_keys(text: Column, length: Column, edits: int, per_edit: int) -> Column:
    """Keys of the substrings to look up, for indexed lines of the same length or up to so many characters shorter.

    Two lines of one length look each other up. With two edits, a segment that only an insertion and a deletion around
    it leave whole stands one place later in one of the two lines, so places before the segment's own are left out.
    """
    parts = []
    for less in range(edits + 1):
        other = length - less
        keys = F.array().cast("array<bigint>")
        for t in range(max(1, less), edits + 1):
            out = []
            for i in range(t + 1):
                start, size = segment(other, i, t)
                lowest = 0 if not less and t <= 2 else max(-i, less - (t - i))
                for shift in range(lowest, min(i, less + (t - i)) + 1):
                    out.append(F.xxhash64(other, F.lit(i), text.substr(start + shift, size)))
            keys = F.when(allowed(other, edits, per_edit) == t, F.array(*out)).otherwise(keys)
        parts.append(keys)
    return F.concat(*parts)


def _let(bindings: dict[str, str], body: str) -> str:
    """SQL for body with v.NAME standing for each bound expression, which is evaluated once."""
    fields = ", ".join(f"'{name}', {value}" for name, value in bindings.items())
    return f"element_at(transform(array(named_struct({fields})), v -> {body}), 1)"


def within(x: str, y: str, edits: int, per_edit: int | None = None) -> str:
    """SQL for whether at most so many edits (and, if per_edit is given, one for each per_edit characters of the shorter one
    at most) turn the line in column x into the one in column y.

    Common ends are cut off first, by halving steps. Then bit d of r[e] says: after the characters of x read so far, the
    prefix of y that is d - edits characters longer is reached with e edits. A character keeps the diagonals where y
    has the same one next; an edit keeps all, moves one down (deletion) or one up (insertion, from the new vector).
    Only the 2 * edits + 1 diagonals that can matter are held.
    """
    shorter = f"least(length({x}), length({y}))"
    steps = f"transform(reverse(sequence(0, cast(log2(greatest({shorter}, 1)) AS int))), k -> shiftleft(1, k))"
    prefix = f"aggregate({steps}, 0, (p, s) -> IF(p + s <= {shorter} AND substring({x}, p + 1, s) = substring({y}, p + 1, s), p + s, p))"
    suffix = f"aggregate({steps}, 0, (p, s) -> IF(p + s <= {shorter} - v.pre AND substring({x}, length({x}) - p - s + 1, s) = substring({y}, length({y}) - p - s + 1, s), p + s, p))"
    middle = {f"c{n}": f"split(substring({c}, v.pre + 1, length({c}) - v.pre - v.post), '')" for n, c in (("x", x), ("y", y))}
    middle |= {f"n{n}": f"length({c}) - v.pre - v.post" for n, c in (("x", x), ("y", y))}
    wide = 2 * edits + 1
    same = " | ".join(f"IF(get(v.cy, i + {d - edits}) = get(v.cx, i), {1 << d}, 0)" for d in range(wide))
    vectors, new = [], "0"
    for e in range(edits + 1):
        old = f"r.r{e - 1}"
        new = f"(r.r{e} & m)" if not e else f"((r.r{e} & m) | {old} | shiftright({old}, 1) | shiftleft({new}, 1)) & {(1 << wide) - 1}"
        vectors.append(f"'r{e}', {new}")
    step = f"element_at(transform(array({same}), m -> named_struct({', '.join(vectors)})), 1)"
    begin = "named_struct(" + ", ".join(f"'r{e}', {((1 << (e + 1)) - 1) << edits & (1 << wide) - 1}" for e in range(edits + 1)) + ")"
    last = f"aggregate(sequence(0, v.nx - 1), {begin}, (r, i) -> {step}, r -> array({', '.join(f'r.r{e}' for e in range(edits + 1))})[v.most])"
    near = f"IF(abs(v.nx - v.ny) > v.most, false, IF(v.nx = 0, true, shiftright({last}, v.ny - v.nx + {edits}) & 1 = 1))"
    middle["most"] = f"cast(least({edits}, floor({shorter} / {per_edit})) AS int)" if per_edit else str(edits)
    return _let({"pre": prefix}, _let({"pre": "v.pre", "post": suffix}, _let(middle, near)))


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), line, id (a 64-bit hash of the line) of every line that isn't blank."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.where(F.trim("line") != "").withColumn("id", F.xxhash64("line"))


#: Characters whose counts are compared within hot segments, eight to a column; an even share of them to a group.
COUNTED = ("etaoinsr", "hdlcumfg", "wypbvkjx", "qz ,.éüó", "01234567", "89-/:_%#")


def letter_counts(line: Column, letters: str) -> Column:
    """How often each of eight characters stands in a line, modulo 128, 8 bits each."""
    n = F.length(line)
    packed = F.lit(0).cast("long")
    for k, c in enumerate(letters):
        packed = packed.bitwiseOR(F.shiftleft((n - F.length(F.replace(line, F.lit(c), F.lit("")))).bitwiseAND(F.lit(127)).cast("long"), 8 * k))
    return packed


def _count(side: str, j: int) -> str:
    return f"(shiftright({side}{j // 8}, {j % 8 * 8}) & 127)"


def counts_fit(edits: int) -> Column:
    """An edit changes two counts by one at most. Differences modulo 128 are taken the shorter way round."""
    parts = [f"abs({_count('x', j)} - {_count('y', j)})" for j in range(8 * len(COUNTED))]
    return F.expr(" + ".join(f"least({p}, 128 - {p})" for p in parts) + f" <= {2 * edits}")


def count_groups(side: str, edits: int) -> Column:
    """Hashes of the counts of 2 * edits + 1 groups of characters: lines within so many edits agree in one at least."""
    n = 2 * edits + 1
    return F.array(*(F.expr(f"xxhash64({g}, " + ", ".join(_count(side, j) for j in range(g, 8 * len(COUNTED), n)) + ")") for g in range(n)))


def shared_segments(docs: DataFrame, edits: int, per_edit: int) -> DataFrame:
    """kind 0: lines a and b share a segment. kind 1 and 2: line a probes, or is indexed by, the hot key b.

    A hot key is shared by HOT or more indexed lines, whose pairs would grow with the square of their number. It stands
    as one row among the indexed lines, so that all rows meet in one join.
    """
    distinct = lines_of(docs).where(F.length("line") >= per_edit).select("line", "id").distinct().withColumn("n", F.length("line"))
    index = distinct.select(F.col("id").alias("b"), F.explode(index_keys(F.col("line"), F.col("n"), edits, per_edit)).alias("key")).repartition("key")
    probe = distinct.select(F.col("id").alias("a"), F.explode(probe_keys(F.col("line"), F.col("n"), edits, per_edit)).alias("key"))
    hot = index.groupBy("key").agg(F.count("*").alias("m"), F.min("b").alias("lo"), F.max("b").alias("hi")).where(f"m >= {HOT} AND lo <> hi").select("key")
    held = index.join(hot, "key", "left_anti").select("key", "b").union(hot.select("key", F.lit(None).cast("long").alias("b")))
    met = probe.join(held.hint("shuffle_hash"), "key").where("b IS NULL OR a <> b").select(F.when(F.col("b").isNull(), 1).otherwise(0).alias("kind"), "a", F.coalesce("b", "key").alias("b"))
    return met.union(index.join(hot, "key", "left_semi").select(F.lit(2).alias("kind"), F.col("b").alias("a"), F.col("key").alias("b")))


def hot_pairs(members: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """Pairs (a, b) of the lines of each hot key that may be near.

    They have to agree in the character counts of one of several groups and to differ little in all counts, which no
    lines within the edits fail.
    """
    ids = members.select(F.col("a").alias("id")).distinct()
    counts = stored(texts.join(ids, "id", "left_semi").select("id", *(letter_counts(F.col("line"), letters).alias(str(i)) for i, letters in enumerate(COUNTED))), "line-counts")
    sides = []
    for kind, side, name in ((1, "x", "a"), (2, "y", "b")):
        own = counts.select(F.col("id").alias(name), *(F.col(str(i)).alias(f"{side}{i}") for i in range(len(COUNTED))))
        rows = members.where(F.col("kind") == kind).select(F.col("a").alias(name), F.col("b").alias("key")).join(own, name)
        sides.append(rows.withColumn("group", F.explode(count_groups(side, edits))))
    return sides[0].join(sides[1], ["key", "group"]).where((F.col("a") != F.col("b")) & counts_fit(edits)).select("a", "b")


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id and line of the lines with these ids; few ids are broadcast to the scan, more are joined by a shuffle."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return lines_of(docs).select("id", "line").join(ids, "id").distinct()


def near_links(docs: DataFrame, edits: int = EDITS, per_edit: int = PER_EDIT) -> DataFrame:
    """Pairs a < b of ids of different lines within so many edits, one for each per_edit characters at most."""
    found = stored(shared_segments(docs, edits, per_edit), "line-keys")
    ids = found.select(F.explode(F.when(F.col("kind") == 0, F.array("a", "b")).otherwise(F.array("a"))).alias("id")).distinct()
    texts = stored(texts_of(docs, ids), "line-texts")
    pairs, members = found.where("kind = 0").select("a", "b"), found.where("kind > 0")
    if not members.isEmpty():
        pairs = pairs.union(hot_pairs(members, texts, edits))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sides = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("line").alias("y")), "b")
    return sides.repartition(F.xxhash64("a", "b")).where(F.expr(within("x", "y", edits, per_edit))).select("a", "b").distinct()


#: A line's place is doc_id * _ROOM + line_no, as a decimal; _LAST stands for a null doc_id.
_ROOM, _LAST = 1 << 32, (1 << 63) - 1


def near_lines(docs: DataFrame, edits: int = EDITS, per_edit: int = PER_EDIT) -> DataFrame:
    """One row per line that isn't blank: doc_id, line_no, n_links, class_doc_id, class_line_no and kept.

    Lines link if at most so many edits, and one for each per_edit characters of the shorter line at most, turn one into
    the other; equal lines of any length are one. A class is what links join; class_doc_id and class_line_no name its first line (by doc_id, then
    line_no), which alone is kept. n_links: how many different lines a line links with. Lines end at a line feed and
    are compared as they are; null and empty texts have no lines. Rows with one doc_id are taken as one document, so
    equal rows get equal results; a null doc_id comes last. An empty table gives none. Columns besides doc_id and
    text are not looked at. doc_id must be an integer.
    """
    links = stored(near_links(docs, edits, per_edit), "line-links")
    roots = components(links)
    degree = links.select(F.col("a").alias("id")).union(links.select(F.col("b").alias("id"))).groupBy("id").agg(F.count("*").alias("n_links"))
    known = roots.join(degree, "id", "left")
    room = F.lit(_ROOM).cast("decimal(12,0)")
    place = F.coalesce("doc_id", F.lit(_LAST)).cast("decimal(20,0)") * room + F.col("line_no").cast("decimal(12,0)")
    rows = lines_of(docs).select("doc_id", "line_no", "id", place.cast("decimal(38,0)").alias("place"))
    rows = rows.join(known, "id", "left").select("doc_id", "line_no", "place", F.coalesce("component", "id").alias("class"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    # stored, so that both sides of the join are plain exchanges, which adaptive execution can split for a hot class
    out = rows.join(stored(rows.groupBy("class").agg(F.min("place").alias("first")), "line-firsts"), "class")
    owner = F.floor(F.col("first") / room)
    number = (F.col("first") - owner * room).cast("int")
    return out.select("doc_id", "line_no", "n_links", F.when(owner < _LAST, owner.cast("long")).alias("class_doc_id"), number.alias("class_line_no"), (F.col("place") == F.col("first")).alias("kept"))


def dedup_lines(docs: DataFrame, edits: int = EDITS, per_edit: int = PER_EDIT) -> DataFrame:
    """docs without the lines that near_lines doesn't keep; a document that loses all its lines goes.

    All columns are kept; n_chars, where there is one, is counted anew for a changed text. Null and empty texts stay as
    they are, as they have no lines. Rows that share a doc_id, repeated ones too, lose the same lines; lines of a null
    doc_id come last, so they go if they stand anywhere else. An empty table stays empty.
    """
    flags = near_lines(docs, edits, per_edit).where("NOT kept").groupBy(F.col("doc_id").alias("__d")).agg(F.array_sort(F.collect_set("line_no")).alias("__gone"))
    joined = docs.join(flags, docs["doc_id"].eqNullSafe(flags["__d"]), "left").withColumn("__lines", F.split("text", "\n"))
    kept = "array_join(transform(array_except(sequence(0, size(__lines) - 1), __gone), i -> get(__lines, i)), '\\n')"
    changed = joined.withColumn("__text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.expr(kept)))
    changed = changed.where("__gone IS NULL OR trim(translate(__text, '\\n', ' ')) <> ''")
    columns = {c: docs[c] for c in docs.columns} | {"text": F.col("__text").alias("text")}
    if "n_chars" in columns:
        n = F.length("__text").cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.col("__gone").isNull(), docs["n_chars"]).otherwise(n).alias("n_chars")
    return changed.select(*columns.values())
