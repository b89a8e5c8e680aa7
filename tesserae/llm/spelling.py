"""Spelling variants: words that differ by one edit, found by search schemes over FM-indexes read in both directions.

A word is searched for twice: once with its left half matched exactly and one error in the right half, once the other way
round. The first search goes from left to right in an index over the reversed vocabulary, the second from right to left
in an index over the vocabulary; both begin at the delimiter beside the exact half, keep an interval of suffix ranks, and
branch to other letters only in the half that may hold the error. Searches allow a replaced or an inserted letter, so of
two words of different lengths the shorter one finds the longer one. An inserted letter differs from the one it precedes,
and the error's place decides which of the two searches may find it, so each pair is found once in each direction.

Words meet by what has to be equal: length and exact half. A task indexes the words of whole groups, a bounded number at
a time. The rows of a group beyond that bound are dealt anew by half as wide error windows and all that lies outside of
them; a window of one letter leaves too few words to be large, so no group has to be cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored

#: Rows from which a group is dealt anew; rows and letters that are indexed at a time, but for one group.
MOST_ROWS, BATCH_ROWS, BATCH_LETTERS = 1 << 15, 1 << 14, 1 << 20
RUNS = "[a-zÀ-ÿ]+"


def vocabulary(docs: DataFrame, least_length: int = 5, least_count: int = 3, every: int = 97) -> DataFrame:
    """word and n, its occurrences, of the words of all texts.

    A run of letters whose crc32 (of doc_id, a colon and the run with A-Z lower-cased) is divisible by ``every`` loses
    the letter at that number modulo its length. A null doc_id is written as nothing.
    """
    runs = F.explode(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(RUNS), F.lit(0))).alias("run")
    words = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), runs).where(F.length("run") >= least_length)
    hashed = words.withColumn("h", F.crc32(F.concat("d", F.lit(":"), "run"))).withColumn("p", F.expr("int(h % length(run))"))
    word = F.when(F.col("h") % every == 0, F.expr("concat(substring(run, 1, p), substring(run, p + 2))")).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


class Index:
    """An FM-index of delimited words: sorted keys (symbol before a suffix, rank of the suffix)."""

    def __init__(self, text: np.ndarray, longest: int, symbols: int):
        n = len(text)
        self.n, self.symbols, bits = n, symbols, max(1, int(symbols - 1).bit_length())
        k = 62 // bits
        key, padded = np.zeros(n, np.int64), np.concatenate([text, np.zeros(k, np.int64)])
        for i in range(k):
            key = key << bits | padded[i : i + n]
        while True:
            order = np.argsort(key, kind="stable")
            rank = np.zeros(n, np.int64)
            rank[order] = np.cumsum(np.diff(key[order], prepend=key[order[:1]]) != 0)
            if k >= longest + 2 or rank[order[-1]] == n - 1:  # longer prefixes are never asked for
                break
            after = np.zeros(n, np.int64)
            after[: max(0, n - k)] = rank[k:] + 1
            key, k = rank * (n + 1) + after, 2 * k
        self.suffixes = order
        self.before = text[order - 1]
        self.keys = np.sort(self.before * (n + 1) + np.arange(n))

    def extend(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """The interval of suffixes that begin with the symbol and go on as those in each interval did."""
        base = symbol * (self.n + 1)
        return np.searchsorted(self.keys, base + low), np.searchsorted(self.keys, base + high)

    def children(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each interval's row with each symbol, but the delimiter, that stands before its suffixes."""
        few = high - low <= self.symbols
        rows, size = np.flatnonzero(few), (high - low)[few]
        owner = np.repeat(rows, size)
        at = np.repeat(low[rows] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(len(owner)) if len(rows) else owner
        found = np.unique(owner * self.symbols + self.before[at])
        wide = (np.flatnonzero(~few)[:, None] * self.symbols + np.arange(self.symbols)).ravel()
        found = np.concatenate([found, wide])
        found = found[found % self.symbols > 0]
        return found // self.symbols, found % self.symbols


def search(index: Index, words: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, leftwards: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pattern, rank and whether a letter is inserted, of each delimited word one error away from a pattern.

    words: [pattern, place] in reading order. a, b: the letters, counted from the left, that may be replaced or have a
    letter inserted before them; one may also be inserted behind the last letter, if that may be replaced.
    """
    pattern = np.arange(len(size))
    low, high = index.extend(np.zeros(len(size), np.int64), np.full(len(size), index.n), 0)
    err = np.zeros((4, 0), np.int64)  # pattern, low, high, inserted
    out: list[np.ndarray] = []
    for i in range(int(size.max(initial=-1)) + 1):
        m = size[pattern]
        replaced, inserted = (m - 1 - i, m - i) if leftwards else (np.full(len(m), i), np.full(len(m), i))
        may_replace = (replaced >= a[pattern]) & (replaced < b[pattern]) & (i < m)
        may_insert = (inserted >= a[pattern]) & (inserted < b[pattern] + (b[pattern] == m))
        todo = np.flatnonzero(may_replace | may_insert)
        fresh = np.zeros((4, 0), np.int64)
        if len(todo):
            row, symbol = index.children(low[todo], high[todo])
            row = todo[row]
            clo, chi = index.extend(low[row], high[row], symbol)
            row, symbol, clo, chi = (x[chi > clo] for x in (row, symbol, clo, chi))
            who = pattern[row]
            here = words[who, np.minimum(i, words.shape[1] - 1)]
            right = words[who, i - 1] if leftwards and i else np.zeros(len(who), np.int64) if leftwards else np.where(i < size[who], here, 0)
            put = may_insert[row] & (symbol != right)
            swap = may_replace[row] & (symbol != here)
            err = np.concatenate([err, np.stack([who, clo, chi, np.ones(len(who), np.int64)])[:, put]], axis=1)
            fresh = np.stack([who, clo, chi, np.zeros(len(who), np.int64)])[:, swap]
        ended = size[err[0]] == i
        if ended.any():
            lo, hi = index.extend(err[1, ended], err[2, ended], 0)
            out.append(np.stack([err[0, ended], lo, err[3, ended]])[:, hi > lo])
            err = err[:, ~ended]
        if err.shape[1]:
            lo, hi = index.extend(err[1], err[2], words[err[0], i])
            err = np.stack([err[0], lo, hi, err[3]])[:, hi > lo]
        err = np.concatenate([err, fresh], axis=1)
        on = i < m
        pattern = pattern[on]
        low, high = index.extend(low[on], high[on], words[pattern, i] if len(pattern) else 0)
        pattern, low, high = (x[high > low] for x in (pattern, low, high))
        if not len(pattern) and not err.shape[1]:
            break
    found = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
    return found[0], found[1], found[2] > 0


def near_words(words: list[str], pattern: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of patterns, of the words found (among ``words``, all different) and whether these are longer."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le"), np.uint32).astype(np.int64)
    alphabet, text = np.unique(letters, return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(lengths + 1)])  # of the delimiter before each word
    out = []
    for leftwards in (False, True):
        picked = np.flatnonzero((a < lengths[pattern] - b) == leftwards)
        if not len(picked):
            continue
        index = Index(text if leftwards else text[::-1].copy(), int(lengths.max()), len(alphabet))
        # patterns of about the same length are searched for together
        order = picked[np.argsort(lengths[pattern[picked]], kind="stable")]
        ordered = lengths[pattern[order]]
        at = 0
        while at < len(order):
            until = max(at + 1, int(np.searchsorted(ordered, 2 * ordered[at] + 8, "right")))
            until = min(until, at + max(1, BATCH_LETTERS // int(ordered[at:until].max())))
            part = order[at:until]
            size = lengths[pattern[part]]
            place = np.arange(int(size.max()))
            inside = np.minimum(place, size[:, None] - 1)
            read = begin[pattern[part]][:, None] + (size[:, None] - inside if leftwards else 1 + inside)
            who, rank, longer = search(index, text[read], size, a[part], b[part], leftwards)
            stands = index.suffixes[rank]
            word = np.searchsorted(begin, stands if leftwards else len(text) - 1 - stands) - (not leftwards)
            out.append(np.stack([part[who], word, longer]))
            at = until
    found = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
    return found[0], found[1], found[2] > 0


def _deal(rows: DataFrame) -> DataFrame:
    """word, n, m, a, b with the key of what has to be equal: m, the window [a, b) and the letters outside of it.

    m: the length of the patterns that may find the word, its own or one less. Keys are hashes, as groups that are one
    by accident only share an index.
    """
    return rows.withColumn("key", F.expr("xxhash64(m, a, b, substring(word, 1, a), right(word, m - b))"))


def near_pairs(words: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """word, near and near_n: every ordered pair of words that differ by one edit, once.

    words: word (distinct, not null, of two letters or more) and n.
    """
    each = words.select("word", "n", F.explode(F.expr("filter(array(length(word), length(word) - 1), x -> x > 0)")).alias("m"))
    halves = F.explode(F.expr("array(struct(0 AS a, m div 2 AS b), struct(m div 2 AS a, m AS b))"))
    rows = stored(_deal(each.select("word", "n", "m", halves.alias("w")).select("word", "n", "m", F.col("w.a").cast("int").alias("a"), F.col("w.b").cast("int").alias("b"))), "spelling-rows")
    ready = []
    while True:
        large = rows.groupBy("key").agg(F.count("*").alias("c"), F.max(F.col("b") - F.col("a")).alias("wide")).where((F.col("c") > most_rows) & (F.col("wide") > 1)).select("key")
        large = stored(large, "spelling-large")
        if large.isEmpty():
            ready.append(rows)
            break
        ready.append(rows.join(large, "key", "left_anti"))
        mid = F.expr("(a + b) div 2")
        parts = F.explode(F.when(F.col("b") - F.col("a") > 1, F.array(F.struct(F.col("a"), mid.alias("b")), F.struct(mid.alias("a"), F.col("b")))).otherwise(F.array(F.struct("a", "b"))))
        again = rows.join(large, "key", "left_semi").select("word", "n", "m", parts.alias("w"))
        rows = stored(_deal(again.select("word", "n", "m", F.col("w.a").cast("int").alias("a"), F.col("w.b").cast("int").alias("b"))), "spelling-rows")
    found = None
    for part in ready:
        dealt = part.select("key", "word", "n", "m", "a", "b").repartition("key").sortWithinPartitions("key")
        pairs = dealt.mapInArrow(_found, "word string, near string, near_n long")
        found = pairs if found is None else found.union(pairs)
    return found


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs among rows sorted by their key, whole groups at a time."""
    waiting: list[pa.Table] = []
    rows = letters = 0
    for batch in batches:
        t = pa.Table.from_batches([batch])
        key = t["key"].to_numpy()
        first = np.flatnonzero(np.diff(key)) + 1
        if waiting and waiting[-1]["key"][-1].as_py() != key[0]:
            first = np.concatenate([[0], first])
        weight = np.concatenate([[0], np.cumsum([len(w) for w in t["word"].to_pylist()])])
        at = 0
        for cut in first.tolist():
            if rows + cut - at >= BATCH_ROWS or letters + weight[cut] - weight[at] >= BATCH_LETTERS:
                yield from _pairs([*waiting, t.slice(at, cut - at)])
                waiting, rows, letters, at = [], 0, 0, cut
        if at < len(t):
            waiting.append(t.slice(at))
            rows, letters = rows + len(t) - at, letters + int(weight[-1] - weight[at])
    if waiting:
        yield from _pairs(waiting)


def _pairs(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
    t = pa.concat_tables(tables)
    if not len(t):
        return
    coded = t["word"].combine_chunks().dictionary_encode()
    words, place = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    n = np.zeros(len(words), np.int64)
    n[place] = t["n"].to_numpy()
    m, a, b = (t[c].to_numpy().astype(np.int64) for c in "mab")
    own = np.fromiter(map(len, words), np.int64, len(words))[place] == m
    who, word, longer = near_words(words, place[own], a[own], b[own])
    left, right = place[own][who], word
    left, right = np.concatenate([left, right[longer]]), np.concatenate([right, left[longer]])
    held = coded.dictionary
    for k in range(0, len(left), BATCH_ROWS):
        l, r = left[k : k + BATCH_ROWS], right[k : k + BATCH_ROWS]
        yield pa.RecordBatch.from_arrays([held.take(pa.array(l)), held.take(pa.array(r)), pa.array(n[r])], names=["word", "near", "near_n"])


def spelling_groups(docs: DataFrame, **settings) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the vocabulary.

    docs: doc_id and text; settings: those of vocabulary. form: of the words one edit away the one with the largest n
    (ties: the smallest by code points), if that n is at least twice the word's own, else null; form_n: its n. root: the
    last word on the way over forms, the word itself if it has none. n_near: how many words are one edit away. Null and
    empty texts have no words; a repeated row counts again; long texts and words of any length are read whole; an empty
    table gives no rows; other columns are not looked at, whatever their names. Pairs are counted per word before they
    are shuffled; roots follow by doubling, at most as often as log2 of the longest way.
    """
    words = stored(vocabulary(docs, **settings), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    joined = words.join(near, "word", "left").withColumn("has", F.coalesce(-F.col("best.less") >= 2 * F.col("n"), F.lit(False)))
    form, form_n = (F.when(F.col("has"), c) for c in (F.col("best.near"), -F.col("best.less")))
    formed = stored(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form"), form_n.alias("form_n")), "forms")
    up = stored(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        above = up.select(F.col("word").alias("root"), F.col("root").alias("higher"))
        moved = stored(up.join(above, "root", "left").select("word", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")), "roots")
        up = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
    return formed.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
