"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is the logistic of the summed weights of its words, a
document's the noisy-or of its sentences' scores, and the weights are fitted to document labels alone. The
sentence scores then say where the offence stands.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, lower_bytes, spans_of, stored, text_buffers, word_hashes

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_STOP = np.zeros(256, bool)
_STOP[[*b".!?\n\r"]] = True


@dataclass
class Bags:
    """Words of some texts: hash, and the sentence of each; document and byte span of each sentence."""

    words: np.ndarray
    sentence: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray


def bags(data: np.ndarray, offsets: np.ndarray) -> Bags:
    low = lower_bytes(data)
    start, end = spans_of(_WORD[low], offsets)
    doc = np.searchsorted(offsets, start, "right") - 1
    stops = np.zeros(len(low) + 1, np.int64)
    np.cumsum(_STOP[low], out=stops[1:])
    new = np.ones(len(start), bool)
    new[1:] = (stops[start[1:]] != stops[start[:-1]]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1 if len(first) else first
    return Bags(word_hashes(low, start, end), np.cumsum(new) - 1, doc[first], start[first], end[last])


@dataclass
class Model:
    """Sorted word hashes, their weights, and what a sentence has besides."""

    words: np.ndarray
    weights: np.ndarray
    bias: float

    def sentence_logits(self, b: Bags) -> np.ndarray:
        if not len(self.words):
            return np.full(len(b.doc), self.bias)
        at = np.minimum(np.searchsorted(self.words, b.words), len(self.words) - 1)
        found = self.words[at] == b.words
        pair = np.unique(b.sentence[found] * len(self.words) + at[found])  # a word counts once in a sentence
        return self.bias + np.bincount(pair // len(self.words), self.weights[pair % len(self.words)], len(b.doc))

    def doc_scores(self, b: Bags, n: int) -> tuple[np.ndarray, np.ndarray]:
        logits = self.sentence_logits(b)
        miss = np.bincount(b.doc, -np.logaddexp(0, logits), n)
        return -np.expm1(miss), 1 / (1 + np.exp(-np.clip(logits, -500, 500)))


def fit(texts: list[str], labels: list[int], min_docs: int = 4, z_least: float = 3.0, l2: float = 0.002, rounds: int = 300) -> Model:
    """Weights from document labels: words tied to the label (two-proportion z), then Adam on the noisy-or likelihood."""
    y = np.asarray(labels, np.int64)
    sizes = np.zeros(len(texts) + 1, np.int64)
    raw = [t.encode("utf-8", "replace") for t in texts]
    np.cumsum(list(map(len, raw)), out=sizes[1:])
    parts = list(chunks(sizes))

    def bags_of(i: int, j: int) -> Bags:
        return bags(np.frombuffer(b"".join(raw[i:j]), np.uint8), sizes[i : j + 1] - sizes[i])

    # how many documents of either label hold a word, part by part
    found, n_sentences = [], 0
    for i, j in parts:
        b = bags_of(i, j)
        n_sentences += len(b.doc)
        own, at = np.unique(b.words, return_inverse=True)
        pair = np.unique(at * (j - i) + b.doc[b.sentence])
        found.append((own, np.bincount(pair // (j - i), minlength=len(own)), np.bincount(pair // (j - i), y[i + pair % (j - i)], len(own))))
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    prior = -6.0
    if not n1 or not n0 or not n_sentences:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 3.0 if n1 and not n0 else prior)
    vocabulary, at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
    df, df1 = (np.bincount(at, np.concatenate([f[k] for f in found]), len(vocabulary)) for k in (1, 2))
    p = df / len(y)
    z = (df1 / n1 - (df - df1) / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
    keep = vocabulary[(df >= min_docs) & (z >= z_least)]
    # each word once for each sentence
    rows, columns, docs, before = [], [], [], 0
    for i, j in parts:
        b = bags_of(i, j)
        at = np.minimum(np.searchsorted(keep, b.words), max(0, len(keep) - 1))
        used = keep[at] == b.words if len(keep) else np.zeros(len(at), bool)
        pair = np.unique(b.sentence[used] * max(1, len(keep)) + at[used])
        rows.append(before + pair // max(1, len(keep)))
        columns.append(pair % max(1, len(keep)))
        docs.append(b.doc + i)
        before += len(b.doc)
    row, column, doc = np.concatenate(rows), np.concatenate(columns), np.concatenate(docs)
    w, grad, first, second = (np.zeros(len(keep) + 1) for _ in range(4))
    w[-1] = prior
    for step in range(1, rounds + 1):
        logits = w[-1] + np.bincount(row, w[column], n_sentences)
        miss = np.minimum(np.bincount(doc, -np.logaddexp(0, logits), len(y)), -1e-12)
        slope = np.where(y == 1, np.exp(miss) / -np.expm1(miss), -1.0)
        slope = slope * np.where(y == 1, len(y) / 2 / n1, len(y) / 2 / n0)
        by_sentence = slope[doc] / (1 + np.exp(-np.clip(logits, -500, 500)))
        grad[:-1] = -np.bincount(column, by_sentence[row], len(keep)) / len(y)
        grad[-1] = -by_sentence.sum() / len(y)
        grad *= -1
        grad[:-1] -= l2 / len(y) * w[:-1]
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        w = w + 0.2 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    return Model(keep, w[:-1], float(w[-1]))


def held_out():
    """Whether a document is kept from training; false for a null doc_id, which no label can name."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int, most_bytes: int) -> DataFrame:
    """doc_id, text and toxic of labelled rows that aren't held out, in the order of a hash of doc_id: of each label
    per_class rows at most, and whole texts of most_bytes / 2 at most. Of a doc_id's texts the least one counts. Texts beyond
    a sixteenth of that room come last, and those beyond all of it are left out, so a few long ones don't use it up."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = [rows.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    picked = picked[0].union(picked[1])
    texts = stored(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")), "labelled")
    size, room = F.coalesce(F.octet_length("text"), F.lit(0)), most_bytes // 2
    sofar = F.sum(size).over(Window.partitionBy("toxic").orderBy(size > room // 16, F.xxhash64("doc_id"), "doc_id"))  # over 2 * per_class rows at most
    fitting = texts.where(size <= room).select("doc_id", sofar.alias("sofar")).where(F.col("sofar") <= most_bytes // 2).select("doc_id")
    return texts.join(fitting, "doc_id", "left_semi")


def train(docs: DataFrame, labels: DataFrame, per_class: int = 3000, most_bytes: int = 1 << 26) -> Model:
    """Fits on the driver, on 2 * per_class labelled rows and most_bytes of text at most, whatever the size of the tables."""
    rows = training_sample(docs, labels, per_class, most_bytes).orderBy("doc_id").toLocalIterator()
    got = [(r["text"] or "", r["toxic"]) for r in rows]
    return fit([t for t, _ in got], [k for _, k in got])


def score_toxicity(docs: DataFrame, model: Model, at_least: float = 0.5) -> DataFrame:
    """One row per document: doc_id, score, predicted, n_sentences and ``offending``.

    offending: array of (start, end, score) of the sentences that score at_least, in UTF-8 bytes of the text.
    Only the text is scored. Null and empty texts have no sentence and score 0. Whole texts are read, in parts of
    about 1 MB or one document. Rows are independent: repeated rows give repeated results, an empty table none;
    other columns are not looked at.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    place = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j in chunks(offsets):
                own = offsets[i : j + 1] - offsets[i]
                b = bags(data[offsets[i] : offsets[j]], own)
                score, single = model.doc_scores(b, j - i)
                hot: list[list] = [[] for _ in range(j - i)]
                for k in np.flatnonzero(single >= at_least):
                    hot[b.doc[k]].append({"start": int(b.start[k] - own[b.doc[k]]), "end": int(b.end[k] - own[b.doc[k]]), "score": float(single[k])})
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(np.bincount(b.doc, minlength=j - i).astype(np.int64)), pa.array(hot, place)], names=["doc_id", "score", "predicted", "n_sentences", "offending"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int, n_sentences long, offending array<struct<start:long,end:long,score:double>>")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns kept, whose score is below 0.5. Null and empty texts stay."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(at))
            for i, j in chunks(offsets):
                score, _ = model.doc_scores(bags(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), j - i)
                yield batch.slice(i, j - i).filter(pa.array(score < 0.5))

    return docs.mapInArrow(run, docs.schema)
