"""Near copies: words are hashed once, and sets of very different sizes don't meet."""

import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tesserae.llm import common, near_dedup


def test_words_that_come_again_are_hashed_once(monkeypatch):
    calls, blake2b = [], hashlib.blake2b
    monkeypatch.setattr(common.hashlib, "blake2b", lambda data, **more: calls.append(bytes(data)) or blake2b(data, **more))
    words = [f"w{k}again" for k in range(500)]
    data, offsets = common.text_buffers(pa.array([" ".join(words)]))
    start, end = common.space_words(data, offsets)
    first = common.word_hashes(data, start, end)
    assert (common.word_hashes(data, start, end) == first).all() and len(calls) == 500
    monkeypatch.setattr(common, "_MOST_KNOWN", 100)  # none of them fit
    common._KNOWN.clear()
    assert (common.word_hashes(data, start, end) == first).all() and len(common._KNOWN) <= 100
    assert (common.word_hashes(data, start, end) == first).all()


def group(seed=5):
    """Texts whose sets have 10 to 3,000 shingles, and near copies of every tenth one."""
    rng, texts = random.Random(seed), []
    for k in range(700):
        words = [f"x{rng.randrange(10**6)}" for _ in range(int(14 * 200 ** (k / 700)))]
        texts.append(" ".join(words))
        if k % 10 == 0:
            texts.append(" ".join([*words, "more"]))
    rng.shuffle(texts)
    return texts


def test_sets_of_other_sizes_dont_meet(spark, monkeypatch, tmp_path):
    texts = group()
    sets = [set(zip(*(w[i:] for i in range(5)))) for w in (t.split() for t in texts)]
    want = {(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    placed = docs.select(F.lit(7).cast("long").alias("node"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("sketch"), F.col("doc_id").alias("root"))
    sizes = near_dedup.signatures(docs).select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("low"), F.col("n_shingles").alias("high"))
    got = {(max(r.a, r.b), min(r.a, r.b)) for r in near_dedup.resolve(placed, docs, sizes).collect()}
    assert len(want) >= 60 and got == want
    counted = lambda batches: (pa.RecordBatch.from_arrays([b.column(1), pa.array(np.ones(len(b), np.int64))], names=["a", "b"]) for b in batches)
    monkeypatch.setattr(near_dedup, "_tile", counted)
    parts = -(-len(texts) // near_dedup.SIDE)
    assert near_dedup.resolve(placed, docs, sizes).count() < len(texts) * parts


def test_members_without_words_dont_link(spark):
    """Two ids that have a text and an empty one each."""
    rows = [(1, "a b c d e f g h"), (1, ""), (2, "k l m n o p q r"), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    placed = spark.createDataFrame([(7, 1, 0, 1), (7, 2, 0, 2)], "node long, id long, sketch long, root long")
    sizes = spark.createDataFrame([(1, 0, 4), (2, 0, 4)], "id long, low long, high long")
    assert near_dedup.resolve(placed, docs, sizes).count() == 0
