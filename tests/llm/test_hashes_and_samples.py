"""Words that share the quick hash, and training texts beyond their room."""

import hashlib
import random

import numpy as np
import pyarrow as pa

from tesserae.llm.common import LONG_WORD, space_words, text_buffers, word_hashes
from tesserae.llm.near_dedup import near_duplicates
from tesserae.llm.toxicity import score_toxicity, train, training_sample

#: Two words whose quick hashes are equal: the second eight bytes undo what the first eight made different.
TWINS = ("rs18bf38qzqzqzqz", "m3a8stsp6q`qumti")


def test_words_are_hashed_by_their_bytes():
    rng = random.Random(4)
    words = [*TWINS, *TWINS, *("".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(3000)), "x" * LONG_WORD, "x" * (LONG_WORD + 1), "y" * 5000, "y" * 5000]
    data, offsets = text_buffers(pa.array([" ".join(words)]))
    start, end = space_words(data, offsets)
    want = [int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") for w in words]
    assert word_hashes(data, start, end).tolist() == want
    assert word_hashes(data, start[:0], end[:0]).tolist() == []


def test_words_with_equal_quick_hashes_link_nothing(spark):
    docs = spark.createDataFrame([(1, TWINS[0]), (2, TWINS[1]), (3, TWINS[1])], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 2}


def test_long_texts_leave_room_for_their_class(spark):
    docs = [(k, ("vile rotten " if k % 2 else "kind gentle ") * (3000 if k in (1, 3) else 4)) for k in range(80)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(80)], "doc_id long, quality int, toxic int")
    for most in (4000, 80_000):
        rows = training_sample(table, labels, 100, most).collect()
        assert {r["toxic"] for r in rows} == {0, 1} and sum(len(r["text"]) for r in rows if r["toxic"]) <= most // 2
        assert min(sum(r["toxic"] == k for r in rows) for k in (0, 1)) > 20
    scores = {r["doc_id"]: r["score"] for r in score_toxicity(table, train(table, labels, most_bytes=4000)).collect()}
    assert np.mean([scores[k] for k in range(80) if k % 2]) > np.mean([scores[k] for k in range(80) if not k % 2])
