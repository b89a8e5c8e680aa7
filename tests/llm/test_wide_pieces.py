"""Recall of the vector search where pieces are wider than eight bits."""

import numpy as np
import pytest

from tesserae.llm import vectors


@pytest.mark.parametrize(("spare", "width"), [(2, 9), (0, 11)])
def test_recall_at_wide_pieces(spark, monkeypatch, spare, width):
    monkeypatch.setattr(vectors, "SPARE", spare)
    rng = np.random.default_rng(width)
    base = rng.normal(0, 1, (500, 48))
    noise = rng.normal(0, 1, (1000, 48)) * rng.uniform(0.2, 0.42, (1000, 1))
    rows = np.concatenate([base, base[rng.integers(0, 500, 1000)] + noise])
    assert vectors.tables_of(len(rows))[0] == width
    table = spark.createDataFrame([(k, 1, v.tolist()) for k, v in enumerate(rows)], "vec_id long, label int, embedding array<double>")
    found = {r["vec_id"]: r["n_links"] for r in vectors.near_vectors(table).collect()}
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.93).sum(1) - 1
    assert want.sum() > 500 and all(found[k] <= want[k] for k in found)
    assert sum(found.values()) >= 0.97 * want.sum()
