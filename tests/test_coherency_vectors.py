"""Recordings are made of all vectors."""

import numpy as np
import pandas as pd
import pytest

from voltaloom.plans import queries as Q

N = 307


@pytest.fixture
def vectors(tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(N, 64)).astype("float32")
    x[200] = 1.5  # constant: no correlation
    labels = rng.integers(0, 3, N)
    pd.DataFrame({"vec_id": np.arange(N), "embedding": list(x), "label": labels.astype("int32")}).to_parquet(tmp_path / "embeddings.parquet")
    return str(tmp_path), x.astype(float), labels


def test_coherency_uses_every_vector(spark, vectors):
    d, _, labels = vectors
    got = Q.QUERIES["q61_coherency"](spark, d).where("feature = 'pcorr' and channel = channel2").groupBy("animalday").count().collect()
    assert {r.animalday: r["count"] for r in got} == {str(k): int((labels == k).sum()) for k in range(3)}
    assert any((labels == k).sum() % 2 for k in range(3))
    last = Q.QUERIES["q61_coherency"](spark, d).where("feature = 'pcorr'").groupBy("animalday", "frag_idx").count().collect()
    assert sorted({r["count"] for r in last}) == [1, 4]
