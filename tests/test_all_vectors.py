"""Correlations are made of all pairs of vectors, against brute force."""

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


def test_all_pairs_within_labels(spark, vectors, monkeypatch):
    monkeypatch.setattr(Q, "PAIR_BLOCK", 30)  # several blocks a label
    d, x, labels = vectors
    with np.errstate(invalid="ignore", divide="ignore"):
        want = np.corrcoef(x)
    pairs = {(i, j) for i in range(N) for j in range(i) if labels[i] == labels[j]}
    got = Q.QUERIES["q63_pcorr_pairs_all"](spark, d).collect()
    assert len(got) == len(pairs) and {(r.c1, r.c2) for r in got} == pairs
    assert all(r.r is None if 200 in (r.c1, r.c2) else abs(r.r - want[r.c1, r.c2]) < 1e-6 for r in got)
    z = Q.QUERIES["q64_zpcorr_all"](spark, d).collect()
    assert len(z) == len(pairs) and all(r.z is None if 200 in (r.c1, r.c2) else abs(r.z - np.arctanh(want[r.c1, r.c2])) < 1e-5 for r in z)
    means = {r.label: r.r for r in Q.QUERIES["q65_matrix_collapse_all"](spark, d).collect()}
    for k in range(3):
        assert abs(means[k] - np.mean([want[p] for p in pairs if labels[p[0]] == k and 200 not in p])) < 1e-6
