import numpy as np
from pyspark.sql import functions as F

from voltaloom.llm import hard_negatives as hn


def plainly(rows, is_anchor, positives=5, negatives=3):
    """rows: (vec_id, label, whole vector); every pair scored."""
    dims = max([len(v) for _, _, v in rows], default=0)
    wide = [(i, lab, [int(x) for x in v] + [0] * (dims - len(v))) for i, lab, v in rows]
    found = []
    for anchor, lab, q in {(i, lab, tuple(v)) for i, lab, v in wide if is_anchor(i)}:
        score = [(sum(a * b for a, b in zip(q, v, strict=True)), i, other) for i, other, v in wide]
        best = sorted((-s, i) for s, i, other in score if other == lab and i != anchor)[:positives]
        for minus, pos in best:
            p = -minus
            fit = sorted((-s, i) for s, i, other in score if other != lab and 50 * p <= 100 * s <= 95 * p)[:negatives]
            found += [(anchor, pos, r + 1, i, p, -s) for r, (s, i) in enumerate(fit)]
    return sorted(found)


def mined(spark, rows, every, **more):
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>").repartition(3)
    whole = hn.whole_vectors(df, F.col("vec_id"), F.col("label"), F.col("embedding"), 1.0)
    return sorted(map(tuple, hn.mine_hard_negatives(whole, F.col("vec_id") % every == 0, **more).collect()))


def test_clusters_ties_and_a_hot_label(spark, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK", 64)
    monkeypatch.setattr(hn, "CHUNK", 16)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8)) * 40
    rows = []
    for i in range(900):
        v = np.floor(centres[rng.integers(12)] + rng.normal(size=8) * 6)
        rows.append((i, "abc"[min(2, rng.integers(6))], [float(x) for x in v]))
    rows += [(1000 + i, "a", [10.0] * 8) for i in range(150)] + [(1200 + i, "b", [9.0] * 8) for i in range(150)]  # ties
    assert mined(spark, rows, 10) == plainly(rows, lambda i: i % 10 == 0)


def test_long_vectors_need_exact_arithmetic(spark):
    rng = np.random.default_rng(1)
    for scale in (3000, 40_000_000, 700_000_000):
        rows = [(i, str(i % 3), [float(x) for x in np.floor(rng.normal(size=4) * scale).clip(-(2**31) + 1, 2**31 - 1)]) for i in range(120)]
        rows = [r for r in rows if sum(x * x for x in r[2]) < 2**62]
        assert mined(spark, rows, 6) == plainly(rows, lambda i: i % 6 == 0), scale


def test_odd_rows(spark):
    rows = [
        (0, "a", [2.0, 1.0]), (0, "a", [2.0, 1.0]), (0, "b", [1.0]), (50, "a", []), (3, "a", [2.0, 2.0]), (3, "a", [2.0, 2.0]), (4, "b", [1.0, 1.0]), (5, "b", [1.0, 1.5]),
        (6, None, [1.0, 1.0]), (7, "a", None), (8, "a", [None, 1.0]), (9, "a", [float("nan"), 1.0]), (10, "b", [float("inf"), 1.0]), (None, "b", [1.0, 1.0]), (100, "only", [1.0, 1.0]),
    ]
    fit = [(i, lab, [float(np.floor(x)) for x in v]) for i, lab, v in rows if i is not None and lab and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    assert mined(spark, rows, 50) == plainly(fit, lambda i: i % 50 == 0)
    assert mined(spark, [], 50) == [] and mined(spark, [(1, "a", [1.0])], 50) == []


def test_search_leaves_buckets_out(spark):
    """Bounds hold for each bucket, and in few dimensions an anchor sees few of the rows; in many, distances are too much alike to leave rows out."""
    rng = np.random.default_rng(2)
    v = np.floor((rng.normal(size=(40, 3)) * 200)[rng.integers(40, size=4000)] + rng.normal(size=(4000, 3)) * 5).astype(np.int64)
    most = float((v * v).sum(1).max())
    tree = hn.Tree(hn._augmented(v, most), 6)
    row = {"label": "a", "ids": tree.order.tobytes(), "vectors": v[tree.order].astype(np.int32).tobytes(), "bounds": np.asarray(tree.bounds).tobytes(), "vantage": tree.vantage.tobytes(), "intervals": tree.interval.tobytes()}
    block = hn.Block(row, 3, most)
    asked = np.arange(50)
    s = hn.Search(v[:50], asked, np.full(50, -1e18), np.full(50, 1e18), 3, most)
    least, greatest = s.reach(block, asked)
    for b in range(64):
        true = v[:50] @ block.v[block.bounds[b] : block.bounds[b + 1]].astype(np.int64).T
        assert (true.min(1) >= least[:, b]).all() and (true.max(1) <= greatest[:, b]).all()
    seen, scan = [], hn.Search.scan
    s.scan = lambda blk, bucket, queries: seen.append(len(queries)) or scan(s, blk, bucket, queries)
    s.visit(block, asked)
    true = np.sort(v[:50] @ v.T - np.where(np.eye(50, 4000) > 0, 1 << 40, 0), axis=1)[:, ::-1][:, :3]
    assert (s.best == true).all() and sum(seen) < 0.3 * 50 * 64
