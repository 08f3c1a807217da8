import numpy as np
import pytest
from pyspark.sql import functions as F

from voltaloom.operators import lof as L
from voltaloom.operators import neighbours as NB


def plainly(rows, k):
    out = []
    for g in {r[0] for r in rows}:
        own = sorted((i, v) for h, i, v in rows if h == g)
        ids, x = np.array([i for i, _ in own]), np.array([v for _, v in own])
        for i, v in own:
            d = np.sqrt(((x - v) ** 2).sum(1))
            near = sorted((float(a), int(b)) for a, b in zip(d, ids, strict=True) if b != i)[:k]
            out += [(g, i, b, round(a, 9), r + 1) for r, (a, b) in enumerate(near)]
    return sorted(out)


def clustered(n, clusters, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(clusters, 6)) * 60)[rng.integers(clusters, size=n)] + rng.normal(size=(n, 6)) * spread


def table(spark, rows):
    return spark.createDataFrame([(g, i, [float(x) for x in v]) for g, i, v in rows], "g string, item long, v array<double>").repartition(5)


def test_many_cells_ties_copies_and_small_groups(spark):
    v = np.round(clustered(1500, 25, 1))
    rows = [("hot", i, v[i]) for i in range(1500)] + [("hot", 5000 + i, v[0]) for i in range(60)]  # copies of one row
    rows += [("few", i, v[i]) for i in range(4)] + [("one", 7, v[7])] + [("mid", i, v[2 * i] / 3) for i in range(90)]
    got = NB.nearest(table(spark, rows), "g", "item", "v", 5, cell=40)
    assert sorted((r.g, r.item, r.neighbour, round(r.d, 9), r.r) for r in got.collect()) == plainly(rows, 5)


def test_rows_without_a_part_and_empty_tables(spark):
    rows = [("a", 1, [1.0]), ("a", 2, [2.0]), (None, 3, [1.0]), ("a", None, [1.0]), ("a", 4, None)]
    df = spark.createDataFrame(rows, "g string, item long, v array<double>")
    assert sorted((r.item, r.neighbour, r.d) for r in NB.nearest(df, "g", "item", "v", 3).collect()) == [(1, 2, 1.0), (2, 1, 1.0)]
    assert NB.nearest(df.limit(0), "g", "item", "v", 3).count() == 0


def test_pairs_compared_grow_below_the_square(spark, monkeypatch):
    """Clusters of one size: with ten times the rows a row is compared with about as many others, not with ten times as many."""
    seen = {}
    for n in (400, 4000):
        counter = spark.sparkContext.accumulator(0)

        def counted(q, q_id, x, x_id, k, limit=None, real=NB.nearest_of, counter=counter):
            counter.add(len(q) * len(x))
            return real(q, q_id, x, x_id, k, limit)

        monkeypatch.setattr(NB, "nearest_of", counted)
        v = clustered(n, n // 40, 3, 0.5)
        df = table(spark, [("g", i, v[i]) for i in range(n)])
        assert NB.nearest(df, "g", "item", "v", 3, cell=40).count() == 3 * n
        seen[n] = counter.value
    if seen[400]:  # workers that import the module anew do not count
        assert seen[4000] < 30 * seen[400]


def test_large_samples_stay_finite_and_lengths_must_agree(spark):
    rng = np.random.default_rng(5)
    rows = [("d", c, [float(x) for x in rng.normal(size=50) + (1e6 if c == "e" else 0)]) for c in "abcde"]
    df = spark.createDataFrame(rows, "animalday string, channel string, signal array<double>")
    scores = {r.channel: r.lof for r in L.channel_scores(df, 1).collect()}
    assert max(scores, key=scores.get) == "e" and np.isfinite(list(scores.values())).all()
    half = L.channel_scores(df, 1, half_precision=True)
    judged = {r.channel: r.predicted for r in L.evaluate(half, spark.createDataFrame([("d", "e")], "animalday string, channel string"), 1e9).collect()}
    listed = {r.channel for r in half.where(L.bad(F.col("lof"), 1e9)).collect()}
    assert judged["e"] and listed == {c for c, bad in judged.items() if bad}
    short = df.withColumn("signal", F.when(F.col("channel") == "a", F.slice("signal", 1, 20)).otherwise(F.col("signal")))
    with pytest.raises(Exception, match="differ in length"):
        L.channel_scores(short, 1).collect()
