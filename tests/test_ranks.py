import random
from collections import defaultdict
from math import erf

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltaloom.functions import stats as ST
from voltaloom.operators import aggregate as A
from voltaloom.operators import ranks as RK


def rows(n=3000):
    """A key with half of the rows, one of one row, a null key; ties, nulls and one very common value."""
    rng = random.Random(11)
    key = lambda: rng.choice(["hot"] * 5 + ["a", "b", None])
    value = lambda: rng.choice([None, 7.0, 7.0, 7.0, round(rng.gauss(0, 3), 1), rng.random()])
    return [(i, key(), value(), rng.randrange(3)) for i in range(n)] + [(n, "one", 2.5, 0), (n + 1, "none", None, 1)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(rows(), "id long, k string, v double, g int").repartition(7).cache()


def by_key(values=True):
    out = defaultdict(list)
    for i, k, v, g in rows():
        if v is not None or not values:
            out[k].append((v, i, g))
    return out


def test_row_numbers_and_prefix_sums(df):
    got = {r.id: (r.n, r.total) for r in RK.row_numbers(df, ["k"], ["id"], "n", "total").collect()}
    want = {i: (n + 1, len(x)) for x in by_key(False).values() for n, (i, _) in enumerate(sorted((i, v) for v, i, _ in x))}
    assert got == want
    sums = {r.id: (r.v_before, r.v_all) for r in RK.prefix_sums(df, ["k"], ["id"], ["v"]).collect()}
    for x in by_key(False).values():
        total = 0.0
        for i, v in sorted((i, v or 0.0) for v, i, _ in x):
            assert abs(sums[i][0] - total) < 1e-9
            total += v
        assert all(abs(sums[i][1] - total) < 1e-9 for _, i, _ in x)


def test_quantiles_and_modified_z(df):
    shares = {"q0": 0.0, "q1": 0.25, "mid": 0.5, "q9": 0.93, "top": 1.0}
    got = {r.k: r for r in RK.quantiles(df, ["k"], "v", shares).collect()}
    want = by_key()
    assert set(got) == set(want)
    for k, x in want.items():
        for name, share in shares.items():
            assert abs(got[k][name] - np.quantile([v for v, _, _ in x], share)) < 1e-12
    scores = {r.id: r.modified_z for r in A.modified_z(df.where("k is not null"), "v", ["k"]).collect()}
    assert set(scores) == {i for i, k, _, _ in rows() if k is not None}
    for k in ("hot", "a", "b"):
        v = np.array([x[0] for x in want[k]])
        mad = np.median(np.abs(v - np.median(v)))
        for x, i, _ in want[k]:
            assert scores[i] is None if mad == 0 else abs(scores[i] - 0.6745 * (x - np.median(v)) / mad) < 1e-9


def test_mann_whitney_and_ks(df):
    got = {r.k: r for r in ST.mann_whitney(df, "v", "g", 0, ["k"]).collect()}
    ks = {r.k: r.ks for r in ST.ks_statistic(df, "v", ST.normal_cdf, ["k"]).collect()}
    for k, x in by_key().items():
        a, b = [v for v, _, g in x if g == 0], [v for v, _, g in x if g != 0]
        assert abs(got[k].u - sum((p > q) + 0.5 * (p == q) for p in a for q in b)) < 1e-6 and (got[k].n1, got[k].n2) == (len(a), len(b))
        v = np.sort([x[0] for x in x])
        u = np.array([0.5 * (1 + erf(t / 2**0.5)) for t in v])
        i = np.arange(1, len(v) + 1)
        assert abs(ks[k] - max((i / len(v) - u).max(), (u - (i - 1) / len(v)).max())) < 1e-12


def test_normal_distribution_function(spark):
    x = [-40.0, -9.0, -7.1, -7.0, -2.5, -0.3, 0.0, 1e-9, 0.7, 3.0, 7.05, 8.0, 50.0]
    got = spark.createDataFrame([(v,) for v in x], "x double").select(ST.normal_cdf(F.col("x"))).collect()
    assert all(abs(r[0] - 0.5 * (1 + erf(v / 2**0.5))) < 1e-14 for r, v in zip(got, x, strict=True))


def test_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], "k string, v double")
    assert RK.quantiles(empty, ["k"], "v", {"q": 0.5}).count() == 0 and RK.row_numbers(empty, ["k"], ["v"]).count() == 0
    odd = spark.createDataFrame([("a", 1.0, 5), ("a", 2.0, 6)], "k_x string, v double, n long")
    assert [r.q for r in RK.quantiles(odd, ["k_x"], "v", {"q": 0.5}).collect()] == [1.5]
    assert sorted((r.v, r.n, r.place) for r in RK.row_numbers(odd, ["k_x"], ["v"], "place").collect()) == [(1.0, 5, 1), (2.0, 6, 2)]


def test_no_task_holds_a_key(spark):
    """A key with all rows is dealt over the partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = RK.prefix_sums(spark.range(20_000).select(F.lit("k").alias("k"), F.col("id"), F.lit(1).alias("x")), ["k"], ["id"], ["x"])
        sizes = [n for n in placed.select(F.spark_partition_id().alias("p")).groupBy("p").count().toPandas()["count"]]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) <= 15_000 and len(sizes) > 1
