"""Checks that raise, and operators against plain versions."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltaloom.functions import kernels, stats
from voltaloom.operators import lof, masks, sessions


def plain_natural_neighbours(d):
    n = len(d)
    order = [sorted((j for j in range(n) if j != i), key=lambda j: (d[i][j], j)) for i in range(n)]
    lists, repeat = [set() for _ in range(n)], {}
    for r in range(1, n):
        for i in range(n):
            lists[i].add(order[i][r - 1])
        alone = sum(not any(i in lists[j] for j in lists[i]) for i in range(n))
        rep = repeat.get(alone, 0)
        repeat[alone] = rep + 1
        if alone == 0 or rep >= math.sqrt(r - rep):
            return r
    return max(1, n - 1)


def test_natural_neighbours_equal_a_plain_version():
    rng, seen = np.random.default_rng(3), set()
    for _ in range(300):
        x = rng.normal(size=(rng.integers(2, 25), 3))
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        k = kernels.natural_neighbours(d)
        assert k == plain_natural_neighbours(d)
        seen.add(k)
    assert len(seen) > 3


def test_channel_scores_by_blocks(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6, 900)).astype(np.float16).astype(float)
    rows = [("s", f"c{k}", v.tolist()) for k, v in enumerate(x)] + [("one", "c0", x[0].tolist()), ("s", "none", None)]
    df = spark.createDataFrame(rows, "animalday string, channel string, signal array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = kernels.local_outlier_factor(d, kernels.natural_neighbours(d))
    for block in (100, 250, 5000):
        got = {(r.animalday, r.channel): r.lof for r in lof.channel_scores(df, decimation=1, block=block).collect()}
        assert got.keys() == {("one", "c0"), *(("s", f"c{k}") for k in range(6))}
        assert np.allclose([got["s", f"c{k}"] for k in range(6)], want)


def raises(df, words):
    with pytest.raises(Exception, match=words):
        df.collect()


def test_checks_raise(spark):
    f = spark.sql("select * from values ('a', 1, timestamp_ntz'2024-01-01', null, 10.0), ('a', 2, null, null, 10.0) t(s, i, manual_ts, csv_ts, duration)")
    raises(sessions.finalise_timestamps(f), "no timestamp")
    given = spark.sql("select 'a' s, 0L position, timestamp_ntz'2024-01-01' ts")
    raises(sessions.listed_timestamps(f, "s", "i", given), "differ in length")
    more = given.union(spark.sql("select 'a', 1L, timestamp_ntz'2024-01-02'")).union(spark.sql("select 'a', 2L, timestamp_ntz'2024-01-03'"))
    raises(sessions.listed_timestamps(f, "s", "i", more), "differ in length")
    ends = sessions.listed_timestamps(f, "s", "i", more.where("position < 2"), ends=False).collect()
    assert sorted(str(r.end_ts) for r in ends) == ["2024-01-01 00:00:10", "2024-01-02 00:00:10"]
    recs = spark.createDataFrame([("a", 1, 5, 1000), ("a", 2, 6, 500)], "s string, i int, n long, fs int")
    raises(sessions.merge_recordings(recs, "s", "i", "n", ["fs"]), "differ")
    assert [r.offset for r in sessions.merge_recordings(recs, "s", "i", "n", ["s"]).orderBy("i").collect()] == [0, 5]
    raises(sessions.constant_columns(recs, ["s"], ["fs"]), "not constant")
    with pytest.raises(KeyError):
        sessions.project_features(recs, ["s"], ["rms"])
    t = spark.sql("select 'a' s, timestamp_ntz'2024-01-01' + make_interval(0,0,0,0,0,0,cast(id as int)) timestamp, 10.0D duration from range(5)")
    raises(sessions.check_intervals(t, ["s"]), "too many intervals")


def test_absent_session_and_unknown_filter_raise(spark):
    df = spark.createDataFrame([("d1", "a"), ("d2", "b")], "animalday string, channel string")
    bad, listed = df.where("animalday = 'd1'"), df.select("animalday").where("animalday = 'd1'")
    raises(masks.reject_by_session(df, bad, sessions=listed), "missing from the bad channels")
    assert {(r.channel, r.keep) for r in masks.reject_by_session(df, bad, sessions=df.select("animalday")).collect()} == {("a", False), ("b", True)}
    assert masks.reject_by_session(df, bad.limit(0), sessions=listed.limit(0)).where("keep").count() == 2
    with pytest.raises(ValueError):
        masks.apply_filters(df, {"nonsense": {}})
    with pytest.raises(ValueError):
        masks.merge_bad(df, df, "both")
    assert masks.merge_bad(df, bad, "overwrite").count() == 1 and masks.merge_bad(df, bad, None).count() == 2
    assert df.where(masks.reject_channels(["A1"], abbreviations={"a": "A1"})).count() == 1


def test_morphology_windows(spark):
    d = spark.createDataFrame([(4.0,), (4.0,), (5.0,)], "duration double")
    assert masks.morphology_windows(d, 13) == 3 and masks.morphology_windows(d, 1) == 1 and masks.morphology_windows(d.limit(0), 9) == 1


def test_evaluate_lists(spark):
    scores = spark.createDataFrame([("d", "left", 2.0), ("d", "right", None), ("e", "left", 0.5)], "animalday string, channel string, lof double")
    truth = spark.createDataFrame([("d", "L")], "animalday string, channel string")
    got = {(r.animalday, r.channel): (r.predicted, r.truth) for r in lof.evaluate(scores, truth, 1.0, {"left": "L"}).collect()}
    assert got == {("d", "left"): (True, True), ("d", "right"): (False, False), ("e", "left"): (False, False)}
    assert lof.evaluate(scores, None, 1.0, bad=truth.withColumn("channel", F.lit("right"))).where("truth").first().channel == "right"
    raises(lof.evaluate(scores, truth.withColumn("animalday", F.lit("x")), 1.0), "no scores")


def test_normal_quantile(spark):
    p = [0.0001, 0.02, 0.3, 0.5, 0.77, 0.99, 0.99999]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in p], "p double").select(stats.normal_quantile(F.col("p"))).collect()]
    assert np.allclose(got, [statistics.NormalDist().inv_cdf(x) for x in p], atol=1e-6)
    assert spark.range(1).select(stats.normal_quantile(F.lit(0.0))).first()[0] is None


def test_mann_whitney_pairs_equal_counting(spark):
    rng = random.Random(2)
    rows = [(rng.choice("xyz"), float(rng.randint(0, 6))) for _ in range(90)]
    got = {(r.a, r.b): r.u for r in stats.mann_whitney_pairs(spark.createDataFrame([("f", *r) for r in rows] + [("f", None, 1.0), ("f", "x", None)], "facet string, grp string, v double"), "v", "grp", ["facet"]).collect()}
    for a, b in (("x", "y"), ("x", "z"), ("y", "z")):
        p, q = ([v for g, v in rows if g == k] for k in (a, b))
        assert got[a, b] == sum((x > y) + 0.5 * (x == y) for x in p for y in q)


def test_names_and_suffixes(spark):
    df = spark.createDataFrame([("a", 1)], "animal string, index int")
    out = sessions.with_suffix(df, ["animal"])
    assert out.first().animal == out.first().animal and out.first().animal.startswith("a_")
    assert sessions.tidy(df.withColumn("timestamp", F.lit(1))).columns == ["animal", "timestamp"]
