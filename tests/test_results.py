"""Spike results, metadata as JSON, units, single filters, exports and correlations' p."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltaloom.functions import names as N
from voltaloom.functions import stats as ST
from voltaloom.operators import channels as CH
from voltaloom.operators import masks as M
from voltaloom.operators import reshape as RS
from voltaloom.operators import spikes as S
from voltaloom.sources import recordings as R
from voltaloom.sources import spike_results as SR
from voltaloom.sources import tables


def test_spike_results_round_trip(spark, tmp_path):
    spikes = spark.createDataFrame([("d1", "a", 5, 0.05), ("d1", "a", 9, 0.09), ("d2", "b", 0, 0.0)], "animalday string, channel string, sample_idx long, t_s double")
    channels = spark.createDataFrame([("d1", "a", 100.0, 100), ("d1", "b", 100.0, 100), ("d2", "b", 100.0, 50)], "animalday string, channel string, f_s double, samples long")
    folder = f"file://{tmp_path}/r"
    SR.save_spikes(spikes, channels, folder, {"percentile": 99.0, "hz": [10, 20]})
    found, looked, params = SR.load_spikes(spark, folder)
    assert params == {"percentile": 99.0, "hz": [10, 20]} and sorted(map(tuple, found.select(*spikes.columns).collect())) == sorted(map(tuple, spikes.collect()))
    got = {(r.animalday, r.channel): (r.nspike, r.total, r.rate) for r in SR.counts(found, looked).collect()}
    assert got == {("d1", "a"): (2, 2, 2.0), ("d1", "b"): (0, 2, 0.0), ("d2", "b"): (1, 1, 2.0)}
    with pytest.raises(Exception, match="exists"):
        SR.save_spikes(spikes, channels, folder, {})
    SR.save_spikes(spikes.limit(0), channels, folder, {}, overwrite=True)
    assert SR.load_spikes(spark, folder)[0].count() == 0
    for odd in (("d1", "a", 100, 1.0), ("d1", "c", 1, 0.01)):
        with pytest.raises(Exception, match="outside its channel"):
            SR.save_spikes(spark.createDataFrame([odd], spikes.schema), channels, f"file://{tmp_path}/odd", {}, overwrite=True)


def test_annotations_and_back(spark):
    spikes = spark.createDataFrame([("d1", "a", 5, 0.05), ("d1", "b", 9, 0.09)], "animalday string, channel string, sample_idx long, t_s double")
    notes = S.annotations(spikes, 100.0, ["a", "b"]).select("animalday", "onset", "description")
    more = notes.union(spark.createDataFrame([("d1", 1.0, "movement")], notes.schema))
    assert sorted(map(tuple, SR.from_annotations(more, 100.0, ["a", "b"]).collect())) == sorted(map(tuple, spikes.collect()))
    with pytest.raises(Exception, match="not there"):
        SR.from_annotations(notes, 100.0, ["a"]).collect()


def test_metadata_as_json(spark):
    meta = R.metadata_of(spark, "/d/x-0", ["LMot", "RMot"], 1000, "mV", session="/d")
    back = R.metadata_from_json(R.metadata_to_json(meta))
    assert back.collect() == meta.collect() and back.columns == meta.columns and meta.first().to_uv == 1000.0
    with pytest.raises(ValueError, match="unknown units"):
        R.metadata_of(spark, "/d/x-0", [], 1000, "parsec")
    with pytest.raises(Exception, match="(?i)malformed"):
        R.metadata_from_json(spark.createDataFrame([("s", "d", 0, "{oops")], "stem string, session string, file_idx int, json string")).collect()


def test_one_unit_or_an_error(spark):
    df = spark.createDataFrame([(["mV", "mV"],), (["mV", "V"],), ([],), (["parsec"],), (None,)], "u array<string>").withColumn("n", F.monotonically_increasing_id())
    one = df.where(F.size("u") == 2).where("u[0] = u[1]").select(N.one_unit(F.col("u"))).first()[0]
    assert one == "mV"
    for odd in (F.array_contains("u", "V"), F.size("u") == 0, F.array_contains("u", "parsec"), F.col("u").isNull()):
        with pytest.raises(Exception, match="no one known unit"):
            df.where(odd).select(N.one_unit(F.col("u"))).collect()


def test_one_filter_at_a_time(spark):
    rows = [("d", i, "m", c, float(v)) for i, (c, v) in enumerate([("a", 10), ("a", 100), ("b", 900), ("b", 60)])]
    df = spark.createDataFrame(rows, "animalday string, frag_idx int, animal string, channel string, rms double")
    value = lambda name, **o: {r.frag_idx: r.rms for r in M.filter_by(df, name, ["rms"], **o).collect()}
    assert value("high_rms", most=500.0) == {0: 10.0, 1: 100.0, 2: None, 3: 60.0} and value("low_rms", least=50.0)[0] is None
    bad = spark.createDataFrame([("d", "a")], "animalday string, channel string")
    assert value("reject_by_session", bad=bad) == {0: None, 1: None, 2: 900.0, 3: 60.0}
    with pytest.raises(ValueError, match="unknown filters"):
        M.filter_by(df, "none")


def test_csv_and_timeseries_errors(spark, tmp_path):
    long = spark.createDataFrame([("rms", "LMot", "WT", 1.5), ("rms", "RMot", None, 2.5)], "feature string, channel string, genotype string, value double")
    tables.save_csv(RS.timeseries(long, "rms", ["genotype"]), f"{tmp_path}/csv")
    back = spark.read.option("header", True).csv(f"{tmp_path}/csv")
    assert sorted((r.genotype or "", r.channel, float(r.value)) for r in back.collect()) == [("", "RMot", 2.5), ("WT", "LMot", 1.5)]
    for odd in ({"groupby": ["none"]}, {"groupby": ["band"]}, {"groupby": ["genotype"], "strict": True}):
        with pytest.raises(ValueError):
            RS.timeseries(long, "rms", **odd)


def test_p_of_correlations(spark):
    def plain(r, n):
        """Two-sided p by integrating the t distribution."""
        t, v = abs(r) * math.sqrt((n - 2) / (1 - r * r)), n - 2
        x = np.linspace(0, t, 200_001)
        y = math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(v * math.pi) * (1 + x * x / v) ** (-(v + 1) / 2)
        return 1 - 2 * np.trapezoid(y, x)

    rows = [(0.5, 10), (-0.3, 40), (0.9, 5), (0.0, 12), (0.05, 1000)]
    got = ST.with_pearson_p(spark.createDataFrame([*rows, (0.7, 2)], "r double, n long")).collect()
    assert all(abs(g.p - plain(r, n)) < 1e-8 for g, (r, n) in zip(got, rows, strict=False)) and got[-1].p == 1.0


def test_correlations_of_arrays(spark):
    rng = np.random.default_rng(2)
    x = [[float(v) for v in rng.normal(size=30)] for _ in range(5)]
    x[3] = [1.0] * 30
    x[4] = [None if i % 3 else v for i, v in enumerate(x[4])]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(x)], "k string, c long, v array<double>")
    for r in CH.pair_correlations(df, ["k"], "c", "v").collect():
        a, b = (np.array(x[i], float) for i in (r.channel, r.channel2))
        ok = ~(np.isnan(a) | np.isnan(b))
        assert (r.r is None) if 3 in (r.channel, r.channel2) else abs(r.r - np.corrcoef(a[ok], b[ok])[0, 1]) < 1e-9
