import numpy as np
import pytest
from pyspark.sql import functions as F

from voltaloom.functions import kernels as K
from voltaloom.operators import blocked_spikes as BS
from voltaloom.plans import session_queries as Q

FS = 500.0


def channel(n, seed):
    rng = np.random.default_rng(seed)
    x = np.cumsum(rng.normal(size=n)) * 0.05 + rng.normal(size=n) * 4
    for at in rng.integers(100, max(101, n - 100), max(1, n // 900)):
        x[at - 12 : at + 13] -= 90 * np.hanning(25)[: len(x[at - 12 : at + 13])]
    return x


def pieces(channels, cut):
    rng = np.random.default_rng(cut)
    for (day, name), x in channels.items():
        ends = np.unique([0, *rng.integers(1, len(x), max(1, len(x) // cut)), len(x)])
        yield from ((day, name, int(a), [float(v) for v in x[a:b]]) for a, b in zip(ends, ends[1:], strict=False))


CHANNELS = {("d1", "a"): channel(9000, 1), ("d1", "b"): channel(2500, 2), ("d2", "a"): channel(700, 3), ("d2", "short"): channel(150, 4)[:90]}


@pytest.fixture(scope="module")
def signals(spark):
    return spark.createDataFrame(list(pieces(CHANNELS, 400)), "animalday string, channel string, start long, signal array<double>").cache()


def test_sections_by_chunks_are_the_plain_recurrence():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 10, 1000, 1003):
        for shape in ((n,), (n, 3)):
            x, (b, a) = rng.normal(size=shape), K.notch(60, 1000)
            start = (rng.normal(size=shape[1:]), rng.normal(size=shape[1:]))
            (y, end), z = K._run(b, a, x, start), start
            for t in range(n):
                o = b[0] * x[t] + z[0]
                z = (b[1] * x[t] - a[1] * o + z[1], b[2] * x[t] - a[2] * o)
                assert np.allclose(y[t], o, rtol=0, atol=1e-10)
            assert np.allclose(end, z, rtol=0, atol=1e-10)


@pytest.mark.parametrize("step", [137, 1024, 20_000])
def test_filtered_blocks_are_the_filtered_channel(spark, signals, step):
    got = BS.filtered_blocks(signals, FS, step).orderBy(*BS.BLOCK).collect()
    for key, x in CHANNELS.items():
        mine = [np.asarray(r.x) for r in got if (r.animalday, r.channel) == key]
        if len(x) < BS.LEAST_SAMPLES:
            assert not mine
            continue
        want = K.notch_filter(K.band_filter(x, FS, 3.0, 40.0, order=4), FS)
        assert np.allclose(np.concatenate(mine), want, rtol=0, atol=1e-8) and max(map(len, mine)) < 2 * step + 1


@pytest.mark.parametrize("step", [137, 4096])
def test_the_same_spikes_at_any_block_size(spark, signals, step):
    found = 0
    for percentile, vote in ((98.0, 1), (99.5, 2)):
        got = {}
        for r in BS.detect(signals, FS, step, percentile=percentile, vote=vote).collect():
            got.setdefault((r.animalday, r.channel), []).append(r.sample_idx)
            assert r.t_s == r.sample_idx / FS
        for key, x in CHANNELS.items():
            want = K.detect_spikes(x, FS, percentile=percentile, vote=vote).tolist() if len(x) > 100 else []
            assert sorted(got.get(key, [])) == want, (key, percentile)
            found += len(want)
    assert found > 15


def test_exact_order_statistics(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=3000), np.repeat([0.25, -0.0, 0.0, 1e300, -1e300, 5e-324], 50)])
    other = rng.integers(-3, 3, 500).astype(float)
    rng.shuffle(values)
    rows = [("d", "a", [[float(v) for v in part], [1.0]]) for part in np.array_split(values, 7)] + [("d", "b", [[float(v) for v in other], [2.0, 3.0]])]
    blocks = spark.createDataFrame(rows, "animalday string, channel string, e array<array<double>>").repartition(3)
    ranks = [0, 1, 1500, 1501, len(values) - 1]
    wanted = spark.createDataFrame([("d", "a", [0] * 5 + [1], [*ranks, 6]), ("d", "b", [0, 1], [250, 1])], "animalday string, channel string, line array<int>, rank array<long>")
    got = {r.channel: r.value for r in BS.order_statistics(blocks, wanted).collect()}
    assert got["a"] == [*np.sort(values)[ranks], 1.0] and got["b"] == [np.sort(other)[250], 3.0]


def test_pieces_with_gaps_are_an_error_and_none_give_none(spark, signals):
    with pytest.raises(Exception, match="gaps"):
        BS.rechunk(signals.where("start > 0 or channel <> 'a'"), 500).collect()
    assert BS.detect(signals.limit(0), FS).count() == 0
    with pytest.raises(ValueError, match="101"):
        BS.detect(signals, FS, 50)


def test_query_against_whole_channels(spark):
    d = "/root/testdata/sf0.001"
    got = {(r.channel, r.sample_idx) for r in Q.q106_spikes_by_blocks(spark, d).collect()}
    want = set()
    whole = Q.spike_pieces(spark, d).groupBy("channel").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start", "signal"))), lambda x: x["signal"])).alias("x")).collect()
    for r in whole:
        want |= {(r.channel, int(i)) for i in K.detect_spikes(np.asarray(r.x), 512.0, percentile=99.0, vote=1)}
    assert got == want and want
