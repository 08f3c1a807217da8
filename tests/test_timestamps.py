from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltaloom.functions import kernels as K
from voltaloom.operators import features as FE
from voltaloom.operators import sessions as SE
from voltaloom.sources.timestamps import timestamp_table

T = datetime(2024, 1, 1)
HOUR = timedelta(hours=1)
FOLDERS = ["/d/a", "/d/b", "/e/c"]


def table(spark, stated, folders=FOLDERS, **more):
    return sorted((r.session, -1 if r.position is None else r.position, r.ts) for r in timestamp_table(spark, stated, folders, **more).collect())


def test_every_form(spark):
    assert table(spark, T, seconds={"/d/a": 60.0, "/d/b": 30.0, "/e/c": 1.0}) == [("/d/a", -1, T), ("/d/b", -1, T + timedelta(minutes=1)), ("/e/c", -1, T + timedelta(seconds=90))]
    assert table(spark, [T, T + HOUR], ["/d/a"]) == [("/d/a", 0, T), ("/d/a", 1, T + HOUR)]
    assert table(spark, {"a": T, "c": [T]}) == [("/d/a", -1, T), ("/e/c", 0, T)]
    nested = lambda folder: (lambda f: [T, T + HOUR] if f.endswith("b") else T)
    assert table(spark, nested) == [("/d/a", -1, T), ("/d/b", 0, T), ("/d/b", 1, T + HOUR), ("/e/c", -1, T)]
    assert table(spark, {"b": nested}) == [("/d/b", 0, T), ("/d/b", 1, T + HOUR)]
    assert table(spark, [], ["/d/a"]) == [] and table(spark, T, []) == []


def test_every_error(spark):
    def fails(folder):
        raise KeyError("inside")

    forever = lambda folder: forever
    for stated, kind, said in ((fails, ValueError, "inside"), ({"x": T}, ValueError, "names 0"), ([T, "noon"], TypeError, "str"), (5, TypeError, "int"), (lambda f: None, TypeError, "NoneType"), (forever, TypeError, "without end"), (T, ValueError, "length is not known")):
        with pytest.raises(kind, match=said):
            timestamp_table(spark, stated, FOLDERS)
    with pytest.raises(ValueError, match="names 2"):
        timestamp_table(spark, {"a": T}, ["/d/a", "/e/a"])


def test_lists_feed_the_files(spark):
    files = spark.createDataFrame([("/d/a", i) for i in range(3)], "session string, file_idx int")
    given = timestamp_table(spark, lambda f: [T + i * HOUR for i in range(3)], ["/d/a"])
    assert [r.end_ts for r in SE.listed_timestamps(files, "session", "file_idx", given).orderBy("file_idx").collect()] == [T, T + HOUR, T + 2 * HOUR]
    with pytest.raises(Exception, match="differ in length"):
        SE.listed_timestamps(files.where(F.col("file_idx") < 2), "session", "file_idx", given).collect()


def test_wavelet_coherency():
    fs, n, rng = 250.0, 2500, np.random.default_rng(0)
    t = np.arange(n) / fs
    a = np.sin(2 * np.pi * 10 * t) + 0.3 * rng.normal(size=n)
    late = np.interp(t - 0.02, t, a)
    other = rng.normal(size=n)
    c = K.wavelet_coherency(np.stack([a, a, late, other])[None], fs, q=1)
    assert set(c) == {"delta", "theta", "alpha", "beta", "gamma"}
    alpha = c["alpha"][0]
    assert np.allclose(alpha[1, 0], 1) and np.allclose(np.diag(alpha), 1) and np.allclose(alpha, alpha.T)
    assert abs(alpha[2, 0]) > 0.9 and abs(alpha[3, 0]) < 0.6
    lag = np.angle(K.wavelet_coherency(np.stack([a, late])[None], fs, {"ten": (9.5, 10.5)}, q=1)["ten"][0][1, 0])
    assert abs(lag + 2 * np.pi * 10 * 0.02) < 0.1  # 20 ms later is that much phase behind
    w = K.morlet(fs, 10.0, 7.0)
    assert abs(np.linalg.norm(w) - 2**0.5) < 1e-12 and abs(w.sum()) < 1e-3 and len(w) % 2 == 1
    f = K.wavelet_frequencies(1, 40, 1)
    assert len(f) == 39 and len(K.wavelet_frequencies(1, 40, 1, True)) == 39 and K.wavelet_cycles(n, fs, f).max() == 7.0
    assert all(len(K.morlet(fs, x, y)) <= n + 2 for x, y in zip(f, K.wavelet_cycles(n, fs, f), strict=True) if y > 0)


def test_choice_of_coherency():
    x = np.random.default_rng(1).normal(size=(2, 3, 1024))
    by_tapers, by_wavelets = (FE.compute(x, 256.0, ["cohere", "zcohere", "imcoh"], coherency=m) for m in ("multitaper", "morlet"))
    for got in (by_tapers, by_wavelets):
        assert got["cohere"]["alpha"].shape == (2, 3, 3) and np.allclose(got["cohere"]["alpha"][:, 0, 0], 1)
    assert not np.allclose(by_tapers["cohere"]["alpha"], by_wavelets["cohere"]["alpha"])
    with pytest.raises(ValueError, match="unknown coherency"):
        FE.compute(x, 256.0, ["cohere"], coherency="fourier")
