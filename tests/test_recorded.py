from __future__ import annotations

import numpy as np
import pytest
from test_sources import _write

from voltaloom.functions import kernels as K
from voltaloom.operators import features as FE
from voltaloom.operators import recorded as RE
from voltaloom.sources import recordings as R


def _sine(t):
    return np.sin(2 * np.pi * 7 * t) + 0.5 * np.cos(2 * np.pi * 3 * t)


@pytest.mark.parametrize(("fs", "rate"), [(100, 40), (100, 250), (99, 100), (100, 100)])
def test_resample_block_follows_the_signal(fs, rate):
    t = np.arange(5 * fs) / fs
    y = _sine(t)
    got = RE.resample_block(y[fs : 2 * fs], y[2 * fs : 3 * fs], y[3 * fs : 4 * fs], fs, rate)
    assert len(got) == rate
    np.testing.assert_allclose(got, _sine(2 + np.arange(rate) / rate), atol=0.02)
    alone = RE.resample_block(np.empty(0), y[:1], np.empty(0), fs, rate)
    assert len(alone) == (2 * rate + fs) // (2 * fs)


def test_windows_run_over_file_ends(spark, tmp_path):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(250, 3)), rng.normal(size=(130, 3))
    _write(tmp_path / "s", "A1-0", a, units="uV")
    _write(tmp_path / "s", "A1-1", b, units="uV")
    for mode in ("bin", "row"):
        windows, long = RE.analyse(spark, str(tmp_path), ["rms", "pcorr"], mode=mode, length_s=1.0, rate=None, label=lambda p: "A1")
        w = windows.orderBy("frag_idx").collect()
        assert [(r.animalday, r.frag_idx, r.start_s, round(r.duration, 6)) for r in w] == [("A1", 0, 0.0, 1.0), ("A1", 1, 1.0, 1.0), ("A1", 2, 2.0, 1.0), ("A1", 3, 3.0, 0.8)]
        assert [r.endfile for r in w] == [None, None, 0.5, None]
        whole = np.concatenate([a, b]).astype("f4").astype(float)
        got = {(r.frag_idx, r.channel): r.value for r in long.where("feature = 'rms'").collect()}
        assert len(got) == 12
        for (frag, channel), value in got.items():
            assert value == pytest.approx(np.sqrt((whole[100 * frag : 100 * frag + 100, channel] ** 2).mean()), rel=1e-5)
        assert long.where("feature = 'pcorr'").count() == 4 * 9
        assert RE.with_metadata(windows, long).where("duration is null").count() == 0
    assert RE.analyse(spark, str(tmp_path), "rms", length_s=1.0, rate=None, drop_last=True)[1].select("frag_idx").distinct().count() == 3


def test_resampled_recording(spark, tmp_path):
    t = np.arange(1030) / 100
    x = np.stack([_sine(t), 2 * _sine(t), 0 * t], 1)
    _write(tmp_path / "s", "A1-0", x, units="uV")
    files = R.list_files(spark, str(tmp_path))
    meta = R.read_metadata(spark, files)
    known = R.file_durations(files, meta)
    signals = R.read_column_major(files, meta, 2.0)
    for rate in (50, 250):
        got = RE.resampled(signals, 2.0, rate).where("channel = 'RMot'").orderBy("block").collect()
        y = np.concatenate([r.signal for r in got])
        n = RE.resampled_files(known, 2.0, rate).first()
        assert len(y) == n.samples == round(10.3 * rate) and n.f_s == rate
        assert [r.start for r in got] == [2 * rate * k for k in range(6)]
        inner = slice(rate, -rate)
        np.testing.assert_allclose(y[inner], 2 * _sine(np.arange(len(y)) / rate)[inner], atol=0.05)
    seen = RE.signal_files(signals).first()
    assert (seen.samples, seen.f_s) == (1030, 100.0)
    windows, long = RE.analyse(spark, str(tmp_path), ["rms", "psdtotal", "psd"], length_s=2.0, rate=250.0)
    assert windows.count() == 6
    shorts = long.where("feature = 'psd'").groupBy("frag_idx").count().collect()
    assert len({r["count"] for r in shorts}) == 1  # the short last window is brought to the frequencies of the others
    with pytest.raises(ValueError, match="whole number"):
        RE.resampled(signals, 2.0, 0.3)


def test_sessions_joined_by_name_and_differing_files(spark, tmp_path):
    rng = np.random.default_rng(4)
    for folder in ("one", "two"):
        _write(tmp_path / folder, "A1-0", rng.normal(size=(150, 3)))
    windows, _ = RE.analyse(spark, str(tmp_path), "rms", length_s=1.0, rate=None, label=lambda p: "A1")
    assert [r.duration for r in windows.orderBy("frag_idx").collect()] == [1.0, 1.0, 1.0]
    files = spark.createDataFrame([("s", 0, 10, 10.0, ["a"]), ("s", 1, 10, 20.0, ["a"])], "session string, file_idx int, samples long, f_s double, channels array<string>")
    signals = spark.createDataFrame([("s", i, 0, 0, 10.0, "a", [1.0] * 10) for i in (0, 1)], R.SIGNALS)
    with pytest.raises(Exception, match="differ"):
        RE.window_signals(signals, files, 1.0).collect()
    assert RE.window_plan(files.where("samples < 0"), 1.0).count() == 0


def test_multitaper_option_and_grid():
    x = np.random.default_rng(5).normal(size=(2, 3, 500))
    f, p = FE.compute(x, 250.0, ["psd"], multitaper=True)["psd"]
    np.testing.assert_allclose(p, K.multitaper_psd(K.notch_filter(x, 250.0), 250.0)[1])
    g, q = FE.compute(x[..., :200], 250.0, ["psd"], multitaper=True, full=500)["psd"]
    assert q.shape == p.shape and np.array_equal(f, g)
    g, q = FE.compute(x[..., :3], 250.0, ["psd"], notch=False, full=500)["psd"]
    assert np.isnan(q).all() and q.shape[-1] == len(g) == 126
