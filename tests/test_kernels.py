import numpy as np
import pytest

from voltaloom.functions import kernels as K
from voltaloom.functions import names as N
from voltaloom.operators.features import compute, requested

T = np.arange(4000) / 1000


def test_sine_has_its_rms_variance_and_peak():
    x = 3 * np.sin(2 * np.pi * 10 * T)[None, None]
    got = compute(x, 1000, ["rms", "ampvar", "psd", "psdfrac", "psdslope"])
    assert got["rms"][0, 0] == pytest.approx(3 / 2**0.5, rel=1e-3)
    assert got["ampvar"][0, 0] == pytest.approx(4.5, rel=1e-3)
    f, p = got["psd"]
    assert f[p[0, 0].argmax()] == 10
    assert sum(v[0, 0] for v in got["psdfrac"].values()) == pytest.approx(1)


def test_filters_pass_and_stop():
    at = lambda hz, y: np.abs(y(np.sin(2 * np.pi * hz * T)))[1000:3000].max()
    assert at(60, lambda x: K.notch_filter(x, 1000)) < 0.01
    assert at(10, lambda x: K.notch_filter(x, 1000)) == pytest.approx(1, abs=0.02)
    assert at(10, lambda x: K.band_filter(x, 1000, 1, 40)) == pytest.approx(1, abs=0.02)
    assert at(200, lambda x: K.band_filter(x, 1000, 1, 40)) < 0.05
    with pytest.raises(ValueError):
        K.notch_filter(np.zeros(9), 1000)


def test_identical_channels_are_coherent():
    rng = np.random.default_rng(0)
    a, b = rng.standard_normal((2, 4000))
    for band in K.coherency(np.stack([a, a, b]), 1000).values():
        assert abs(band[0, 1]) == pytest.approx(1, abs=1e-9)
        assert abs(band[0, 2]) < 0.95
        assert np.allclose(band, band.T)
    assert K.fisher_z(np.ones(1))[0] == pytest.approx(7.2543, abs=1e-3)


def test_planted_spikes_are_found():
    x = 0.1 * np.random.default_rng(1).standard_normal(10_000)
    for s in (2.0, 4.5, 7.2):
        x -= 2 * np.exp(-((np.arange(10_000) / 1000 - s) ** 2) / (2 * 0.01**2))
    assert np.abs(K.detect_spikes(x, 1000, percentile=99.0, vote=1) - np.array([2000, 4500, 7200])).max() < 20


def test_small_kernels():
    d = np.abs(np.subtract.outer(*[np.array([0, 1, 2, 3, 50.0])] * 2))
    assert K.local_outlier_factor(d, 2).argmax() == 4
    assert K.pearson_p(0.5, 20) == pytest.approx(0.0247, abs=1e-3)
    assert K.akima(np.arange(5.0), np.arange(5.0) ** 2, np.array([1.5]))[0] == pytest.approx(2.25)
    f, p = K.multitaper_psd(np.sin(2 * np.pi * 10 * T), 1000)
    assert abs(f[p.argmax()] - 10) <= 2
    assert len(requested("all")) == 20
    with pytest.raises(ValueError):
        requested(["nothing"])


def test_names():
    assert N.channel_abbreviation("left Aud") == "LAud" and N.channel_abbreviation("channel_9", from_number=True) == "LAud"
    with pytest.raises(ValueError):
        N.channel_abbreviation("nothing")
    assert N.file_index("/a/Cage 3 A10-7_ColMajor.bin") == 7
    assert N.session_of("/data/A10 KO 12_13_2023".replace("_", "-"))["animalday"] == "A10 KO Dec-13-2023"
    assert N.animal_id("WT_A5_x", (1, "_")) == "A5" and N.animal_id("WT A5", r"A\d") == "A5"
