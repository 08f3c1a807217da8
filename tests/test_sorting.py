import numpy as np
import pytest
from pyspark.sql import functions as F

from voltaloom.functions import kernels as K
from voltaloom.operators import sorting as SO

FS, N = 1000.0, 6000


@pytest.fixture(scope="module")
def recorded():
    rng = np.random.default_rng(6)
    mix = rng.normal(size=(4, 4))
    return mix @ rng.normal(size=(4, N)) * 20 + np.sin(2 * np.pi * 60 * np.arange(N) / FS) * 50


@pytest.fixture(scope="module")
def signals(spark, recorded):
    rows = [("d", "abcd"[c], a, [float(v) for v in recorded[c, a : a + 700]]) for c in range(4) for a in range(0, N, 700)]
    return spark.createDataFrame(rows, "animalday string, channel string, start long, signal array<double>")


def whole(df):
    by = {}
    for r in df.orderBy("channel", "start").collect():
        by.setdefault(r.channel, []).append(np.asarray(r.x))
    return np.stack([np.concatenate(by[c]) for c in sorted(by)])


def test_reference_and_whitening(signals, recorded):
    got = whole(SO.prepare(signals, FS, 512, common_ref=False))
    assert np.allclose(got @ got.T / N, np.eye(4), atol=1e-3)
    values, vectors = np.linalg.eigh(recorded @ recorded.T / N)
    assert np.allclose(got, vectors / np.sqrt(values) @ vectors.T @ recorded, atol=1e-6)
    ref = whole(SO.prepare(signals, FS, 512, scale=3.0, whiten=False))
    assert np.allclose(ref, 3 * (recorded - np.median(recorded, axis=0)), atol=1e-9)


def test_filters_by_blocks_are_those_of_whole_channels(signals, recorded):
    for low, high in ((100.0, None), (100.0, 300.0), (None, 200.0)):
        got = whole(SO.prepare(signals, FS, 777, notch_hz=60.0, common_ref=False, whiten=False, freq_min=low, freq_max=high))
        want = K.zero_phase(*_swap(K.notch_sections(FS, 60.0, 100.0), recorded))
        want = K.zero_phase(*_swap(K.bessel_sections(5, FS, low or 0.1, high), want))
        assert np.abs(got - want).max() < (1e-6 if low else 1e-3)  # poles at 0.1 Hz lie within 1e-3 of the circle; a plain loop differs from the kernel by 1e-5


def _swap(filt, x):
    return filt[0], x, filt[1]


def response(sections, freqs):
    z = np.exp(-2j * np.pi * np.asarray(freqs) / FS)
    return np.abs(np.prod([(s[0] + s[1] * z + s[2] * z**2) / (s[3] + s[4] * z + s[5] * z**2) for s in sections], axis=0))


def test_bessel_responses():
    """Flat in the pass band, and as the analog prototype at the edges: |H| at 1 of the normalised fifth-order Bessel filter."""
    high, _ = K.bessel_sections(5, FS, 100.0)
    p = np.roots([1, 15, 105, 420, 945, 945]) / 945 ** (1 / 5)
    edge = abs(1 / np.prod(1j - p))
    assert np.allclose(response(high, [100.0]), edge, rtol=1e-6) and response(high, [499.9]) > 0.999 and response(high, [5.0]) < 1e-5
    band, _ = K.bessel_sections(5, FS, 50.0, 400.0)  # wide enough for real poles
    assert np.allclose(response(band, [50.0, 400.0]), edge, rtol=1e-6) and response(band, [0.01]) < 1e-9
    for odd in ((None, 50.0), (400.0, 600.0), (50.0, 20.0)):
        with pytest.raises(ValueError, match="pass band"):
            K.bessel_sections(5, FS, *odd)


def test_channels_of_other_lengths(signals):
    short = signals.where((F.col("channel") != "a") | (F.col("start") < 2000))
    with pytest.raises(Exception, match="differ in length"):
        SO.prepare(short, FS, 512).collect()
    assert SO.prepare(signals.limit(0), FS).count() == 0
