"""Features of windows: a dependency resolver and one Arrow pass that computes a window's requested features together."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from voltaloom import constants as C
from voltaloom.functions import kernels as K

#: What each feature is computed from.
NEEDS = {
    "logrms": ["rms"], "logampvar": ["ampvar"], "psdband": ["psd"], "psdtotal": ["psd"], "psdslope": ["psd"], "psdfrac": ["psdband"],
    "logpsdband": ["psdband"], "logpsdtotal": ["psdtotal"], "logpsdfrac": ["psdfrac"], "cohere": ["coherency"], "imcoh": ["coherency"],
    "zcohere": ["cohere"], "zimcoh": ["imcoh"], "zpcorr": ["pcorr"], "lognspike": ["nspike"],
}


def requested(features: str | list[str] = "all", exclude: list[str] = ()) -> list[str]:
    names = list(C.FEATURES) if features in ("all", ["all"]) else [features] if isinstance(features, str) else list(features)
    names = [f for f in names if f not in exclude]
    if not names or set(names) - set(C.FEATURES):
        raise ValueError(f"no or unknown features: {names}")
    return names


def compute(x: np.ndarray, fs: float, names: list[str], notch: bool = True, welch_s: float = 1.0, multitaper: bool = False, full: int | None = None, coherency: str = "multitaper") -> dict[str, np.ndarray]:
    """Features of windows (B, C, N) of one length, each prerequisite computed once.

    multitaper: densities by tapers in place of Welch's segments. full: samples of a whole window; densities of windows of another length are brought to its
    frequencies by Akima's spline, and are NaN where fewer than three frequencies are there. coherency: by tapers or by morlet wavelets.
    """
    if coherency not in ("multitaper", "morlet"):
        raise ValueError(f"unknown coherency {coherency!r}")
    done: dict[str, object] = {}

    def get(f: str):
        if f not in done:
            done[f] = make(f)
        return done[f]

    def psd():
        y = K.notch_filter(x, fs) if notch and fs > 2 * C.LINE_HZ and x.shape[-1] > 9 else x
        segment = int(round(welch_s * fs))
        f, p = K.multitaper_psd(y, fs) if multitaper else K.welch(y, fs, segment)
        if full is None or full == x.shape[-1]:
            return f, p
        grid = np.fft.rfftfreq(full if multitaper else min(segment, full), 1 / fs)
        grid = grid[grid <= 40] if multitaper else grid
        return grid, K.akima(f, p, grid) if len(f) > 2 else np.full((*p.shape[:-1], len(grid)), np.nan)

    def make(f: str):
        if f.startswith("log"):
            v = get(f[3:])
            return {b: np.log1p(a) for b, a in v.items()} if isinstance(v, dict) else np.log1p(v)
        if f in ("zcohere", "zimcoh"):
            return {b: K.fisher_z(a) for b, a in get("cohere" if f == "zcohere" else "imcoh").items()}
        if f in ("cohere", "imcoh"):
            return {b: np.abs(a) if f == "cohere" else a.imag for b, a in get("coherency").items()}
        return {
            "rms": lambda: np.sqrt((x**2).mean(-1)),
            "ampvar": lambda: x.var(-1),
            "psd": psd,
            "psdband": lambda: {b: K.trapezoid_band(*get("psd"), *r) for b, r in C.BANDS.items()},
            "psdtotal": lambda: K.trapezoid_band(*get("psd"), *C.TOTAL_BAND),
            "psdfrac": lambda: (lambda p: {b: np.divide(v, s, out=np.full_like(v, np.nan), where=s > 0) for s in [sum(p.values())] for b, v in p.items()})(get("psdband")),
            "psdslope": lambda: K.log_slope(*get("psd"), *C.TOTAL_BAND)[0],
            "coherency": lambda: (K.coherency if coherency == "multitaper" else K.wavelet_coherency)(x, fs),
            "pcorr": lambda: K.correlation(K.band_filter(x, fs, *C.TOTAL_BAND)),
            "zpcorr": lambda: K.fisher_z(get("pcorr")),
            "nspike": lambda: np.full(x.shape[:-1], np.nan),
        }[f]()

    return {f: get(f) for f in names}


LONG = "animalday string, frag_idx long, feature string, band string, channel int, channel2 int, freq double, value double"


def _long(days: list, frags: list, feature: str, v) -> list[pa.RecordBatch]:
    """Rows of LONG of a feature's array, whose axes are window, channel and, for some, second channel or frequency."""
    freq, parts = (v[0], {None: v[1]}) if isinstance(v, tuple) else (None, v if isinstance(v, dict) else {None: v})
    out = []
    for band, a in parts.items():
        value = np.asarray(a, float).reshape(-1)
        at = np.indices(np.shape(a), np.int32).reshape(np.ndim(a), -1)
        n, window, third = len(value), pa.array(at[0]), at[2] if len(at) > 2 else None
        out.append(pa.RecordBatch.from_arrays([
            pa.array(days, pa.string()).take(window), pa.array(frags, pa.int64()).take(window), pa.repeat(pa.scalar(feature), n), pa.repeat(pa.scalar(band, pa.string()), n), pa.array(at[1]),
            pa.array(third) if third is not None and freq is None else pa.nulls(n, pa.int32()), pa.array(freq[third], pa.float64()) if freq is not None else pa.nulls(n, pa.float64()),
            pa.array(value, mask=~np.isfinite(value)),
        ], [c.split()[0] for c in LONG.split(", ")]))
    return out


def _channels(signal: pa.ListScalar) -> np.ndarray:
    """Channels by samples, NaN for null samples; channels of several lengths are a ValueError."""
    n = len(signal.values)
    return signal.values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)


def long_features(fragments: DataFrame, fs: float | None, features: str | list[str] = "all", exclude: list[str] = (), length_s: float | None = None, **options) -> DataFrame:
    """Long rows of the features of fragments (animalday, frag_idx, signal array<array<double>>, channel-major); where fs is None, a column f_s tells the rate.

    Windows of equal shape are computed together; what is not finite is NULL; null signals give no rows. Spike counts are filled by count_in_windows.
    length_s: seconds of a whole window, to whose frequencies the densities of shorter ones are brought.
    """
    names = [f for f in requested(features, exclude) if "nspike" not in f]

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 64):  # windows are large; what is held at once stays small
                batch, shapes = whole.slice(lo, 64), {}
                rates = [fs] * batch.num_rows if fs is not None else batch.column("f_s").to_pylist()
                for day, frag, rate, signal in zip(batch.column("animalday").to_pylist(), batch.column("frag_idx").to_pylist(), rates, batch.column("signal"), strict=True):
                    if signal.is_valid and len(signal.values):
                        x = _channels(signal)
                        shapes.setdefault((rate, x.shape), []).append((day, frag, x))
                for (rate, _), got in shapes.items():
                    days, frags, xs = zip(*got, strict=True)
                    full = {"full": round(length_s * rate)} if length_s else {}
                    for f, v in compute(np.stack(xs), rate, names, **full, **options).items():
                        yield from _long(days, frags, f, v)

    return fragments.select("animalday", "frag_idx", *(["f_s"] if fs is None else []), "signal").mapInArrow(run, LONG)
