"""From recordings to windows: resampling by blocks, windows over a session's files, and one call from folders to features."""

from __future__ import annotations

from collections.abc import Callable
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltaloom.functions import kernels
from voltaloom.operators import features as FE
from voltaloom.operators import sessions as SE
from voltaloom.operators import windows as W
from voltaloom.sources import recordings as R

_BLOCK = ["session", "file_idx", "block", "channel"]


def _whole(rate: float, seconds: float) -> int:
    n = round(rate * seconds)
    if n < 1 or abs(rate * seconds - n) > 1e-6:
        raise ValueError(f"{seconds} s at {rate} Hz are no whole number of samples")
    return n


def resample_block(left: np.ndarray, x: np.ndarray, right: np.ndarray, step: int, out: int) -> np.ndarray:
    """x at out samples for each step of its own, by the Fourier method; left and right are samples beside it, which the edges need.

    As much of them counts as fits a whole number of samples in both rates; what they lack at a file's ends is mirrored.
    """
    unit = step // gcd(step, out)
    per, n = out // gcd(step, out), len(x)
    k = max(len(left), len(right)) // unit
    left, right = left[max(len(left) - k * unit, 0) :], right[: k * unit]
    total = -(-(2 * k * unit + n) // unit)
    y = np.concatenate([left, x, right])
    before = k * unit - len(left)
    y = np.pad(y, (before, total * unit - before - len(y)), "reflect")
    return kernels.resample(y, total * per)[k * per : k * per + (2 * n * out + step) // (2 * step)]


def resampled(signals: DataFrame, seconds: float, rate: float = 1000.0, margin_s: float = 1.0) -> DataFrame:
    """Blocks of `seconds` of each file at the new rate, in the form of sources.recordings.SIGNALS; each file is resampled for itself.

    A block gets margin_s of its neighbours, so its edges are no edges of the signal. Its rows are keyed by block: a long file is many tasks' work.
    Blocks must be a whole number of samples in both rates; a file's last block may be shorter.
    """
    out = _whole(rate, seconds)
    n, m = F.size("signal"), F.ceil(F.lit(margin_s) * F.col("f_s")).cast("int")
    nothing = F.lit(None).cast("array<float>")
    piece = lambda shift, l, x, r: F.struct((F.col("block") + shift).alias("block"), l.alias("l"), x.alias("x"), r.alias("r"))
    tail = F.slice("signal", F.greatest(n - m, F.lit(0)) + 1, m)
    parts = F.array(piece(0, nothing, F.col("signal"), nothing), piece(1, tail, nothing, nothing), piece(-1, nothing, nothing, F.slice("signal", F.lit(1), m)))
    pieces = signals.where(n > 0).select("session", "file_idx", "channel", "f_s", F.explode(parts).alias("p")).select("session", "file_idx", "channel", "f_s", "p.*")
    joined = pieces.groupBy(*_BLOCK).agg(F.first("f_s").alias("f_s"), *(F.first(c, ignorenulls=True).alias(c) for c in "lxr")).where("x is not null")

    def run(batches):
        floats = lambda v: np.empty(0) if v.values is None else v.values.to_numpy(zero_copy_only=False).astype(float)
        for batch in batches:
            values = []
            for f_s, left, x, right in zip(batch.column("f_s").to_pylist(), *(batch.column(c) for c in "lxr"), strict=True):
                values.append(resample_block(floats(left), floats(x), floats(right), _whole(f_s, seconds), out).astype(np.float32))
            blocks = batch.column("block").to_numpy()
            cols = [batch.column("session"), batch.column("file_idx"), batch.column("block"), pa.array(blocks * out, pa.int64()), pa.repeat(pa.scalar(float(rate)), len(blocks)), batch.column("channel")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(values, pa.list_(pa.float32()))], ["session", "file_idx", "block", "start", "f_s", "channel", "signal"])

    return joined.mapInArrow(run, R.SIGNALS)


def resampled_files(files: DataFrame, seconds: float, rate: float = 1000.0) -> DataFrame:
    """samples and f_s of files after `resampled`, by arithmetic."""
    out, step = _whole(rate, seconds), F.round(F.col("f_s") * seconds).cast("long")
    last = F.expr("samples") % step
    samples = F.floor(F.col("samples") / step) * out + F.floor((2 * last * out + step) / (2 * step))
    return files.withColumn("samples", samples.cast("long")).withColumn("f_s", F.lit(float(rate)))


def signal_files(signals: DataFrame) -> DataFrame:
    """samples, f_s and channels of each file, counted in the signals themselves: for formats that do not tell them otherwise."""
    ends = F.max(F.col("start") + F.size("signal")).cast("long").alias("samples")
    return signals.groupBy("session", "file_idx").agg(ends, F.min("f_s").alias("f_s"), F.array_sort(F.collect_set("channel")).alias("channels"))


def window_plan(files: DataFrame, length_s: float, drop_last: bool = False, key: str = "session") -> DataFrame:
    """frag_idx, start_s, stop_s and duration of every window of a session, from its files' samples alone; the last one may be short.

    drop_last leaves the last window out, unless it is the only one. A session without samples has no window.
    """
    total = files.groupBy(key).agg(F.sum("samples").alias("n"), F.min("f_s").alias("f_s")).where("n > 0")
    length = F.round(F.col("f_s") * length_s).cast("long")
    last = F.floor((F.col("n") - 1) / length).cast("long")
    kept = F.greatest(last - 1, F.lit(0)) if drop_last else last
    each = total.withColumn("frag_idx", F.explode(F.sequence(F.lit(0).cast("long"), kept)))
    stop = F.least((F.col("frag_idx") + 1) * length, F.col("n")) / F.col("f_s")
    return each.select(key, "frag_idx", (F.col("frag_idx") * length / F.col("f_s")).alias("start_s"), stop.alias("stop_s")).withColumn("duration", F.col("stop_s") - F.col("start_s"))


def window_signals(signals: DataFrame, files: DataFrame, length_s: float, key: str = "session", order: tuple[str, ...] = ("file_idx",)) -> DataFrame:
    """(key, frag_idx, f_s, channels, signal array of channels) of tumbling windows over each session's files joined end to end.

    Windows run on over the ends of files. files: session, file_idx, samples, f_s, channels and what order and key need; files of a session that differ in rate
    or channels are an error. One shuffle, by window: only the parts of a block that a window needs are sent to it.
    """
    placed = SE.merge_recordings(files, key, list(order), "samples", ["f_s", "channels"])
    s = signals.where(F.size("signal") > 0).select("session", "file_idx", "start", "channel", "signal").join(placed.select(*dict.fromkeys([key, "session", "file_idx", "offset", "f_s", "channels"])), ["session", "file_idx"])
    length, at, n = F.round(F.col("f_s") * length_s).cast("long"), F.col("offset") + F.col("start"), F.size("signal")
    s = s.withColumn("at", at).withColumn("frag_idx", F.explode(F.sequence(F.floor(at / length).cast("long"), F.floor((at + n - 1) / length).cast("long"))))
    lo = F.greatest(F.col("frag_idx") * length - F.col("at"), F.lit(0))
    hi = F.least((F.col("frag_idx") + 1) * length - F.col("at"), n)
    part = F.struct((F.col("at") + lo).alias("at"), "channel", F.slice("signal", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("x"))
    w = s.groupBy(key, "frag_idx").agg(F.first("f_s").alias("f_s"), F.first("channels").alias("channels"), F.array_sort(F.collect_list(part)).alias("parts"))
    signal = F.transform("channels", lambda c: F.flatten(F.transform(F.filter("parts", lambda p: p["channel"] == c), lambda p: p["x"])))
    return w.select(key, "frag_idx", "f_s", "channels", signal.cast("array<array<double>>").alias("signal"))


def analyse(
    spark: SparkSession, folder: str, features: str | list[str] = "all", exclude: list[str] = (), mode: str = "bin", length_s: float = 4.0, rate: float | None = 1000.0,
    drop_last: bool = False, truncate: int | bool = False, label: Callable[[str], str] | None = None, **options,
) -> tuple[DataFrame, DataFrame]:
    """(windows, features) of all sessions below a folder of binary recordings.

    windows: animalday, frag_idx, start_s, stop_s, duration, timestamp, is_day, endfile; features: the long rows of features.long_features, whose keys are the
    same. label names a session by its folder (the folder itself where it is None); folders of one name are joined in order of their median file time.
    Files are resampled to `rate` (None: left alone, and files of a session must agree). A session without samples has no rows.
    """
    listed = R.truncated(R.list_files(spark, folder), truncate)
    meta = R.read_metadata(spark, listed)
    R.check_consistent(meta)
    raw = {"bin": R.read_column_major, "row": R.read_row_major}[mode](listed, meta, length_s)
    known = R.file_durations(listed, meta) if mode == "bin" else signal_files(raw).drop("f_s", "channels").join(meta, ["session", "file_idx"])
    known = known.select("session", "file_idx", "samples", "f_s", "channels", "ended")
    signals = raw
    if rate is not None:
        signals, known = resampled(raw, length_s, rate), resampled_files(known, length_s, rate)
    folders = [r.session for r in known.select("session").distinct().collect()]  # a row for each folder
    named = spark.createDataFrame([(f, label(f) if label else f) for f in folders], "session string, animalday string")
    median = W.session_order(known.where("ended is not null"), "session", "ended")
    files = known.join(named, "session").join(median, "session", "left")
    order = ("median_s", "session", "file_idx")
    plan = window_plan(files, length_s, drop_last, "animalday")
    ends = files.withColumn("_s", F.col("samples") / F.col("f_s"))
    ends = W.running(ends, ["animalday"], list(order), "_s", "cum").select("animalday", "cum", F.col("ended").alias("end_ts"))
    at = W.asof_timestamps(plan.withColumn("t", F.col("start_s")), ends, "animalday").drop("t").withColumn("is_day", W.is_day(F.col("timestamp")))
    windows = W.end_in_window(at.withColumnsRenamed({"start_s": "start", "stop_s": "stop"}), ends, "animalday").withColumnsRenamed({"start": "start_s", "stop": "stop_s"})
    cut = window_signals(signals, files, length_s, "animalday", order).join(plan.select("animalday", "frag_idx"), ["animalday", "frag_idx"])
    return windows, FE.long_features(cut, None, features, exclude, length_s=length_s, **options)


def with_metadata(windows: DataFrame, long: DataFrame, key: str = "animalday") -> DataFrame:
    """Each feature row with its window's columns, by key; windows without features stay, with nulls."""
    return windows.join(long, [key, "frag_idx"], "left")
