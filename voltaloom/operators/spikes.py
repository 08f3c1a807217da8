"""Spikes: detection on whole recordings, clusters, votes and counts by window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltaloom.functions import kernels


def sneo(x: str, w) -> Column:
    return F.col(x) ** 2 - F.lead(x).over(w) * F.lag(x).over(w)


def consensus(df: DataFrame, keys: list[str], flags: list[str], k: int) -> DataFrame:
    """Rows where at least k of the flags hold."""
    votes = sum((F.coalesce(F.col(f), F.lit(False)).cast("int") for f in flags), F.lit(0))
    return df.withColumn("votes", votes).where(F.col("votes") >= k)


def clusters(df: DataFrame, keys: list[str], at: str, gap: float) -> DataFrame:
    """cluster: number of the run of rows no further apart than gap."""
    w = Window.partitionBy(*keys).orderBy(at)
    new = F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("int"), F.lit(0))
    return df.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def smooth(x: str, w, n: int) -> Column:
    return F.avg(x).over(w.rowsBetween(-(n // 2), n // 2))


def count_in_windows(windows: DataFrame, spikes: DataFrame, keys: list[str]) -> DataFrame:
    """nspike of each window [start, stop), 0 where there is none; windows and spikes (t) meet on their keys."""
    s = spikes.groupBy(*keys).agg(F.array_sort(F.collect_list("t")).alias("ts"))
    n = F.size(F.filter(F.coalesce("ts", F.array().cast("array<double>")), lambda t: (t >= F.col("start")) & (t < F.col("stop"))))
    return windows.join(s, keys, "left").withColumn("nspike", n.cast("long")).drop("ts")


def count_in_uniform_windows(spikes: DataFrame, keys: list[str], length: float) -> DataFrame:
    """The same for windows of one length, by arithmetic and a partial aggregate."""
    return spikes.groupBy(*keys, F.floor(F.col("t") / length).cast("long").alias("frag_idx")).agg(F.count("*").alias("nspike"))


def detect(signals: DataFrame, fs: float, **options) -> DataFrame:
    """Spikes (animalday, channel, sample_idx, t_s) of whole channels (animalday, channel, signal array); null or short signals have none."""

    def run(batches):
        for pdf in batches:
            out = []
            for day, channel, signal in zip(pdf.animalday, pdf.channel, pdf.signal, strict=True):
                if signal is not None and len(signal) > 100:
                    out += [(day, channel, int(i), i / fs) for i in kernels.detect_spikes(signal, fs, **options)]
            yield type(pdf)(out, columns=["animalday", "channel", "sample_idx", "t_s"]).astype({"sample_idx": "int64", "t_s": "float64"})

    return signals.select("animalday", "channel", "signal").mapInPandas(run, "animalday string, channel string, sample_idx long, t_s double")


def annotations(spikes: DataFrame, fs: float, channels: list[str]) -> DataFrame:
    """onset in seconds, counted from sample 1, and description of each spike: Spike_Ch and the channel's place in channels."""
    at = F.array_position(F.array(*(F.lit(c) for c in channels)), F.col("channel")) - 1
    return spikes.withColumn("onset", (F.col("sample_idx") + 1) / F.lit(float(fs))).withColumn("description", F.concat(F.lit("Spike_Ch"), at.cast("string")))


def channel_counts(spikes: DataFrame, channels: DataFrame) -> DataFrame:
    """nspike of every channel (animalday, channel), 0 where none was found, and the session's total."""
    n = spikes.groupBy("animalday", "channel").agg(F.count("*").alias("nspike"))
    every = channels.select("animalday", "channel").distinct().join(n, ["animalday", "channel"], "left").withColumn("nspike", F.coalesce("nspike", F.lit(0)).cast("long"))
    total = spikes.groupBy("animalday").agg(F.count("*").alias("total"))
    return every.join(total, "animalday", "left").withColumn("total", F.coalesce("total", F.lit(0)).cast("long"))


def truncate(spikes: DataFrame, max_length: int | None) -> DataFrame:
    """Spikes of the first max_length samples; all where it is None."""
    return spikes if max_length is None else spikes.where(F.col("sample_idx") < max_length)
