"""Detected spikes on disk: the spikes, the channels that were looked at, and the parameters of the detection."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltaloom.operators import spikes as S


def save_spikes(spikes: DataFrame, channels: DataFrame, folder: str, params: dict, overwrite: bool = False) -> None:
    """Write spikes (animalday, channel, sample_idx, t_s, ...), channels (animalday, channel, f_s, samples) and params below folder; files beside them stay.

    The parameters are written last and read first: a folder without them holds no result. A spike outside its channel's samples, or of a channel that is not listed, is an error.
    """
    mode = "overwrite" if overwrite else "error"
    known = channels.select("animalday", "channel", "f_s", "samples")
    inside = F.col("samples").isNotNull() & (F.col("sample_idx") >= 0) & (F.col("sample_idx") < F.col("samples"))
    checked = spikes.join(known.select("animalday", "channel", "samples"), ["animalday", "channel"], "left")
    checked = checked.withColumn("sample_idx", F.when(inside, F.col("sample_idx")).otherwise(F.raise_error(F.lit("a spike lies outside its channel")).cast("long"))).drop("samples")
    known.write.mode(mode).parquet(f"{folder}/channels")
    # In ranges of sessions, not a folder a session: files stay few however many sessions there are, and their statistics still tell a reader which ones hold a session.
    checked.repartitionByRange("animalday", "channel").sortWithinPartitions("animalday", "channel", "sample_idx").write.mode(mode).parquet(f"{folder}/spikes")
    spikes.sparkSession.createDataFrame([(json.dumps(params, sort_keys=True),)], "value string").coalesce(1).write.mode(mode).text(f"{folder}/_params")


def load_spikes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, dict]:
    """(spikes, channels, params) as save_spikes wrote them."""
    lines = spark.read.text(f"{folder}/_params").limit(2).collect()
    if len(lines) != 1:
        raise ValueError(f"{folder}: {len(lines)} lines of parameters")
    channels = spark.read.parquet(f"{folder}/channels")
    return spark.read.schema("sample_idx long, t_s double, animalday string, channel string").parquet(f"{folder}/spikes"), channels, json.loads(lines[0].value)


def counts(spikes: DataFrame, channels: DataFrame) -> DataFrame:
    """animalday, channel, nspike, total, rate: spikes of every channel that was looked at, zeros included, and per second of its samples."""
    n = S.channel_counts(spikes, channels)
    return n.join(channels.select("animalday", "channel", (F.col("samples") / F.col("f_s")).alias("_s")), ["animalday", "channel"]).withColumn("rate", F.try_divide(F.col("nspike"), F.col("_s"))).drop("_s")


def from_annotations(annotations: DataFrame, fs: float, channels: list[str], name: str = "Spike_Ch") -> DataFrame:
    """Spikes from annotations (animalday, onset, description): others than name and a channel's place are left out; a place beyond channels is an error."""
    place = F.regexp_extract("description", f"^{name}([0-9]+)$", 1)
    known = annotations.where(place != "").withColumn("_k", place.cast("int"))
    names = F.array(*(F.lit(c) for c in channels))
    channel = F.when(F.col("_k") < len(channels), F.get(names, F.col("_k"))).otherwise(F.raise_error(F.lit("an annotation names a channel that is not there")))
    at = F.round(F.col("onset") * fs).cast("long") - 1
    return known.select("animalday", channel.alias("channel"), at.alias("sample_idx"), (at / F.lit(float(fs))).alias("t_s"))
