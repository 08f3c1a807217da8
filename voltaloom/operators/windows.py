"""Windows of recordings, their times, and the timelines of files and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_day(ts: Column) -> Column:
    """From 6:00 up to 18:00."""
    return F.hour(ts).between(6, 17)


def fragment_index(sample: Column, length: int) -> Column:
    """Number of the tumbling window of `length` samples."""
    return F.floor(sample / F.lit(length)).cast("long")


def zeitgeber_minutes(ts: Column) -> Column:
    """Minute of the day of the nearest full hour, halves to the even hour."""
    return (60 * F.pmod(F.bround((F.hour(ts) * 60 + F.minute(ts)) / F.lit(60.0)).cast("long"), F.lit(24))).cast("long")


def zeitgeber_two_days(df: DataFrame, minutes: str = "total_minutes") -> DataFrame:
    """Minutes counted from 6:00, and the same rows a day later."""
    first = df.withColumn(minutes, F.pmod(F.col(minutes) - 360, F.lit(1440)))
    return first.unionByName(first.withColumn(minutes, F.col(minutes) + 1440))


def running(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, before: bool = False) -> DataFrame:
    """Running sum of value; before: without the row itself, 0 on the first."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    return df.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0.0)))


def asof_timestamps(fragments: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Timestamp of each fragment (key, frag, t seconds) from its session's files (key, cum, end_ts): the first file with cum >= t, else the last.

    Both sides meet on the session's key; a session has few files, so the range is checked among them only.
    """
    f = files.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("cum", "end_ts"))).alias("fs"))
    hit = F.coalesce(F.get(F.filter("fs", lambda x: x["cum"] >= F.col("t")), F.lit(0)), F.element_at("fs", -1))
    out = fragments.join(f, key).withColumn("hit", hit)
    micros = F.unix_micros(F.col("hit.end_ts").cast("timestamp")) + F.round((F.col("t") - F.col("hit.cum")) * 1e6).cast("long")
    return out.withColumn("timestamp", F.timestamp_micros(micros).cast("timestamp_ntz")).drop("fs", "hit")


def end_in_window(fragments: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """endfile: the first file end in [start, stop) as seconds after start, else null."""
    f = files.groupBy(key).agg(F.array_sort(F.collect_list("cum")).alias("cums"))
    inside = F.get(F.filter("cums", lambda c: (c >= F.col("start")) & (c < F.col("stop"))), F.lit(0))
    return fragments.join(f, key, "left").withColumn("endfile", inside - F.col("start")).drop("cums")


def gaps(df: DataFrame, key: list[str], ts: str, order: list[str], limit_s: float) -> DataFrame:
    """gap_s to the row before, and whether it is longer than limit_s or the row out of order."""
    w = Window.partitionBy(*key).orderBy(*order)
    gap = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))) / 1e6
    return df.withColumn("gap_s", gap).withColumn("is_gap", F.coalesce((F.col("gap_s") > limit_s) | (F.col("gap_s") < 0), F.lit(False)))


def session_order(files: DataFrame, session: str, ts: str) -> DataFrame:
    """Sessions by the median of their files' times."""
    return files.groupBy(session).agg(F.percentile(F.unix_micros(F.col(ts).cast("timestamp")) / 1e6, F.lit(0.5)).alias("median_s"))


def spread_seconds(session: str, order: str, duration: str, from_start: bool = True) -> Column:
    """Seconds from a session's start (or, below zero, to its end) to each file's end, by the running sum of durations."""
    cum, total = F.sum(duration).over(Window.partitionBy(session).orderBy(order)), F.sum(duration).over(Window.partitionBy(session))
    return cum if from_start else cum - total


def shifted(anchor: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(anchor.cast("timestamp")) + F.round(seconds * 1e6).cast("long")).cast("timestamp_ntz")


def manual_timestamps(files: DataFrame, session: str, order: str, duration: str, anchor: Column, from_start: bool = True) -> DataFrame:
    """File ends spread from one start (or back from one end) by the running sum of durations.

    Where the anchor comes by a join on the session, spread_seconds before the join and shifted after it sort the files once and not twice.
    """
    return files.withColumn("end_ts", shifted(anchor, spread_seconds(session, order, duration, from_start)))


def time_of_day_map(df: DataFrame, ts: str, value: str, keys: list[str]) -> DataFrame:
    """Mean of value by day and minute of the day."""
    return df.groupBy(*keys, F.to_date(ts).alias("day"), (F.hour(ts) * 60 + F.minute(ts)).cast("long").alias("minute")).agg(F.avg(value).alias("mean"))


def timeline(files: DataFrame, session: str, start: str, end: str, duration: str) -> DataFrame:
    return files.groupBy(session).agg(F.min(start).alias("first_ts"), F.max(end).alias("last_ts"), F.sum(duration).alias("seconds"), F.count("*").alias("n_files"))
