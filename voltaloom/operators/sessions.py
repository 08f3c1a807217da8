"""Sessions and their recordings: times, timelines, merging, projections and checks of window tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def window_bounds(df: DataFrame, length_s: float, index: str = "frag_idx") -> DataFrame:
    """start_s and stop_s of each window from its number."""
    return df.withColumn("start_s", F.col(index) * F.lit(float(length_s))).withColumn("stop_s", (F.col(index) + 1) * F.lit(float(length_s)))


def number_windows(df: DataFrame, keys: list[str], order: list[str], drop_last: bool = False) -> DataFrame:
    """frag_idx from 0 in each recording; drop_last leaves out its last window, which may be short."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("frag_idx", (F.row_number().over(w) - 1).cast("long"))
    if not drop_last:
        return out
    return out.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where("frag_idx < _n - 1").drop("_n")


def finalise_timestamps(files: DataFrame, manual: str = "manual_ts", given: str = "csv_ts") -> DataFrame:
    """timestamp: the manual one, else the recorded one; a file with neither is an error."""
    return files.withColumn("timestamp", F.coalesce(manual, given, F.raise_error(F.lit("a file has no timestamp"))))


def listed_timestamps(files: DataFrame, session: str, order: str, given: DataFrame, ends: bool = True, duration: str = "duration") -> DataFrame:
    """end_ts of each file from the list of its session (session, position from 0, ts); starts move by the file's duration.

    Every session's list must be as long as its files: a file without an entry is an error, and so is an entry without a file.
    """
    w = Window.partitionBy(session).orderBy(order)
    placed = files.withColumn("position", (F.row_number().over(w) - 1).cast("long"))
    both = placed.withColumn("_file", F.lit(True)).join(given.select(session, "position", F.col("ts").alias("_ts")), [session, "position"], "full")
    fits = F.col("_file").isNotNull() & F.col("_ts").isNotNull()
    ts = F.when(fits, F.col("_ts")).otherwise(F.raise_error(F.lit("a list of timestamps and its files differ in length")))
    if not ends:
        ts = F.timestamp_micros(F.unix_micros(ts.cast("timestamp")) + F.round(F.col(duration) * 1e6).cast("long")).cast("timestamp_ntz")
    return both.withColumn("end_ts", ts).drop("_file", "_ts")


def short_intervals(df: DataFrame, keys: list[str], ts: str = "timestamp", duration: str = "duration", order: list[str] = ()) -> DataFrame:
    """Of each key: median_s, the intervals between rows, those shorter than the median duration, and their percentage."""
    w = Window.partitionBy(*keys).orderBy(ts, *order)
    gap = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))) / 1e6
    g = df.select(*keys, F.col(duration).alias("_d"), gap.alias("_gap"))
    middle = g.groupBy(*keys).agg(F.median("_d").alias("median_s"))
    short = F.sum((F.col("_gap") < F.col("median_s")).cast("long"))
    out = g.join(middle, keys).groupBy(*keys, "median_s").agg(F.count("_gap").alias("intervals"), F.coalesce(short, F.lit(0)).alias("short"))
    return out.withColumn("percent", F.coalesce(F.try_divide(100.0 * F.col("short"), F.col("intervals")), F.lit(0.0)))


def check_intervals(df: DataFrame, keys: list[str], most: float = 1.0, **columns) -> DataFrame:
    """The counts of short_intervals; more than `most` percent of short ones is an error."""
    s = short_intervals(df, keys, **columns)
    return s.withColumn("short", F.when(F.col("percent") > most, F.raise_error(F.lit("too many intervals are shorter than the median duration"))).otherwise(F.col("short")))


def global_timeline(sessions: DataFrame, animal: str, session: str, duration: str) -> DataFrame:
    """begin_s and end_s of an animal's sessions when they follow each other in order of their names."""
    w = Window.partitionBy(animal).orderBy(session)
    total = F.sum(duration).over(w)
    return sessions.withColumn("begin_s", total - F.col(duration)).withColumn("end_s", total)


def group_folders(folders: DataFrame, session: str, folder: str) -> DataFrame:
    """The folders of each session, in order, and how many there are."""
    return folders.groupBy(session).agg(F.array_sort(F.collect_set(folder)).alias("folders"), F.count_distinct(folder).alias("n_folders"))


def merge_recordings(recordings: DataFrame, session: str, order: str, samples: str, same: list[str]) -> DataFrame:
    """offset: samples of the session's recordings before each one. Recordings of a session that differ in `same` (names, rate, channels) are an error."""
    w = Window.partitionBy(session).orderBy(order)
    alike = recordings.groupBy(session).agg(F.count_distinct(F.struct(*same)).alias("_kinds"))
    offset = F.sum(samples).over(w) - F.col(samples)
    one = F.when(F.col("_kinds") == 1, F.col("_offset")).otherwise(F.raise_error(F.lit("recordings of a session differ")))
    return recordings.withColumn("_offset", offset).join(alike, session).withColumn("offset", one).drop("_offset", "_kinds")


def file_divisions(files: DataFrame, session: str, order: str, duration: str, endfile: str) -> DataFrame:
    """division_s of each row with a file end: seconds of the rows before it, and the end within the row."""
    w = Window.partitionBy(session).orderBy(order)
    return files.withColumn("division_s", F.sum(duration).over(w) - F.col(duration) + F.col(endfile)).where(F.col(endfile).isNotNull())


def project_features(df: DataFrame, keys: list[str], features: list[str], allow_missing: bool = False) -> DataFrame:
    """The keys and features; a missing feature is a KeyError, or null where that is allowed."""
    missing = [f for f in features if f not in df.columns]
    if missing and not allow_missing:
        raise KeyError(f"no feature {missing}")
    return df.select(*keys, *(F.lit(None).cast("double").alias(f) if f in missing else F.col(f) for f in features))


def project_rows(df: DataFrame, index: list[str], include: list[str]) -> DataFrame:
    """The index columns, then the included ones that are not among them, each once."""
    return df.select(*index, *(c for c in dict.fromkeys(include) if c not in index))


def info(df: DataFrame, animal: str, session: str, duration: str, channel: str | None = None) -> DataFrame:
    """Windows, seconds, sessions and channels of each animal."""
    extra = [F.count_distinct(channel).alias("n_channels")] if channel else []
    return df.groupBy(animal).agg(F.count("*").alias("n_windows"), F.sum(duration).alias("seconds"), F.count_distinct(session).alias("n_sessions"), *extra)


def with_suffix(df: DataFrame, columns: list[str], suffix: str | None = None) -> DataFrame:
    """The columns with one suffix for the whole table; made at random once where none is given."""
    tail = suffix or uuid.uuid4().hex[:8]
    return df.withColumns({c: F.concat_ws("_", F.col(c), F.lit(tail)) for c in columns})


def tidy(df: DataFrame, ts: str = "timestamp", order: tuple[str, ...] = ()) -> DataFrame:
    """Without an index column that a CSV left, sorted by time."""
    return df.drop("index", "Unnamed: 0", "_c0").orderBy(ts, *order)


def union_sessions(tables: list[DataFrame], animal: str) -> DataFrame:
    """All rows, columns that a table lacks as null, and `repeated`: whether the animal stands in several of the tables."""
    out = None
    for k, t in enumerate(tables):
        t = t.withColumn("_table", F.lit(k))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    several = out.groupBy(animal).agg((F.count_distinct("_table") > 1).alias("repeated"))
    return out.drop("_table").join(several, animal)


def order_violations(df: DataFrame, orders: dict[str, list[str]]) -> DataFrame:
    """(column, value) of values that a column's plotting order leaves out."""
    out = None
    for column, allowed in orders.items():
        left = df.select(F.lit(column).alias("column"), F.col(column).cast("string").alias("value")).where(F.col("value").isNotNull() & ~F.col("value").isin(list(allowed))).distinct()
        out = left if out is None else out.union(left)
    return out


def plot_order(value: Column, order: list[str]) -> Column:
    """Place in the order from 0; null for values that it leaves out."""
    at = F.array_position(F.array(*(F.lit(x) for x in order)), value)
    return F.when(at > 0, at - 1)


def band_ratio(df: DataFrame, bands: str, above: str = "alpha", below: str = "delta", name: str = "alphadelta") -> DataFrame:
    """Ratio of two bands of a map column of logarithms; null where the lower one is 0 or absent."""
    return df.withColumn(name, F.try_divide(F.col(bands)[above], F.col(bands)[below]))


def distinct_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count_distinct(value).alias("n"))


def key_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of either table with `side`: first, second or both."""
    both = a.select(*keys).distinct().withColumn("_a", F.lit(True)).join(b.select(*keys).distinct().withColumn("_b", F.lit(True)), keys, "full")
    return both.select(*keys, F.when(F.col("_a").isNull(), "second").when(F.col("_b").isNull(), "first").otherwise("both").alias("side"))


def key_pairs(df: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Pairs a < b of a key's distinct items: channels of an animal or groups of a facet, few a key."""
    d = df.select(*keys, item).distinct()
    return d.withColumnRenamed(item, "a").join(d.withColumnRenamed(item, "b"), keys).where("a < b")


def normalised_psd(psd: DataFrame, total: DataFrame, keys: list[str], value: str = "psd", whole: str = "psdtotal") -> DataFrame:
    """normpsd: power as a share of the total of the same keys; both tables hold one row for each of their own keys."""
    return psd.join(total.select(*keys, whole), keys).withColumn("normpsd", F.try_divide(F.col(value), F.col(whole)))


def with_genotype(df: DataFrame, genotypes: DataFrame, animal: str = "animal", genotype: str = "genotype") -> DataFrame:
    """Each row's genotype; Unknown where the list has none."""
    return df.join(genotypes.select(animal, genotype).dropDuplicates([animal]), animal, "left").withColumn(genotype, F.coalesce(genotype, F.lit("Unknown")))


def compare_runs(first: DataFrame, second: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Both runs' values of the keys that both have, and the difference second - first."""
    a, b = first.select(*keys, F.col(value).alias("first")), second.select(*keys, F.col(value).alias("second"))
    return a.join(b, keys).withColumn("difference", F.col("second") - F.col("first"))


def mean_arrays(df: DataFrame, keys: list[str], array: str) -> DataFrame:
    """Mean of a key's arrays, place by place, nulls and NaN left out: (keys, place, mean)."""
    long = df.select(*keys, F.posexplode(array).alias("place", "_v"))
    return long.groupBy(*keys, "place").agg(F.avg(F.when(~F.isnan(F.col("_v").cast("double")), F.col("_v"))).alias("mean"))


def constant_columns(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The keys' constant columns; a key with two values in one of them is an error."""
    checked = [F.when(F.count_distinct(c) <= 1, F.min(c)).otherwise(F.raise_error(F.lit(f"{c} is not constant"))).alias(c) for c in columns]
    return df.groupBy(*keys).agg(*checked)
