"""The tables behind figures, from long feature tables: (keys, feature, channel, channel2, band or freq, value).

Drawing is left to any plotting library; each function returns what it would draw, by partial aggregates and joins on few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltaloom import constants as C
from voltaloom.functions.names import plot_rank
from voltaloom.operators import aggregate as A


def standardised(df: DataFrame, value: str, mode: str | None, keys: list[str], over: list[str]) -> DataFrame:
    """value less its mean (center), in deviations (z) over the rows of keys and over; zall: of keys alone, with all `over` pooled; None: unchanged.

    Means come from a partial aggregate that is joined back, so the rows of a key need not meet in one task. A deviation of 0 gives null.
    """
    if mode not in ("z", "zall", "center", None):
        raise ValueError(f"unknown mode {mode!r}")
    if mode is None:
        return df
    by = keys if mode == "zall" else [*keys, *over]
    of = df.groupBy(*by).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd"))
    joined = df.join(of, by) if by else df.join(F.broadcast(of))  # one row
    centred = F.col(value) - F.col("_mean")
    return joined.withColumn(value, centred if mode == "center" else F.try_divide(centred, F.nullif(F.col("_sd"), F.lit(0.0)))).drop("_mean", "_sd")


def matrix_average(long: DataFrame, feature: str, groupby: list[str], weight: str | None = None) -> DataFrame:
    """groupby, channel, channel2 (and band), value: the average matrix of each group, weighted if asked; pairs without a value are null."""
    if feature not in C.MATRIX:
        raise ValueError(f"{feature} is no matrix feature")
    keys = [*groupby, "channel", "channel2", *(["band"] if "band" in long.columns else [])]
    return A.group_average(long.where(F.col("feature") == feature), keys, ["value"], weight)


def matrix_difference(matrix: DataFrame, baseline: dict[str, object], groupby: list[str], how: str = "subtract", drop: bool = True) -> DataFrame:
    """Each group's matrix less (or over) that of the group with the baseline's values; groupby are the columns that both share."""
    cells = [c for c in ("channel", "channel2", "band") if c in matrix.columns]
    return A.normalize_baseline(matrix, "value", [*groupby, *cells], baseline, how, drop)


def temporal_lines(long: DataFrame, feature: str, keys: list[str], time: str, mode: str | None = "z") -> DataFrame:
    """Rows of a feature over time, standardised for each channel (and band or pair, lower triangle only) over all rows of its keys."""
    df = long.where(F.col("feature") == feature)
    if feature in C.MATRIX:
        df = df.where(F.col("channel2") < F.col("channel"))
    over = [c for c in ("channel", "channel2", "band") if c in df.columns]
    return standardised(df.select(*keys, time, *over, "value"), "value", mode, keys, over)


def temporal_heatmap(long: DataFrame, feature: str, keys: list[str], ts: str = "timestamp", mode: str | None = "z", minutes: int = 1) -> DataFrame:
    """keys, day, bin, hour (of the bin's middle), value: mean over a bin of the day of a feature's windows, each the mean of its standardised channels."""
    lines = temporal_lines(long, feature, keys, ts, mode)
    windows = lines.groupBy(*keys, ts).agg(F.avg("value").alias("value"))
    second = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    bins = windows.groupBy(*keys, F.to_date(ts).alias("day"), F.floor(second / (60 * minutes)).cast("long").alias("bin")).agg(F.avg("value").alias("value"))
    return bins.withColumn("hour", (F.col("bin") + 0.5) * minutes / 60)


def boundaries(windows: DataFrame, animal: str = "animal", session: str = "animalday", ts: str = "timestamp", endfile: str = "endfile") -> DataFrame:
    """animal, timestamp, day, hour, kind: where a recording ends (endfile) and where another session begins (session) in an animal's windows by time."""
    before = F.lag(session).over(Window.partitionBy(animal).orderBy(ts, session))
    kinds = F.filter(F.array(F.when(F.col(endfile).isNotNull(), F.lit("endfile")), F.when(before != F.col(session), F.lit("session"))), lambda k: k.isNotNull())
    marked = windows.select(animal, F.col(ts).alias("timestamp"), kinds.alias("_kinds"))
    return marked.select(animal, "timestamp", F.to_date("timestamp").alias("day"), (F.hour("timestamp") + F.minute("timestamp") / 60 + F.second("timestamp") / 3600).alias("hour"), F.explode("_kinds").alias("kind"))


def psd_lines(psd: DataFrame, groupby: list[str], average_channels: bool = False, weight: str | None = "duration", band: tuple[float, float] = C.TOTAL_BAND) -> DataFrame:
    """groupby, channel, freq, value, slope, intercept, fit: average densities and the line through them in logarithms within the band.

    psd: rows (…, channel, freq, value) of windows, weighted by their duration.
    """
    lines = A.group_average(psd, [*groupby, "channel", "freq"], ["value"], weight)
    if average_channels:
        lines = lines.groupBy(*groupby, "freq").agg(F.avg("value").alias("value")).withColumn("channel", F.lit("average"))
    u, v = F.log10(F.col("freq").cast("double")), F.log10("value")
    inside = lines.where(F.col("freq").between(*band) & (F.col("value") > 0))
    fit = inside.groupBy(*groupby, "channel").agg(F.regr_slope(v, u).alias("slope"), F.regr_intercept(v, u).alias("intercept"))
    fitted = F.when(F.col("freq") > 0, F.pow(F.lit(10.0), F.col("intercept") + F.col("slope") * u))
    return lines.join(fit, [*groupby, "channel"], "left").select(*groupby, "channel", "freq", "value", "slope", "intercept", fitted.alias("fit"))


def spectrogram(psd: DataFrame, keys: list[str], time: str, centre: str = "mean", mode: str | None = "z", freq_range: tuple[float, float] = (1, 50)) -> DataFrame:
    """keys, time, freq, value: log10 of the channels' mean or median density of each window, standardised over time for each frequency."""
    if centre not in ("mean", "median"):
        raise ValueError(f"unknown statistic {centre!r}")
    middle = (F.avg if centre == "mean" else F.median)("value")
    lines = psd.where(F.col("freq").between(*freq_range)).groupBy(*keys, time, "freq").agg(middle.alias("value"))
    return standardised(lines.withColumn("value", F.log10("value")), "value", mode, keys, ["freq"])


def flat_features(long: DataFrame, keys: list[str]) -> DataFrame:
    """keys, name, value: one name for each feature, channel, pair (lower triangle) and band, as in rms_LMot or cohere_RMot_LMot_alpha."""
    parts = [c for c in ("feature", "channel", "channel2", "band") if c in long.columns]
    df = long.where(F.col("channel2").isNull() | (F.col("channel2") < F.col("channel"))) if "channel2" in parts else long
    return df.select(*keys, F.concat_ws("_", *parts).alias("name"), "value")


def ordered(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in plot order: columns with a fixed order by it, others by value."""
    rank: list[Column] = [plot_rank(F.col(c).cast("string") if c != "isday" else F.col(c), c) if c in C.PLOT_ORDER else F.col(c) for c in columns]
    return df.orderBy(*rank)
