"""Between wide and long feature tables, channel order, and plot-ready tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltaloom import constants as C
from voltaloom.functions.names import plot_rank


def melt(df: DataFrame, keys: list[str], values: list[str], variable: str = "feature", value: str = "value") -> DataFrame:
    return df.unpivot(keys, values, variable, value)


def explode_channels(df: DataFrame, feature: str, channels: str = "channels") -> DataFrame:
    """A row for each channel of an array feature."""
    z = F.explode(F.arrays_zip(F.col(channels).alias("channel"), F.col(feature).alias("value")))
    return df.withColumn("_z", z).withColumn("channel", F.col("_z.channel")).withColumn("value", F.col("_z.value")).drop("_z", feature, channels)


def explode_bands(df: DataFrame, feature: str) -> DataFrame:
    """A row for each band of a map feature."""
    return df.select(*[c for c in df.columns if c != feature], F.explode(feature).alias("band", "value"))


def reorder_channels(values: Column, names: Column, target: list[str]) -> Column:
    """An array feature in the order of target; channels that it lacks are null."""
    return F.transform(F.array(*(F.lit(t) for t in target)), lambda t: F.get(values, F.array_position(names, t).cast("int") - 1))


def pad_channels(df: DataFrame, keys: list[str], channel: str, target: list[str]) -> DataFrame:
    """Long form of the same: every key with every target channel, absent ones null, others gone."""
    if len(set(target)) < len(target):
        raise ValueError("target channels repeat")
    all_keys = df.select(*keys).distinct().withColumn(channel, F.explode(F.array(*(F.lit(t) for t in target))))
    return all_keys.join(df, [*keys, channel], "left")


def pivot(df: DataFrame, index: list[str], column: Column, values: list[str], value: str) -> DataFrame:
    return df.groupBy(*index).pivot(column, values).agg(F.avg(value))


def band_columns(long: DataFrame, feature: str, keys: list[str], bands: list[str] = tuple(C.BANDS)) -> DataFrame:
    """keys and a column feature_band for each band of a banded or coherence feature: the average of its rows; null where a band has none."""
    of = long.where(F.col("feature") == feature)
    return of.groupBy(*keys).agg(*(F.avg(F.when(F.col("band") == b, F.col("value"))).alias(f"{feature}_{b}") for b in bands))


def timeseries(long: DataFrame, feature: str, groupby: list[str], channels: list[str] | None = None, collapse: bool = False, average: bool = False, strict: bool = False) -> DataFrame:
    """Rows of one feature of a long table for plots and tests: groupby columns, channel, band where there are bands, value.

    Channels are those given; collapse averages over them (matrices: over the strict lower triangle); average also over all other rows. Rows with
    null groupby values stay unless strict, which raises on them.
    """
    if "band" in groupby:
        raise ValueError("band cannot be grouped by")
    if missing := set(groupby) - set(long.columns):
        raise ValueError(f"no columns {sorted(missing)}")
    df = long.where(F.col("feature") == feature)
    if strict and df.where(" or ".join(f"`{g}` is null" for g in groupby)).limit(1).count():
        raise ValueError("null in groupby columns")
    if feature in C.MATRIX and collapse:
        df = df.where(F.col("channel2") < F.col("channel"))
    elif channels:
        df = df.where(F.col("channel").isin(channels))
    extra = ["band"] if feature in C.BANDED + ["cohere", "zcohere", "imcoh", "zimcoh"] else ["freq"] if feature in C.SPECTRUM else []
    if collapse:
        at = [c for c in df.columns if c not in ("channel", "channel2", "value")]
        df = df.groupBy(*at).agg(F.avg("value").alias("value")).withColumn("channel", F.lit("average"))
    keys = [*groupby, "channel", *extra]
    out = df.groupBy(*keys).agg(F.avg("value").alias("value")) if average else df.select(*keys, "value")
    order = [plot_rank(F.col(c), c) if c in C.PLOT_ORDER else F.col(c) for c in keys]
    return out.orderBy(*order)


def sex_and_gene(genotype: Column) -> tuple[Column, Column]:
    sex = F.when(F.substring(genotype, 1, 1) == "M", "Male").when(F.substring(genotype, 1, 1) == "F", "Female")
    return sex, F.substr(genotype, F.lit(2))
