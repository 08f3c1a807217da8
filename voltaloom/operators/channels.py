"""Pairs of a session's channels, as expressions over arrays: one join of channels, no row a sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How near to 1 a correlation counts in Fisher's z.
Z_EDGE = 1e-6


def correlation(a: Column, b: Column) -> Column:
    """Pearson's r over the places where both arrays have a number; null where one is constant or fewer than two places are shared."""
    pairs = F.filter(F.zip_with(a, b, lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))), lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    names = ("n", "x", "y", "xx", "yy", "xy")
    zero = F.struct(*(F.lit(0.0).alias(n) for n in names))

    def add(s: Column, p: Column) -> Column:
        x, y = p["x"], p["y"]
        return F.struct(*((s[n] + v).alias(n) for n, v in zip(names, (F.lit(1.0), x, y, x * x, y * y, x * y), strict=True)))

    def r(s: Column) -> Column:
        spread = lambda ss, t: s["n"] * ss - t * t
        bottom = F.sqrt(spread(s["xx"], s["x"]) * spread(s["yy"], s["y"]))
        return F.try_divide(s["n"] * s["xy"] - s["x"] * s["y"], F.when(bottom > 0, bottom))

    return F.aggregate(pairs, zero, add, r)


def pair_correlations(df: DataFrame, keys: list[str], channel: str, signal: str, first: str = "channel", second: str = "channel2") -> DataFrame:
    """keys, first, second, r of each pair second < first of a session's channels. A session has tens of channels; rows without keys or channel have no pair."""
    a, b = (df.select(*keys, F.col(channel).alias(name), F.col(signal).alias(v)) for name, v in ((first, "_a"), (second, "_b")))
    return a.join(b, keys).where(F.col(second) < F.col(first)).select(*keys, first, second, correlation(F.col("_a"), F.col("_b")).alias("r"))


def fisher_z(r: Column) -> Column:
    """Fisher's z of a correlation, which counts as no nearer to 1 or -1 than Z_EDGE; null of null."""
    return F.when(r.isNotNull(), F.atanh(F.greatest(F.least(r, F.lit(1 - Z_EDGE)), F.lit(-1 + Z_EDGE))))
