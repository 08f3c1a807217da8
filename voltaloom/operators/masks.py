"""Artifact filters as keep columns on long tables (window, channel), combined by AND, and their application as NULLs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def zscore(value: Column, keys: list[str]) -> Column:
    """Over all rows of the keys, population deviation; null where that is 0."""
    w = Window.partitionBy(*keys)
    return F.try_divide(value - F.avg(value).over(w), F.nullif(F.stddev_pop(value).over(w), F.lit(0.0)))


def logrms_range(keys: list[str], rms: str = "rms", z_range: float = 3.0) -> Column:
    z = zscore(F.ln(F.nullif(F.col(rms), F.lit(0.0))), keys)
    return F.coalesce(F.abs(z) <= z_range, F.lit(True))


def high_rms(rms: str = "rms", most: float = 500.0) -> Column:
    return F.coalesce(F.col(rms) <= most, F.lit(True))


def low_rms(rms: str = "rms", least: float = 50.0) -> Column:
    return F.coalesce(F.col(rms) >= least, F.lit(True))


def high_beta(window: list[str], share: Column, most: float = 0.4) -> Column:
    """False for all channels of a window of which one has more."""
    return ~F.coalesce(F.bool_or(share > most).over(Window.partitionBy(*window)), F.lit(False))


def reject_channels(bad: list[str], channel: str = "channel", abbreviations: dict[str, str] | None = None) -> Column:
    """False for the listed channels, by name or, with abbreviations (name to abbreviation), by either."""
    short = abbreviations or {}
    names = sorted({*bad, *(short.get(b, b) for b in bad), *(k for k, v in short.items() if v in bad)})
    return ~F.col(channel).isin(names) if names else F.lit(True)


def merge_bad(existing: DataFrame, new: DataFrame, mode: str | None = "union") -> DataFrame:
    """Bad channels (animalday, channel) after a filter: of both lists, of the new one (overwrite), or unchanged (None)."""
    if mode not in ("union", "overwrite", None):
        raise ValueError(f"unknown mode {mode}")
    e, n = existing.select("animalday", "channel"), new.select("animalday", "channel")
    return {"union": e.union(n), "overwrite": n, None: e}[mode].distinct()


def reject_by_session(df: DataFrame, bad: DataFrame, keep: str = "keep", sessions: DataFrame | None = None) -> DataFrame:
    """keep is false for the (animalday, channel) pairs of bad.

    sessions (animalday): those that the list speaks of, also if they have no bad channel; a session of df that a list of any sessions leaves out is then an error.
    """
    marked = bad.select("animalday", "channel").distinct().withColumn("_bad", F.lit(True))
    out = df.join(marked, ["animalday", "channel"], "left").withColumn(keep, F.col("_bad").isNull()).drop("_bad")
    if sessions is None:
        return out
    some = sessions.agg((F.count("*") > 0).alias("_any"))  # one row
    listed = sessions.select("animalday").distinct().withColumn("_listed", F.lit(True))
    absent = F.col("_any") & F.col("_listed").isNull()
    checked = out.join(listed, "animalday", "left").join(F.broadcast(some))
    return checked.withColumn(keep, F.when(absent, F.raise_error(F.lit("a session is missing from the bad channels")).cast("boolean")).otherwise(F.col(keep))).drop("_listed", "_any")


def session_quality(df: DataFrame, folders: DataFrame, folder: str = "folder", genotype: str = "genotype") -> DataFrame:
    """Rows of folders that are not listed, with a known genotype."""
    known = F.col(genotype).isNotNull() & (F.col(genotype) != "Unknown")
    return df.where(known).join(folders.select(folder).distinct(), folder, "left_anti")


def morphology_windows(df: DataFrame, seconds: float, duration: str = "duration") -> int:
    """Windows that so many seconds span by the median duration, 1 at least."""
    middle = df.agg(F.median(duration)).first()[0]
    return max(1, int(seconds / middle)) if middle else 1


def min_valid_channels(window: list[str], keep: Column, n: int = 3) -> Column:
    return keep & (F.sum(keep.cast("int")).over(Window.partitionBy(*window)) >= n)


def _erode(keep: Column, w, k: int) -> Column:
    frame = w.rowsBetween(-(k // 2), k - 1 - k // 2)
    return F.coalesce((F.min(keep).over(frame)) & (F.count(F.lit(1)).over(frame) == k), F.lit(False))


def _dilate(keep: Column, w, k: int) -> Column:
    return F.coalesce(F.max(keep).over(w.rowsBetween(-(k - 1 - k // 2), k // 2)), F.lit(False))


def open_close(df: DataFrame, keep: str, keys: list[str], order: list[str], k: int) -> DataFrame:
    """Binary opening, then closing, of each channel's keeps by k windows; outside counts as false. k <= 1 changes nothing."""
    if k <= 1:
        return df
    w = Window.partitionBy(*keys).orderBy(*order)
    for step in (_erode, _dilate, _dilate, _erode):
        df = df.withColumn(keep, step(F.col(keep), w, k))
    return df


def apply_mask(df: DataFrame, values: list[str], keep: Column) -> DataFrame:
    return df.withColumns({v: F.when(keep, F.col(v)) for v in values})


def apply_pair_mask(pairs: DataFrame, kept: DataFrame, values: list[str], keys: list[str], first: str = "channel", second: str = "channel2") -> DataFrame:
    """Matrix features in long form: null in the row and the column of a channel that kept (keys, channel, keep) rejects."""
    one = kept.select(*keys, F.col("channel").alias(first), F.col("keep").alias("_k1"))
    two = kept.select(*keys, F.col("channel").alias(second), F.col("keep").alias("_k2"))
    both = pairs.join(one, [*keys, first], "left").join(two, [*keys, second], "left")
    ok = F.coalesce("_k1", F.lit(True)) & F.coalesce("_k2", F.lit(True))
    return both.withColumns({v: F.when(ok, F.col(v)) for v in values}).drop("_k1", "_k2")


def apply_band_mask(df: DataFrame, bands: list[str], keep: Column) -> DataFrame:
    """Map columns of bands, each band null where keep is false."""
    return df.withColumns({b: F.transform_values(b, lambda _, v: F.when(keep, v)) for b in bands})


def filter_all(df: DataFrame, bad_channels: list[str] = (), bad: DataFrame | None = None, window=("animalday", "frag_idx"), recording=("animal", "channel"), share: str = "beta_share", own: list[Callable[[DataFrame], Column]] | None = None) -> DataFrame:
    """keep by all filters with low_rms at 30: logrms_range, high_rms, low_rms, high_beta, bad channels of the session and of all; own replaces this list."""
    if own is not None:
        keep = F.lit(True)
        for f in own:
            keep = keep & f(df)
        return df.withColumn("keep", keep)
    keep = logrms_range(list(recording)) & high_rms() & low_rms(least=30.0) & high_beta(list(window), F.col(share)) & reject_channels(list(bad_channels))
    out = df.withColumn("keep", keep)
    return out if bad is None else reject_by_session(out, bad, "_session").withColumn("keep", F.col("keep") & F.col("_session")).drop("_session")


def filter_by(df: DataFrame, name: str, values: list[str] = (), **options) -> DataFrame:
    """df after one filter of apply_filters, or after the bad channels of sessions (name reject_by_session, bad=...): values are null where it does not keep, keep is gone."""
    if name == "reject_by_session":
        kept = reject_by_session(df, options["bad"], "keep", **{k: v for k, v in options.items() if k != "bad"})
    else:
        kept = apply_filters(df, {name: options})
    return apply_mask(kept, list(values), F.col("keep")).drop("keep")


def apply_filters(df: DataFrame, config: dict[str, dict] | None = None, window=("animalday", "frag_idx"), recording=("animal", "channel"), own: list[Callable[[DataFrame], Column]] = (), bad: DataFrame | None = None) -> DataFrame:
    """df with keep: the named filters and own ones, combined, then min_valid_channels and morphology if configured.

    Without a config: logrms_range, high_rms, low_rms at 50, high_beta where df has beta_share, and the bad channels of sessions if given.
    """
    made = {
        "logrms_range": lambda **o: logrms_range(list(recording), **o),
        "high_rms": high_rms,
        "low_rms": low_rms,
        "high_beta": lambda share="beta_share", **o: high_beta(list(window), F.col(share), **o),
        "reject_channels": reject_channels,
    }
    config = {"logrms_range": {}, "high_rms": {}, "low_rms": {}, **({"high_beta": {}} if "beta_share" in df.columns else {})} if config is None else dict(config)
    k, least = config.pop("morphology", {}).get("k", 1), config.pop("min_valid_channels", {}).get("n", 0)
    if unknown := set(config) - set(made):
        raise ValueError(f"unknown filters {sorted(unknown)}")
    keep = F.lit(True)
    for c in [*(made[name](**o) for name, o in config.items()), *(f(df) for f in own)]:
        keep = keep & c
    df = df.withColumn("keep", keep)
    if bad is not None:
        df = reject_by_session(df, bad, "_session").withColumn("keep", F.col("keep") & F.col("_session")).drop("_session")
    df = open_close(df, "keep", list(recording), ["timestamp", "frag_idx"], k)
    return df.withColumn("keep", min_valid_channels(list(window), F.col("keep"), least)) if least else df
