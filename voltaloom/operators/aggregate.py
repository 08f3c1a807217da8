"""NULL-aware averages of feature tables, baselines, comparisons and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltaloom.operators import ranks
from voltaloom.staging import written


def weighted_mean(value: Column, weight: Column) -> Column:
    """Mean over rows with a value, weights renormalised; null if there is none."""
    return F.try_divide(F.sum(value * weight), F.sum(F.when(value.isNotNull(), weight)))


def group_average(df: DataFrame, keys: list[str], values: list[str], weight: str | None = "duration") -> DataFrame:
    w = F.col(weight) if weight else F.lit(1.0)
    return df.groupBy(*keys).agg(*(weighted_mean(F.col(v), w).alias(v) for v in values))


def aggregate_windows(df: DataFrame, keys: list[str], values: list[str], duration: str = "duration", ts: str = "timestamp", endfile: str | None = None) -> DataFrame:
    """Total duration, first timestamp, the last window's endfile and weighted means."""
    extra = [F.max_by(endfile, F.struct(ts)).alias(endfile)] if endfile else []
    return df.groupBy(*keys).agg(F.sum(duration).alias(duration), F.min(ts).alias(ts), *extra, *(weighted_mean(F.col(v), F.col(duration)).alias(v) for v in values))


def collapse_matrix(df: DataFrame, keys: list[str], value: str, first: str = "channel", second: str = "channel2") -> DataFrame:
    """Mean of the strict lower triangle."""
    return df.where(F.col(second) < F.col(first)).groupBy(*keys).agg(F.avg(value).alias(value))


def normalize_baseline(df: DataFrame, feature: str, keys: list[str], baseline: dict[str, object], how: str = "subtract", drop: bool = False) -> DataFrame:
    """Feature less (or over) its mean among the rows with the baseline's values, by keys; without keys one mean for all.

    The means are written first: their size is known where the join is planned, so a few keys do not gather all rows in as many tasks.
    """
    if how not in ("subtract", "divide"):
        raise ValueError(how)
    is_base = F.lit(True)
    for k, v in baseline.items():
        is_base = is_base & (F.col(k) == F.lit(v))
    base = df.where(is_base)
    mean = F.avg(feature).alias("_base")
    joined = df.join(written(base.groupBy(*keys).agg(mean), "baseline"), keys, "left") if keys else df.crossJoin(F.broadcast(base.agg(mean)))  # one row
    out = joined.withColumn(feature, F.col(feature) - F.col("_base") if how == "subtract" else F.try_divide(F.col(feature), F.col("_base"))).drop("_base")
    return out.where(~is_base) if drop else out


def exact_mean(value: str) -> Column:
    """Mean of doubles, the same in any order of the rows where each has at most 8 decimals: their sum is then exact, so means half-way between two roundings stay there."""
    d = F.col(value).try_cast("decimal(28,8)")
    exact = F.bool_and(F.coalesce(d.cast("double") == F.col(value), F.col(value).isNull()))
    return F.when(exact, F.avg(d).cast("double")).otherwise(F.avg(value))


def animal_weights(df: DataFrame, animal: str = "animal") -> Column:
    return 1 / F.count("*").over(Window.partitionBy(animal)).cast("double")


def weighted_histogram(df: DataFrame, value: str, weight: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Density of the weights over equal bins, the last one closed."""
    width = (hi - lo) / bins
    b = F.least(F.floor((F.col(value) - lo) / width).cast("long"), F.lit(bins - 1).cast("long"))
    got = df.where(F.col(value).between(lo, hi)).groupBy(b.alias("bin")).agg(F.sum(weight).alias("w"))
    return got.withColumn("density", F.col("w") / (F.sum("w").over(Window.partitionBy(F.lit(0))) * width)).drop("w")


def auto_bins(df: DataFrame, value: str) -> tuple[float, float, int]:
    """Edges and number of bins by the narrower of the Freedman-Diaconis and Sturges widths."""
    import math

    r = df.agg(F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    sturges = (r.hi - r.lo) / (math.log2(r.n) + 1)
    q = ranks.quantiles(df, [], value, {"q1": 0.25, "q3": 0.75}).first()
    width = min(2 * (q.q3 - q.q1) * r.n ** (-1 / 3) or sturges, sturges)
    return float(r.lo), float(r.hi), math.ceil((r.hi - r.lo) / width)


def modified_z(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """0.6745 (x - median) / median absolute deviation."""
    mid = ranks.quantiles(df, keys, value, {"_mid": 0.5})
    a = df.join(mid, keys, "left").withColumn("_dev", F.abs(F.col(value) - F.col("_mid")))
    mad = ranks.quantiles(a, keys, "_dev", {"_mad": 0.5})
    return a.join(mad, keys, "left").withColumn("modified_z", F.try_divide(0.6745 * (F.col(value) - F.col("_mid")), F.col("_mad"))).drop("_mid", "_dev", "_mad")


def effect_size(df: DataFrame, value: str, group: str, a: object, b: object, keys: list[str]) -> DataFrame:
    """Means, sample deviations, their difference and Cohen's d with the pooled deviation."""
    at = lambda g: F.when(F.col(group) == F.lit(g), F.col(value))
    s = df.groupBy(*keys).agg(F.avg(at(a)).alias("mean_a"), F.avg(at(b)).alias("mean_b"), F.stddev_samp(at(a)).alias("sd_a"), F.stddev_samp(at(b)).alias("sd_b"), F.count(at(a)).alias("n_a"), F.count(at(b)).alias("n_b"))
    pooled = F.sqrt(((F.col("n_a") - 1) * F.col("sd_a") ** 2 + (F.col("n_b") - 1) * F.col("sd_b") ** 2) / (F.col("n_a") + F.col("n_b") - 2))
    return s.withColumn("diff", F.col("mean_a") - F.col("mean_b")).withColumn("cohens_d", F.try_divide(F.col("diff"), pooled))


def agreement(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """Pairs with both values: their number, Pearson's r and root mean square difference."""
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.corr(x, y).alias("r"), F.sqrt(F.avg((F.col(x) - F.col(y)) ** 2)).alias("rmse"))


def log2_fold(a: Column, b: Column, least: float = 1e-10) -> Column:
    return F.log2(F.greatest(a, F.lit(least)) / F.greatest(b, F.lit(least)))
