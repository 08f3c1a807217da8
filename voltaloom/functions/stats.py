"""Test statistics as expressions and aggregates."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltaloom.functions import kernels
from voltaloom.operators import ranks


def mann_whitney(df: DataFrame, value: str, group: str, first: object, keys: list[str]) -> DataFrame:
    """u of the first group, by average ranks over the pooled values; z by the normal approximation without tie correction."""
    d = ranks.distribution(df, keys, value, mine=F.col(group) == F.lit(first), others=F.col(group) != F.lit(first))
    rank = F.col("n_before") + (F.col("n") + 1) / 2.0
    s = d.groupBy(*keys).agg(F.sum(F.col("mine") * rank).alias("_r"), F.sum("mine").alias("n1"), F.sum("others").alias("n2"))
    u = F.col("_r") - F.col("n1") * (F.col("n1") + 1) / 2.0
    z = F.try_divide(u - F.col("n1") * F.col("n2") / 2, F.sqrt(F.col("n1") * F.col("n2") * (F.col("n1") + F.col("n2") + 1) / 12))
    return s.select(*keys, "n1", "n2", u.alias("u"), z.alias("z"))


def normality(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """D'Agostino and Pearson's k2 and its p."""
    m = df.groupBy(*keys).agg(F.count(value).cast("double").alias("n"), F.skewness(value).alias("g1"), (F.kurtosis(value) + 3).alias("b2"))
    n = F.col("n")
    y = F.col("g1") * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + F.sqrt(2 * (b - 1))
    zs = 1 / F.sqrt(0.5 * F.ln(w2)) * F.asinh(y / F.sqrt(2 / (w2 - 1)))
    x = (F.col("b2") - 3 * (n - 1) / (n + 1)) / F.sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)))
    s = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / s * (2 / s + F.sqrt(1 + 4 / (s * s)))
    d = 1 + x * F.sqrt(2 / (a - 4))
    zk = (1 - 2 / (9 * a) - F.signum(d) * F.cbrt((1 - 2 / a) / F.abs(d))) / F.sqrt(2 / (9 * a))
    return m.where("n >= 8").select(*keys, (zs * zs + zk * zk).alias("k2")).withColumn("p", F.exp(-F.col("k2") / 2))


def ks_statistic(df: DataFrame, value: str, cdf: Callable[[Column], Column], keys: list[str]) -> DataFrame:
    """Largest distance of the values' distribution function from cdf, the hypothetical one."""
    d, u = ranks.distribution(df, keys, value), cdf(F.col(value))
    upper, lower = (F.col("n_before") + F.col("n")) / F.col("n_all"), F.col("n_before") / F.col("n_all")
    return d.groupBy(*keys).agg(F.max(F.greatest(upper - u, u - lower)).alias("ks"))


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution function by West's rational form of Hart's approximation, to about 1e-14."""
    # The approximation's coefficients.
    above = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
    below = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
    far, root = 7.07106781186547, 2.506628274631
    a = F.abs(x.cast("double"))
    poly = lambda ks: reduce(lambda out, k: out * a + F.lit(k), ks[1:], F.lit(ks[0]))
    fraction = reduce(lambda out, k: a + F.lit(float(k)) / out, (4, 3, 2, 1), a + F.lit(0.65))
    tail = F.exp(-a * a / 2) * F.when(a < far, poly(above) / poly(below)).otherwise(1 / (fraction * root))
    return F.when(x > 0, 1 - tail).otherwise(tail)


def with_pearson_p(df: DataFrame, r: str = "r", n: str = "n") -> DataFrame:
    """p of each correlation; the table has a row for each comparison."""

    def run(batches):
        for pdf in batches:
            yield pdf.assign(p=[kernels.pearson_p(a, int(b)) if a == a else None for a, b in zip(pdf[r], pdf[n], strict=True)])

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField("p", T.DoubleType())]))  # add would change the schema that df holds


def geometric_z(value: str, keys: list[str]) -> F.Column:
    """z of the logarithm over all rows of the keys, population deviation; null for values that have none."""
    x = F.ln(F.when(F.col(value) > 0, F.col(value)))
    w = Window.partitionBy(*keys)
    return F.try_divide(x - F.avg(x).over(w), F.nullif(F.stddev_pop(x).over(w), F.lit(0.0)))


def mann_whitney_pairs(df: DataFrame, value: str, group: str, keys: list[str]) -> DataFrame:
    """u of group a, and z with tie and continuity correction, of every pair a < b of a facet's groups.

    Values are counted by distinct value first, so the pairs meet on the few rows of groups and values that differ, not on all rows.
    """
    counts = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(*keys, F.col(group).alias("g"), F.col(value).alias("v")).agg(F.count("*").alias("c"))
    groups = counts.select(*keys, "g").distinct()
    pairs = groups.withColumnRenamed("g", "a").join(groups.withColumnRenamed("g", "b"), keys).where("a < b")
    rows = pairs.join(counts, keys).where("g = a or g = b")
    at = rows.groupBy(*keys, "a", "b", "v").agg(F.sum(F.when(F.col("g") == F.col("a"), F.col("c")).otherwise(0)).alias("ca"), F.sum("c").alias("t"))
    ranked = ranks.prefix_sums(at, [*keys, "a", "b"], ["v"], ["t"]).withColumn("rk", F.col("t_before") + (F.col("t") + 1) / 2.0)
    t = F.col("t").cast("double")
    s = ranked.groupBy(*keys, "a", "b").agg(F.sum(F.col("ca") * F.col("rk")).alias("r"), F.sum("ca").cast("double").alias("n1"), F.sum("t").cast("double").alias("n"), F.sum(t * t * t - t).alias("ties"))
    n1, n, n2 = F.col("n1"), F.col("n"), F.col("n") - F.col("n1")
    u, sd = F.col("r") - n1 * (n1 + 1) / 2, F.sqrt(n1 * n2 / 12 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1))))
    shift = u - n1 * n2 / 2
    return s.select(*keys, "a", "b", u.alias("u"), F.try_divide(shift - 0.5 * F.signum(shift), F.nullif(sd, F.lit(0.0))).alias("z"))


def qq_points(df: DataFrame, value: str, keys: list[str], order: list[str]) -> DataFrame:
    """position: the share (i - 0.5) / n of each value in ascending order, whose normal quantile a QQ plot sets against it."""
    numbered = ranks.row_numbers(df.where(F.col(value).isNotNull()), keys, [value, *order], "_i", "_n")
    return numbered.withColumn("position", (F.col("_i") - 0.5) / F.col("_n")).drop("_i", "_n")


def normal_quantile(p: F.Column) -> F.Column:
    """Quantile of the normal distribution by Acklam's rational approximation; null outside (0, 1)."""
    # The approximation's coefficients.
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)

    def poly(k, x):
        out = F.lit(k[0])
        for v in k[1:]:
            out = out * x + v
        return out

    low = 0.02425
    q, tail = p - 0.5, F.sqrt(-2 * F.ln(F.least(p, 1 - p)))
    mid = poly(a, q * q) * q / poly(b, q * q)
    return F.when((p <= 0) | (p >= 1), None).when(p < low, poly(c, tail) / poly(d, tail)).when(p > 1 - low, -poly(c, tail) / poly(d, tail)).otherwise(mid)
