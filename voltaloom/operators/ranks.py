"""Prefix sums, row numbers, ranks and exact quantiles of keys that hold any share of the rows.

Rows are partitioned by ranges of key and order, so a key with a third of all rows lies in a third of the partitions. Each partition sums its own rows;
the sums of a key's earlier partitions, one row a partition and key, are added as offsets. Ranks and quantiles go over the distinct values with their counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltaloom.staging import written


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Equal keys, nulls included; right has them with the prefix k_."""
    return reduce(lambda a, b: a & b, (left[n].eqNullSafe(right[f"k_{n}"]) for n in names))


def prefix_sums(df: DataFrame, keys: list[str], order: list[str], sums: list[str]) -> DataFrame:
    """df with x_before, the sum of x over the key's rows earlier in order, and x_all, its sum over the whole key, for each x of sums.

    Rows that tie in order lie in one partition, in no order among themselves: order should tell rows apart. Null keys are a key; null sums count as 0.
    """
    placed = written(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "prefix-sums")
    by = ["_part", *keys]
    totals = placed.groupBy(*by).agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(f"_{x}") for x in sums))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*(F.col(k).alias(f"k_{k}") for k in by), *(F.coalesce(F.sum(f"_{x}").over(earlier), F.lit(0)).alias(f"{x}_offset") for x in sums), *(F.sum(f"_{x}").over(Window.partitionBy(*keys)).alias(f"{x}_all") for x in sums))
    here = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumns({f"_{x}_here": F.coalesce(F.sum(x).over(here), F.lit(0)) for x in sums})
    joined = summed.join(offsets, _same(summed, offsets, by))
    return joined.select(*df.columns, *((F.col(f"_{x}_here") + F.col(f"{x}_offset")).alias(f"{x}_before") for x in sums), *(f"{x}_all" for x in sums))


def row_numbers(df: DataFrame, keys: list[str], order: list[str], name: str = "row_number", total: str | None = None) -> DataFrame:
    """df with each row's number within its key, from 1, and, if asked for, the key's number of rows."""
    out = prefix_sums(df.withColumn("_one", F.lit(1).cast("long")), keys, order, ["_one"]).withColumn(name, F.col("_one_before") + 1)
    return (out.withColumn(total, F.col("_one_all")) if total else out).drop("_one", "_one_before", "_one_all")


def distribution(df: DataFrame, keys: list[str], value: str, **counts: Column) -> DataFrame:
    """keys, value, n (rows with this value), n_before, n_all, and for each further condition its count among n; rows without value do not count."""
    each = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"), *(F.count_if(c).alias(name) for name, c in counts.items()))
    return prefix_sums(each, keys, [value], ["n"])


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys and the exact quantile of each share, linear between neighbouring values; keys without a value are absent."""
    d = distribution(df, keys, value)
    at = {name: (F.col("n_all") - 1) * F.lit(float(share)) for name, share in shares.items()}
    holds = lambda place: (F.col("n_before") <= place) & (place < F.col("n_before") + F.col("n"))
    wanted = reduce(lambda a, b: a | b, (holds(end(x)) for x in at.values() for end in (F.floor, F.ceil)))
    pick = lambda x, end: F.max(F.when(holds(end(x)), F.col(value).cast("double")))
    picked = d.where(wanted).groupBy(*keys).agg(F.first("n_all").alias("n_all"), *(pick(x, end).alias(f"{name}_{side}") for name, x in at.items() for side, end in (("lo", F.floor), ("hi", F.ceil))))
    linear = lambda name, x: F.col(f"{name}_lo") + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * (x - F.floor(x))
    return picked.select(*keys, *(linear(name, x).alias(name) for name, x in at.items()))
