"""Window tables on disk: Parquet by session, with a JSON file of what holds for the whole table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

INFO = "_info"


def save_windows(df: DataFrame, folder: str, info: dict, overwrite: bool = False, by: str = "animalday") -> None:
    """Write df to folder/windows and info to folder/_info; files beside them stay."""
    mode = "overwrite" if overwrite else "error"
    df.write.mode(mode).partitionBy(by).parquet(f"{folder}/windows")
    df.sparkSession.createDataFrame([(json.dumps(info, sort_keys=True),)], "value string").coalesce(1).write.mode(mode).text(f"{folder}/{INFO}")


def load_windows(spark: SparkSession, folder: str) -> tuple[DataFrame, dict]:
    """What save_windows wrote; other than one line of information is a ValueError."""
    lines = spark.read.text(f"{folder}/{INFO}").limit(2).collect()
    if len(lines) != 1:
        raise ValueError(f"{folder}: {len(lines)} lines of information")
    return spark.read.parquet(f"{folder}/windows"), json.loads(lines[0].value)


def save_csv(df: DataFrame, folder: str, overwrite: bool = False) -> None:
    """Tidy tables as CSV with a header."""
    df.write.mode("overwrite" if overwrite else "error").option("header", True).csv(folder)
