"""Tables written on the way, in the folder that driver and executors share, and stages that compute again only what changed."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset a local session has a folder of its own; a cluster must set it."""
    stated = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if stated:
        return stated.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table read back: what comes after does not compute it again, whichever executors are lost."""
    path = f"{shared_folder(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fingerprints(sources: DataFrame, key: str, parts: list[str], params: dict) -> DataFrame:
    """(key, mark): one mark for all rows of a key in sources and the parameters; another row, value or parameter gives another mark."""
    stated = hashlib.sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()
    row = F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256)
    return sources.groupBy(key).agg(F.sha2(F.concat_ws(",", F.lit(stated), F.array_sort(F.collect_list(row))), 256).alias("mark"))


def _newest(spark: SparkSession, folder: str) -> DataFrame | None:
    """The manifest of the last run that was written whole."""
    try:
        runs = spark.read.parquet(f"{folder}/manifest")
    except AnalysisException:
        return None
    whole = runs.groupBy("run").agg(F.count("*").alias("n"), F.first("of").alias("of")).where("n = of").agg(F.max("run")).first()[0]  # a row a run
    return None if whole is None else runs.where(F.col("run") == whole).select("key", "mark")


def staged(folder: str, sources: DataFrame, key: str, parts: list[str], compute: Callable[[DataFrame], DataFrame], params: dict | None = None) -> DataFrame:
    """What compute gives for all keys of sources, of which only those are computed whose sources or parameters have changed since the last run.

    sources: (key, parts), such as a session's files with their size and time; they are few and small. compute gets (key) of the keys to do and returns rows with the column key.
    Results lie in folder/data by key and mark, so a run that is killed, or a key that has no rows any more, leaves nothing that a later one sees: a result counts once its
    mark stands in a whole manifest, which is written last. Keys that are gone from sources have no rows. Keys are not null.
    """
    spark = sources.sparkSession
    now = written(fingerprints(sources, key, parts, params or {}).select(F.col(key).cast("string").alias("key"), "mark"), "marks")
    before = _newest(spark, folder)
    todo = now if before is None else now.join(before, ["key", "mark"], "left_anti")
    todo = written(todo, "todo")
    if todo.limit(1).count() or before is None:
        wanted = sources.select(key).distinct().join(todo.select(F.col("key").alias("_key")), F.col(key).cast("string") == F.col("_key"), "left_semi")
        made = compute(wanted).withColumn("_key", F.col(key).cast("string"))
        made = made.join(todo.select(F.col("key").alias("_key"), F.col("mark").alias("_mark")), "_key")
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_key", "_mark").parquet(f"{folder}/data")
    if before is None or todo.limit(1).count() or before.count() != now.count():
        total, run = now.count(), spark.sql("select unix_micros(current_timestamp())").first()[0]
        now.withColumn("of", F.lit(total)).withColumn("run", F.lit(run)).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    marks = now.select(F.col("key").alias("_key"), F.col("mark").alias("_mark"))
    data = spark.read.schema(compute(sources.select(key).limit(0)).schema.add("_key", "string").add("_mark", "string")).parquet(f"{folder}/data")
    return data.join(marks, ["_key", "_mark"], "left_semi").drop("_key", "_mark")
