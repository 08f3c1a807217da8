"""Tumbling features and gap clusters over event time, with watermarks: late and repeated rows change nothing that a table of the same rows would not have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltaloom.staging import shared_folder


def once(events: DataFrame, ts: str, ids: list[str], delay: str) -> DataFrame:
    """Rows of distinct ids. In a stream, rows that are more than delay late are left out, and repeats are known for as long."""
    df = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(ids) if events.isStreaming else df.dropDuplicates(ids)


def tumbling_features(events: DataFrame, keys: list[str], ts: str, value: str, length: str, ids: list[str], delay: str = "1 day") -> DataFrame:
    """keys, start, stop, n, rms, ampvar of the windows of one length; windows without events have no row. State: four numbers a window."""
    x = F.col(value).cast("double")
    windows = once(events, ts, ids, delay).groupBy(*keys, F.window(ts, length).alias("w"))
    of = windows.agg(F.count(x).alias("n"), F.sqrt(F.avg(x * x)).alias("rms"), F.var_pop(x).alias("ampvar"))
    return of.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n", "rms", "ampvar")


def gap_clusters(events: DataFrame, keys: list[str], ts: str, value: str, gap_s: float, ids: list[str], delay: str = "1 day") -> DataFrame:
    """keys, first_ts, last_ts, n, lowest of each run of events no further apart than gap_s. A late event may join two runs."""
    width = f"{round(gap_s * 1_000_000) + 1} microseconds"  # a session's end is open
    sessions = once(events, ts, ids, delay).groupBy(*keys, F.session_window(ts, width).alias("w"))
    return sessions.agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n"), F.min(value).alias("lowest")).select(*keys, "first_ts", "last_ts", "n", "lowest")


def run_to_end(stream: DataFrame, name: str, marks: Column | None = None) -> DataFrame:
    """Run a stream over all that its source has now, and give its whole result as a table in the shared folder.

    Each micro-batch writes the whole result to a folder of its own; the last one counts, so a batch that is repeated after a failure does no harm.
    """
    spark, seen = stream.sparkSession, []
    folder = f"{shared_folder(spark)}/streams/{name}-{spark.sql('select uuid()').first()[0]}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        seen.append(number)

    writer = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(keep)
    writer.start().awaitTermination()
    if not seen:
        return spark.createDataFrame([], stream.schema)
    out = spark.read.schema(stream.schema).parquet(f"{folder}/batch={max(seen)}")
    return out if marks is None else out.where(marks)
