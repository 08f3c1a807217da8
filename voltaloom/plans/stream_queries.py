"""The driver's events as a stream, each with the SQL of the whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltaloom.plans.queries import query, r6, table
from voltaloom.streaming import events as EV


def _stream(spark, d):
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{d}/events.parque[t]")  # a pattern, as the table can be one file


@query("SELECT user_id, date_trunc('day', ts) AS start, count(value) AS n, round(sqrt(avg(value * value)), 6) AS rms, round(var_pop(value), 6) AS ampvar FROM events GROUP BY ALL")
def q123_stream_windows(spark, d):
    s = EV.tumbling_features(_stream(spark, d), ["user_id"], "ts", "value", "1 day", ["event_id"], delay="60 days")
    return EV.run_to_end(s, "windows").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", r6("rms").alias("rms"), r6("ampvar").alias("ampvar"))


@query("WITH n AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 43200000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), c AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS cluster FROM n) SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n, round(min(value), 6) AS lowest FROM c GROUP BY user_id, cluster")
def q124_stream_clusters(spark, d):
    s = EV.gap_clusters(_stream(spark, d), ["user_id"], "ts", "value", 43200.0, ["event_id"], delay="60 days")
    times = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("first_ts", "last_ts")]
    return EV.run_to_end(s, "clusters").select("user_id", *times, "n", r6("lowest").alias("lowest"))
