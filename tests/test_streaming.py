import random

import pytest
from pyspark.sql import functions as F

from voltaloom.streaming import events as EV

SCHEMA = "id long, animal string, ts timestamp, value double"


@pytest.fixture(scope="module")
def arrived(spark, tmp_path_factory):
    """Files in which rows come out of order, a few days late, and again; every day's events of an animal, a hot one among them."""
    rng = random.Random(2)
    rows = [(i, rng.choice("aaaab"), rng.randrange(30 * 86400), rng.gauss(0, 9)) for i in range(1500)]
    rows.sort(key=lambda r: r[2] + rng.randrange(2 * 86400))
    parts = [rows[k * 300 : (k + 1) * 300] for k in range(5)]
    parts = [p + rng.sample(parts[max(0, k - 1)], 40) for k, p in enumerate(parts)]
    folder = tmp_path_factory.mktemp("arrived")
    for k, part in enumerate(parts):
        df = spark.createDataFrame(part, "id long, animal string, s long, value double")
        df.select("id", "animal", F.timestamp_seconds(F.col("s") + 1_704_067_200).alias("ts"), "value").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return f"{folder}/in"


def frames(spark, arrived):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(arrived), spark.read.schema(SCHEMA).parquet(arrived)


def as_rows(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_windows_of_stream_and_table_agree(spark, arrived):
    stream, batch = frames(spark, arrived)
    how = (["animal"], "ts", "value", "6 hours", ["id"], "40 days")
    want = as_rows(EV.tumbling_features(batch, *how))
    assert as_rows(EV.run_to_end(EV.tumbling_features(stream, *how), "t")) == want and sum(r[3] for r in want) == 1500


def test_clusters_of_stream_and_table_agree(spark, arrived):
    stream, batch = frames(spark, arrived)
    how = (["animal"], "ts", "value", 7200.0, ["id"], "40 days")
    want = as_rows(EV.gap_clusters(batch, *how))
    assert as_rows(EV.run_to_end(EV.gap_clusters(stream, *how), "c")) == want
    plain = {}
    for r in batch.dropDuplicates(["id"]).select("animal", F.unix_seconds("ts").alias("s")).orderBy("animal", "s").collect():
        runs = plain.setdefault(r.animal, [])
        if runs and r.s - runs[-1][-1] <= 7200:
            runs[-1].append(r.s)
        else:
            runs.append([r.s])
    assert sorted((a, len(x)) for a, runs in plain.items() for x in runs) == sorted((r[0], r[3]) for r in want)


def test_a_gap_of_just_the_limit_is_none(spark):
    rows = [(1, "a", 0), (2, "a", 10), (3, "a", 20), (4, "a", 31)]
    df = spark.createDataFrame(rows, "id long, animal string, s long").select("id", "animal", F.timestamp_seconds("s").alias("ts"), F.lit(1.0).alias("value"))
    assert sorted(r.n for r in EV.gap_clusters(df, ["animal"], "ts", "value", 10.0, ["id"]).collect()) == [1, 3]


def test_an_empty_source_gives_an_empty_table(spark, tmp_path):
    (tmp_path / "none").mkdir()
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "none"))
    assert EV.run_to_end(EV.tumbling_features(stream, ["animal"], "ts", "value", "1 day", ["id"]), "e").count() == 0
