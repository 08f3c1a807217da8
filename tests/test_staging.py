import json

import pytest
from pyspark.sql import functions as F

from voltaloom.staging import staged


class Work:
    """Doubles values and counts the keys that it is asked for."""

    def __init__(self, data):
        self.data, self.asked = data, []

    def __call__(self, keys):
        self.asked.append(sorted(r[0] for r in keys.collect()))
        return self.data.join(keys, "animalday").select("animalday", (F.col("v") * 2).alias("v"))


def files(spark, changes=None, sessions="abcd"):
    rows = [(s, f"{s}/{i}", 100 + (changes or {}).get(s, 0)) for s in sessions for i in range(2)]
    return spark.createDataFrame(rows, "animalday string, path string, length long")


@pytest.fixture()
def data(spark):
    return spark.createDataFrame([(s, i) for s in "abce" for i in range(3)], "animalday string, v int")


def values(df):
    return sorted((r.animalday, r.v) for r in df.collect())


def run(folder, sources, work, **params):
    done = len(work.asked)
    out = values(staged(folder, sources, "animalday", ["path", "length"], work, params))
    return out, [a for a in work.asked[done:] if a]


def test_only_what_changed_is_computed(spark, data, tmp_path):
    folder, work = f"file://{tmp_path}/s", Work(data)
    everything = [(s, 2 * i) for s in "abc" for i in range(3)]
    assert run(folder, files(spark), work) == (everything, [list("abcd")])
    assert run(folder, files(spark), work) == (everything, [])
    assert run(folder, files(spark, {"b": 1}), work) == (everything, [["b"]])
    assert run(folder, files(spark, {"b": 1}), work, z=3) == (everything, [list("abcd")])  # another parameter
    assert run(folder, files(spark, {"b": 1}, "ac"), work, z=3) == ([x for x in everything if x[0] != "b"], [])  # gone keys have no rows
    assert run(folder, files(spark, {"b": 1}, "abe"), work, z=3)[1] == [["b", "e"]]


def test_a_run_that_fails_leaves_nothing_visible(spark, data, tmp_path):
    folder, work = f"file://{tmp_path}/s", Work(data)
    first, _ = run(folder, files(spark), work)

    def broken(keys):
        out = work(keys)
        return out.withColumn("v", F.when(F.col("v") == 4, F.raise_error(F.lit("killed")).cast("int")).otherwise(F.col("v")))

    with pytest.raises(Exception, match="killed"):
        staged(folder, files(spark, {"a": 5}), "animalday", ["path", "length"], broken).count()
    assert run(folder, files(spark), work) == (first, [])
    assert run(folder, files(spark, {"a": 5}), work) == (first, [["a"]])


def test_rows_that_are_gone_do_not_come_back(spark, data, tmp_path):
    folder = f"file://{tmp_path}/s"
    run(folder, files(spark), Work(data))
    less = Work(data.where("animalday <> 'b'"))
    assert [x for x in run(folder, files(spark, {"b": 1}), less)[0] if x[0] == "b"] == []
    manifest = spark.read.parquet(f"{folder}/manifest")
    assert json.loads(json.dumps(sorted(r[0] for r in manifest.select("key").distinct().collect()))) == list("abcd")
