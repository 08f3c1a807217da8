"""What the operators share: stage outputs in the shared folder, word hashing, connected components."""

from __future__ import annotations

import gc
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six white-space bytes that part words: space and 0x09 to 0x0D.
WORD_SPACE = " \t\n\x0b\f\r"
#: Keys with more rows than this, and more than this part of all, are dealt over several tasks in joins.
HOT = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session has one of its own; a cluster must set it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (found or f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}").rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back.

    A lost executor later costs a re-read, not a re-run. Earlier shuffle files become garbage, which is
    collected at once so that disk use follows what is still needed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/voltaloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def small(batches, rows: int = 256):
    """The batches in slices, so that what Python holds of texts at once stays small."""
    for batch in batches:
        for lo in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(lo, rows)


class HashCache(dict):
    """Word (bytes) to a 64-bit hash; holds at most `limit` words, so memory stays bounded."""

    def __init__(self, limit: int = 1 << 17):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.limit:
            self[word] = h
        return h


def hash_words(words: list[bytes], cache: HashCache) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def ngram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k word hashes, in order; fewer than k words give none."""
    n = len(h) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[i : i + n]
    return mix64(out)


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], by: list[str], how: str = "inner") -> DataFrame:
    """many joined with one, which has a row a key at most, where few keys may hold most rows of many.

    Rows of a hot key, one with more than HOT rows and more than a share of 1 / HOT of all, are dealt over parts by a hash of the columns `by`;
    its row of `one` is repeated for each part. There are fewer than HOT such keys, so their list is broadcast. Rows without key are dealt likewise.
    many should be a written table: it is counted first.
    """
    rows = many.count()
    if rows <= HOT:
        return many.join(one, keys, how)
    most = max(HOT, rows // HOT)
    hot = many.groupBy(*keys).agg(F.count("*").alias("parts")).where(F.col("parts") > most).select(*keys, F.ceil(4 * F.col("parts") / most).alias("parts"))
    hot = materialize(hot.dropna(subset=keys), "hot-keys")
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    hashed = F.xxhash64(F.lit(7), *by)
    dealt = many.join(F.broadcast(hot), keys, "left").withColumn("part", F.when(known, F.pmod(hashed, F.coalesce("parts", F.lit(1)))).otherwise(F.pmod(hashed, F.lit(4 * HOT)))).drop("parts")
    repeated = one.join(F.broadcast(hot), keys, "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.join(repeated, [*keys, "part"], how).drop("part")


def components(edges: DataFrame, name: str) -> DataFrame:
    """(id, component_id) of every node of edges (a, b): component_id is the smallest id that links reach.

    Minimum labels along edges, with pointer jumping, so the rounds grow with the logarithm of the
    diameter. Joins deal the edges of a hub and the nodes of a giant component over tasks; aggregates are partial first.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("c")), f"{name}-labels")
    while True:
        seen = spread_join(both, labels.select(F.col("id").alias("b"), "c"), ["b"], ["a"]).groupBy(F.col("a").alias("id")).agg(F.min("c").alias("m"))
        step = materialize(labels.join(seen, "id").select("id", F.least("c", "m").alias("n"), "c"), f"{name}-step")
        jump = step.select(F.col("id").alias("n"), F.col("n").alias("p"))
        after = materialize(spread_join(step, jump, ["n"], ["id"]).select("id", F.least("n", "p").alias("n"), "c"), f"{name}-labels")
        moved = after.where("n <> c").limit(1).count()
        labels = after.select("id", F.col("n").alias("c"))
        if not moved:
            return labels.withColumnRenamed("c", "component_id")
