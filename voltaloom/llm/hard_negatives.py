"""Hard negatives of anchors, mined from a forest of vantage-point trees.

Vectors get one more component, the root of the greatest squared norm less their own, so that all have one norm; an anchor is stretched to that norm and gets a zero there. Its
squared distance to a row is then twice the squared norm less twice the stretched score: higher scores are nearer, and a window of scores is an annulus.
A tree over a bounded sample deals all rows, by label, to blocks of about BLOCK rows; each block holds a vantage-point tree of its own with buckets
of LEAF rows. Anchors come in broadcast chunks and pass over the written forest. In a block an anchor visits the buckets nearest first,
leaves out those outside its annulus, and ends where no bucket can hold a better row than its k best so far, which it carries from block to block.
Bounds have a margin for rounding; scores are inner products of whole numbers and exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltaloom.llm.common import materialize, spread_join

#: Rows of the sample that the dealing tree is fit on, and the most leaves it has.
SAMPLE, LEAVES = 4096, 1024
#: Rows of a block and of a bucket in it, about.
BLOCK, LEAF = 2048, 64
#: Anchors of a broadcast chunk.
CHUNK = 4096
#: Squared norms from which inner products would not fit a long.
TOO_LONG = float(1 << 62)


def whole_vectors(embeddings: DataFrame, vec_id: Column, label: Column, vector: Column, scale: float = 256.0) -> DataFrame:
    """(vec_id, label, v): components scaled and rounded down to whole numbers.

    Rows with a null vec_id or label, a null vector, or a null or non-finite component are left out, and so are vectors too long for scores to fit a long.
    """
    x = F.transform(vector, lambda c: F.lit(scale) * c.cast("double"))
    rows = embeddings.select(vec_id.cast("long").alias("vec_id"), label.cast("string").alias("label"), x.alias("x"))
    odd = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= F.lit(float(1 << 31))))
    fit = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()).where(~odd)
    whole = fit.select("vec_id", "label", F.transform("x", lambda c: F.floor(c)).cast("array<long>").alias("v"))
    return whole.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c)).where(F.col("norm2") < TOO_LONG)


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """Rows of an array column; shorter vectors are continued with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(lists.value_lengths())
    flat = np.asarray(lists.flatten())
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def _augmented(v: np.ndarray, most: float) -> np.ndarray:
    x = v.astype(np.float64)
    return np.concatenate([x, np.sqrt(np.maximum(most - (x * x).sum(1), 0))[:, None]], axis=1)


class Tree:
    """A vantage-point tree of a given depth over points; its buckets are runs of `order`."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth, self.order = depth, np.arange(len(points))
        inner = (1 << depth) - 1
        self.vantage, self.middle = np.zeros((inner, points.shape[1])), np.zeros(inner)
        self.interval = np.zeros((inner, 2, 2))  # of a node's inner and outer half: least and greatest distance from its vantage point
        self.bounds = [0, len(points)]
        for level in range(depth):
            bounds = [0]
            for i, (a, b) in enumerate(zip(self.bounds, self.bounds[1:], strict=False)):
                node, part = (1 << level) - 1 + i, self.order[a:b]
                cut = (b - a + 1) // 2
                if b > a:
                    own = points[part]
                    self.vantage[node] = own[np.argmax(((own - own.mean(0)) ** 2).sum(1))]  # an outlying point spreads distances most
                    d = np.sqrt(((own - self.vantage[node]) ** 2).sum(1))
                    by = np.argsort(d, kind="stable")
                    self.order[a:b], d = part[by], d[by]
                    self.middle[node] = d[cut - 1]
                    self.interval[node] = [[d[0], d[cut - 1]], [d[cut], d[-1]] if b - a > cut else [np.inf, np.inf]]
                bounds += [a + cut, b]
            self.bounds = bounds

    def deal(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point, by the middle distances."""
        at = np.zeros(len(points), np.int64)
        for level in range(self.depth):
            node = (1 << level) - 1 + at
            far = np.sqrt(((points - self.vantage[node]) ** 2).sum(1)) > self.middle[node]
            at = 2 * at + far
        return at


class Block:
    """Rows of one label with their tree, ready to be searched."""

    def __init__(self, row: dict, dims: int, most: float):
        self.label = row["label"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.v = np.frombuffer(row["vectors"], np.int32).reshape(-1, dims).astype(exact_type(most))
        self.bounds = np.frombuffer(row["bounds"], np.int64)
        self.vantage = np.frombuffer(row["vantage"], np.float64).reshape(-1, dims + 1)
        self.interval = np.frombuffer(row["intervals"], np.float64).reshape(-1, 2, 2)


def exact_type(most: float):
    """The type whose products and sums are exact while squared norms stay below `most`."""
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object


class Search:
    """The k best rows so far of each query (vector, own id, least and greatest score allowed)."""

    def __init__(self, q: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, most: float):
        self.q, self.own, self.low, self.high, self.k, self.most = q.astype(exact_type(most)), own, low, high, k, most
        x = q.astype(np.float64)
        norm = np.sqrt((x * x).sum(1))
        self.stretch = np.where(norm > 0, np.sqrt(most) / np.maximum(norm, 1e-300), 1.0)  # brings anchors to the rows' norm
        self.x = x * self.stretch[:, None]
        self.norm2 = (self.x * self.x).sum(1)
        self.best = np.full((len(q), k), -np.inf, object if exact_type(most) is object else np.float64)
        self.id = np.full((len(q), k), np.iinfo(np.int64).max)

    def reach(self, block: Block, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, greatest) score that the rows of each bucket can have, by the triangle inequality from the vantage points above it."""
        total = (self.norm2[asked] + self.most)[:, None]
        d = np.sqrt(np.maximum(total - 2 * self.x[asked] @ block.vantage[:, :-1].T, 0))
        near, far = np.zeros((len(asked), 1)), np.full((len(asked), 1), np.inf)
        nodes = len(block.vantage)
        for level in range((nodes + 1).bit_length() - 1):
            at = slice((1 << level) - 1, (1 << (level + 1)) - 1)
            lo, hi, dv = block.interval[at, :, 0][None], block.interval[at, :, 1][None], d[:, at, None]
            near = np.maximum(np.maximum(lo - dv, dv - np.where(np.isinf(hi), 0, hi)), near[:, :, None]).reshape(len(asked), -1)
            far = np.minimum(dv + hi, far[:, :, None]).reshape(len(asked), -1)
        twice = 2 * self.stretch[asked][:, None]
        margin = 1e-9 * total / twice + 1e-3
        return (total - far * far) / twice - margin, (total - near * near) / twice + margin

    def visit(self, block: Block, asked: np.ndarray) -> None:
        """Queries `asked` traverse the block's buckets nearest first, inside their annulus, while a bucket can still hold a better row."""
        least, greatest = self.reach(block, asked)
        greatest = np.where((least > self.high[asked, None]) | (greatest < self.low[asked, None]), -np.inf, np.minimum(greatest, self.high[asked, None] + 1e-3))
        turn = np.argsort(-greatest, axis=1, kind="stable")
        active = np.arange(len(asked))
        for r in range(turn.shape[1]):
            bucket = turn[active, r]
            can = greatest[active, bucket]
            go = np.isfinite(can) & (can >= self.best[asked[active], -1].astype(np.float64) - 1e-3)
            active, bucket = active[go], bucket[go]
            if not len(active):
                return
            by = np.argsort(bucket, kind="stable")
            ends = np.flatnonzero(np.diff(bucket[by])) + 1
            found = [self.scan(block, bucket[part[0]], asked[active[part]]) for part in np.split(by, ends)]
            self.offer(*(np.concatenate(x) for x in zip(*found, strict=True)))

    def scan(self, block: Block, bucket: int, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = slice(block.bounds[bucket], block.bounds[bucket + 1])
        s = self.q[queries] @ block.v[rows].T
        floor = np.maximum(self.low[queries], self.best[queries, -1])[:, None]
        i, j = np.nonzero(((s >= floor) & (s <= self.high[queries][:, None]) & (block.ids[rows] != self.own[queries][:, None])).astype(bool))
        return queries[i], s[i, j], block.ids[rows][j]

    def offer(self, query: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        """Keep each query's k best of what it has and what is offered."""
        if not len(query):
            return
        touched = np.unique(query)
        q = np.concatenate([np.repeat(touched, self.k), query])
        s = np.concatenate([self.best[touched].ravel(), score.astype(self.best.dtype)])
        i = np.concatenate([self.id[touched].ravel(), row])
        by = np.lexsort((i, -s, q)) if s.dtype != object else np.array(sorted(range(len(q)), key=lambda x: (q[x], -s[x], i[x])))
        start = np.searchsorted(q[by], touched)
        kept = by[start[:, None] + np.arange(self.k)]
        self.best[touched], self.id[touched] = s[kept], i[kept]

    def results(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, score, row id) of all that was found."""
        query, place = np.nonzero(self.id != np.iinfo(np.int64).max)
        return query, self.best[query, place].astype(np.int64), self.id[query, place]


def grow_forest(rows: DataFrame, dims: int, most: float, n: int) -> DataFrame:
    """The written forest: one row for each block of rows (vec_id, label, v), each row in exactly one block."""
    spark = rows.sparkSession
    labels = rows.agg(F.approx_count_distinct("label")).first()[0]
    depth = max(0, min(LEAVES, n // (BLOCK * max(1, labels))).bit_length() - 1)
    drawn = rows.select("v", F.xxhash64("vec_id", "label", "v").alias("h")).orderBy("h", "v").limit(SAMPLE).select("v").toArrow()
    top = spark.sparkContext.broadcast(Tree(_augmented(_matrix(drawn["v"], dims), most), depth))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = top.value.deal(_augmented(_matrix(b.column("v"), dims), most))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf)], names=[*b.schema.names, "leaf"])

    dealt = materialize(rows.select("vec_id", "label", "v").mapInArrow(deal, "vec_id long, label string, v array<long>, leaf long"), "negatives-dealt")
    sizes = dealt.groupBy("label", "leaf").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    numbered = spread_join(dealt, sizes, ["label", "leaf"], ["vec_id", "v"]).withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.col("blocks")))

    def build(group: pa.Table) -> pa.Table:
        v = _matrix(group["v"], dims)
        tree = Tree(_augmented(v, most), max(0, (len(v) // LEAF).bit_length() - 1))
        held = {
            "label": group["label"][0].as_py(), "ids": np.asarray(group["vec_id"].combine_chunks())[tree.order].tobytes(), "vectors": v[tree.order].astype(np.int32).tobytes(),
            "bounds": np.asarray(tree.bounds, np.int64).tobytes(), "vantage": tree.vantage.tobytes(), "intervals": tree.interval.tobytes(),
        }
        return pa.table({k: pa.array([x], pa.string() if k == "label" else pa.binary()) for k, x in held.items()})

    blocks = numbered.groupBy("label", "leaf", "block").applyInArrow(build, "label string, ids binary, vectors binary, bounds binary, vantage binary, intervals binary")
    return materialize(blocks.repartition(max(1, min(n // BLOCK, 3 * spark.sparkContext.defaultParallelism))), "negatives-forest")


def _search_forest(forest: DataFrame, queries: DataFrame, n: int, k: int, same_label: bool, dims: int, most: float) -> DataFrame:
    """(query, s, row): of each query (query, anchor_id, label, v, low, high, chunk) the k best rows of each task; chunks 0 to n - 1 pass one by one."""
    spark, found = forest.sparkSession, None
    for c in range(n):
        held = queries.where(F.col("chunk") == c).select("query", "anchor_id", "label", "v", "low", "high").toArrow()
        chunk = spark.sparkContext.broadcast({x: _matrix(held[x], dims) if x == "v" else held[x].combine_chunks().to_numpy(zero_copy_only=False) for x in held.column_names})

        def search(batches: Iterator[pa.RecordBatch], chunk=chunk) -> Iterator[pa.RecordBatch]:
            q = chunk.value
            state = Search(q["v"], q["anchor_id"], q["low"], q["high"], k, most)
            for b in batches:
                for row in b.to_pylist():
                    asked = np.flatnonzero((q["label"] == row["label"]) == same_label)
                    if len(asked):
                        state.visit(Block(row, dims, most), asked)
            at, score, ids = state.results()
            yield pa.RecordBatch.from_arrays([pa.array(q["query"][at], pa.string()), pa.array(score, pa.int64()), pa.array(ids, pa.int64())], names=["query", "s", "row"])

        part = forest.mapInArrow(search, "query string, s long, row long")
        part = part.groupBy("query").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("s")).alias("o"), "row"))), 1, k).alias("best"))
        part = materialize(part.select("query", F.posexplode("best").alias("place", "b")).select("query", (F.col("place") + 1).alias("rank"), F.col("b.row").alias("row"), (-F.col("b.o")).alias("s")), "negatives-found")
        found = part if found is None else found.unionByName(part)
    return found


def mine_hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low_percent: int = 50, high_percent: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score over rows of whole_vectors.

    An anchor's positives are its best `positives` rows of the same label and another vec_id; for each, its best `negatives` rows of a different label whose
    score is between low_percent and high_percent of the positive's, both included. Higher scores come first, ties by smaller vec_id. Shorter vectors are
    continued with zeros. Rows that repeat a vec_id count each, but never as positives of that vec_id; a repeated anchor row gives its rows once. Without rows or anchors
    there are no rows; an anchor without positives or negatives gives none.
    """
    rows = materialize(rows, "negatives-rows")
    n, most, dims = rows.agg(F.count("*"), F.max("norm2"), F.max(F.size("v"))).first()
    most, dims = float(most or 0), max(1, dims or 0)
    forest = grow_forest(rows, dims, most, n)
    anchors = rows.where(is_anchor).select("vec_id", "label", "v").distinct().select(F.col("vec_id").alias("anchor_id"), "label", "v", F.sha2(F.to_json(F.struct("vec_id", "label", "v")), 256).alias("anchor"))
    anchors = materialize(anchors, "negatives-anchors")
    chunks = anchors.count() // CHUNK + 1
    anchors = anchors.withColumn("chunk", F.pmod(F.xxhash64("anchor"), F.lit(chunks)))
    edge = float(1 << 62)
    asked = anchors.select(F.col("anchor").alias("query"), "anchor_id", "label", "v", F.lit(-edge).alias("low"), F.lit(edge).alias("high"), "chunk")
    best = _search_forest(forest, asked, chunks, positives, True, dims, most)
    pairs = anchors.join(best.select(F.col("query").alias("anchor"), F.col("rank").alias("place"), F.col("row").alias("positive_id"), F.col("s").alias("positive_score")), "anchor")
    rest = F.pmod("positive_score", F.lit(100))  # hundredths apart, as products of whole scores may not fit a long
    whole = F.expr("(positive_score - pmod(positive_score, 100L)) div 100L")
    pairs = pairs.withColumn("low", whole * low_percent + F.ceil(rest * low_percent / 100)).withColumn("high", whole * high_percent + F.floor(rest * high_percent / 100))
    pairs = materialize(pairs.withColumn("query", F.concat_ws("/", "anchor", "place")), "negatives-pairs")
    mined = _search_forest(forest, pairs.where("low <= high"), chunks, negatives, False, dims, most)
    return mined.join(pairs.select("query", "anchor_id", "positive_id", "positive_score"), "query").select("anchor_id", "positive_id", "rank", F.col("row").alias("negative_id"), "positive_score", F.col("s").alias("negative_score"))
