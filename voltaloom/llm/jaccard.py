"""Exact n-gram Jaccard self-join by adaptive multi-match prefixes, and the duplicate classes it gives.

A document's tokens (hashes of its distinct word shingles) are put in one global order: first those not
known as frequent, by hash, then frequent ones by their count. Two sets with Jaccard similarity t or more share, for every l,
at least l tokens among the first n - ceil(t n) + l of either. A prefix starts with l = 1; where frequent tokens
cannot be kept out of it, the estimated number of candidates sets a larger l, and a pair with prefixes of l1 and l2
must share min(l1, l2) tokens before it is verified. No l exceeds ceil(t n), the fewest tokens that a set of n shares with any
set it links with, so short texts that share all they can always pass.

* Equal sets are one node from the start, whatever their doc_ids, so groups of exact copies never form pairs and two texts of one doc_id stay apart.
* Buckets (prefix tokens of two nodes or more) of up to SMALL nodes form pairs in a join; larger ones are searched by
  breadth-first search over parity bitmaps in blocks, which emits a spanning forest rather than all pairs.
* A parity bitmap gives a lower bound of the symmetric difference; pairs that it cannot rule out are verified on
  the texts. A first round verifies one edge a node, a second all remaining pairs between different
  components, so every link between different components is found.

Hash collisions: tokens are 64-bit; a wrong verdict needs a collision inside one pair of sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltaloom.llm.common import HashCache, components, hash_words, materialize, ngram_hashes, small, spread_join

#: Buckets of up to so many nodes form pairs by a join.
SMALL = 32
#: Rows of one block of a large bucket; a bucket of more is searched block against block.
BLOCK = 4096
#: Entries of the table of frequent tokens at most (16 bytes each), whatever the size of the corpus.
MAX_FREQUENT = 1 << 17
#: Candidates that a document may cost before its prefix is lengthened, and the longest extension.
CHEAP, MAX_EXTRA = 64, 16


def shingle_set(text: bytes | None, k: int, cache: HashCache) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words give the whole sequence as one; no word gives none."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = hash_words(words, cache)
    return np.unique(ngram_hashes(h, min(k, len(words))) + np.uint64(min(k, len(words)) % k))


def _texts(batch: pa.RecordBatch):
    for b in small([batch]):
        yield from b.column("text").cast(pa.binary()).to_pylist()


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), _signed(values.astype(np.uint64)))


def _survey(k: int):
    """First pass: size and 128-bit digest of every set; tokens that are frequent among the documents at hand, with counts."""

    def run(batches):
        cache = HashCache()
        for batch in batches:
            ids, n, d1, d2, held, size, seen = batch.column("doc_id"), [], [], [], [], 0, set()
            freq: list[tuple[np.ndarray, np.ndarray]] = []

            def flush():
                t, c = np.unique(np.concatenate(held), return_counts=True)
                freq.append((t[c >= 3], c[c >= 3]))
                held.clear()

            for text in _texts(batch):
                s = shingle_set(text, k, cache)
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                n.append(len(s))
                d1.append(d >> 64)
                d2.append(d & (1 << 64) - 1)
                if len(s) and d not in seen:
                    seen.add(d)
                    held.append(s)
                    size += len(s)
                    if size > 2_000_000:
                        flush()
                        size = 0
            if held:
                flush()
            rows = len(n)
            empty = [np.empty(0, np.uint64)] * rows
            cols = [ids, batch.column("key"), pa.array(n, pa.int64()), _signed(np.array(d1, np.uint64)), _signed(np.array(d2, np.uint64)), _lists(empty), _lists(empty)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "key", "n", "d1", "d2", "tok", "cnt"])
            if freq:
                none = pa.nulls(len(freq), pa.int64())
                cols = [none] * 5 + [_lists([t for t, _ in freq]), _lists([c.astype(np.uint64) for _, c in freq])]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "key", "n", "d1", "d2", "tok", "cnt"])

    return run


def bitmap(s: np.ndarray) -> bytes:
    """Parity of the number of tokens in each of m cells; m is the least power of two from 2n on, 2048 at least: few false survivors among short texts."""
    m = 2048
    while m < 2 * len(s):
        m *= 2
    cell = ((s >> np.uint64(17)) & np.uint64(m - 1)).astype(np.int64)
    return np.packbits((np.bincount(cell, minlength=m) & 1).astype(np.uint8), bitorder="little").tobytes()


def _fold(rows: np.ndarray) -> np.ndarray:
    half = rows.shape[1] // 2
    return rows[:, :half] ^ rows[:, half:]


def _prefixes(k: int, percent: int, frequent):
    """Second pass: prefix, l and bitmap of every set."""

    def run(batches):
        cache, (common, counts) = HashCache(), frequent.value
        for batch in small(batches):
            ids, n, l, d1, d2, pre, sig = batch.column("doc_id").to_pylist(), [], [], [], [], [], []
            at = []
            for row, text in enumerate(_texts(batch)):
                s = shingle_set(text, k, cache)
                if not len(s) or ids[row] is None:
                    continue
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                first = len(s) - -(-percent * len(s) // 100) + 1
                extra, p = 0, s[:first]
                if len(common):
                    place = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    hot = common[place] == s
                    if hot[:first].any():
                        cold = s[~hot]
                        if len(cold) < first:
                            heat = counts[place[hot]]
                            order = np.argsort(heat, kind="stable")
                            cost = int(heat[order][: first - len(cold)].sum())
                            extra = min(MAX_EXTRA, int(np.log2(1 + cost / CHEAP)), -(-percent * len(s) // 100) - 1)
                            p = np.concatenate([cold, s[hot][order]])[: first + extra]
                        else:
                            p = cold[:first]
                at.append(ids[row])
                n.append(len(s))
                l.append(1 + extra)
                d1.append(d >> 64)
                d2.append(d & (1 << 64) - 1)
                pre.append(p)
                sig.append(bitmap(s))
            cols = [pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(l, pa.int32()), _signed(np.array(d1, np.uint64)), _signed(np.array(d2, np.uint64)), _lists(pre), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "l", "d1", "d2", "pre", "sig"])

    return run


def _may_link(na: int, nb: int, differ: int, percent: int) -> bool:
    """Whether sets of these sizes can reach percent if their symmetric difference is `differ` or more."""
    return (100 + percent) * differ <= (100 - percent) * (na + nb)


def _bitmap_filter(percent: int):
    """Rows (a, b, na, nb, sa, sb) to those (a, b) that the bitmaps cannot rule out."""

    def run(batches):
        for batch in batches:
            c = {x: batch.column(x).to_pylist() for x in ("a", "b", "na", "nb", "sa", "sb")}
            left, right = [], []
            for a, b, na, nb, sa, sb in zip(*c.values(), strict=True):
                x, y = np.frombuffer(sa, np.uint64)[None], np.frombuffer(sb, np.uint64)[None]
                while x.shape[1] > y.shape[1]:
                    x = _fold(x)
                while y.shape[1] > x.shape[1]:
                    y = _fold(y)
                if _may_link(na, nb, int(np.bitwise_count(x ^ y).sum()), percent):
                    left.append(a)
                    right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return run


class _Bucket:
    """Rows of one bucket (or of two blocks of it), bitmaps stacked by their size."""

    def __init__(self, rows: list[tuple], percent: int):
        self.percent = percent
        self.groups = {}
        by = {}
        for i, n, comp, sig in rows:
            by.setdefault(len(sig) // 8, []).append((i, n, comp, sig))
        for w, got in by.items():
            got.sort(key=lambda x: x[0])
            m = np.frombuffer(b"".join(x[3] for x in got), np.uint64).reshape(len(got), w)
            self.groups[w] = [np.array([x[0] for x in got]), np.array([x[1] for x in got]), np.array([x[2] for x in got]), m, _fold(m) if w > 1 else None]

    def near(self, w: int, r: int, live: dict[int, np.ndarray]):
        """(size, places) of live rows that may link with row r of size w."""
        _, n, _, m, half = self.groups[w]
        for v in (w // 2, w, 2 * w):
            if v not in self.groups or not v:
                continue
            at = np.nonzero(live[v])[0]
            if not len(at):
                continue
            g = self.groups[v]
            x, y = (m[r], g[3][at]) if v == w else (half[r], g[3][at]) if v < w else (m[r], g[4][at])
            differ = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
            total = g[1][at] + n[r]
            ok = ((100 + self.percent) * differ <= (100 - self.percent) * total) & (100 * np.minimum(g[1][at], n[r]) >= self.percent * np.maximum(g[1][at], n[r]))
            if ok.any():
                yield v, at[ok]

    def forest(self):
        """Edges of a spanning forest of the graph of pairs that may link."""
        live = {w: np.ones(len(g[0]), bool) for w, g in self.groups.items()}
        for w, g in self.groups.items():
            for r in range(len(g[0])):
                if not live[w][r]:
                    continue
                live[w][r] = False
                queue = [(w, r)]
                while queue:
                    u, i = queue.pop()
                    for v, at in self.near(u, i, live):
                        live[v][at] = False
                        a = int(self.groups[u][0][i])
                        for j in at.tolist():
                            queue.append((v, j))
                            yield a, int(self.groups[v][0][j])

    def across(self):
        """All pairs between different components that may link."""
        every = {w: np.ones(len(g[0]), bool) for w, g in self.groups.items()}
        for w, g in self.groups.items():
            for r in range(len(g[0])):
                a, comp = int(g[0][r]), g[2][r]
                for v, at in self.near(w, r, every):
                    h = self.groups[v]
                    for b in h[0][at[(h[2][at] != comp) & (h[0][at] > a)]].tolist():
                        yield a, int(b)


def _search(percent: int, across: bool):
    """Rows (cell, id, n, comp, sig), a cell's rows adjacent, to candidate pairs (a, b), a < b."""

    def pairs(rows):
        b = _Bucket(rows, percent)
        return {(min(p), max(p)) for p in (b.across() if across else b.forest()) if p[0] != p[1]}

    def run(batches):
        now, rows = None, []

        def out():
            found = pairs(rows) if len(rows) > 1 else ()
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], ["a", "b"])

        for batch in batches:
            for cell, *row in zip(*(batch.column(x).to_pylist() for x in ("cell", "id", "n", "comp", "sig")), strict=True):
                if cell != now:
                    if rows:
                        yield out()
                    now, rows = cell, []
                rows.append(row)
        if rows:
            yield out()

    return run


def _verify(k: int, percent: int):
    def run(batches):
        cache = HashCache()
        for batch in small(batches):
            left, right, last, sa = [], [], None, None
            for a, b, ta, tb in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("ta").cast(pa.binary()).to_pylist(), batch.column("tb").cast(pa.binary()).to_pylist(), strict=True):
                if ta != last:
                    last, sa = ta, shingle_set(ta, k, cache)
                sb = shingle_set(tb, k, cache)
                both = len(np.intersect1d(sa, sb, assume_unique=True))
                if both and 100 * both >= percent * (len(sa) + len(sb) - both):
                    left.append(a)
                    right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose texts link; reps (id, rep, rep_key) tells a node's text. Texts of candidates only travel past the first join."""
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    named = reps.join(wanted, "id", "left_semi").select("id", F.col("rep").alias("doc_id"), F.col("rep_key").alias("key"))
    t = texts.join(named, ["doc_id", "key"]).select("id", "text").dropDuplicates(["id"])
    joined = pairs.join(t.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(t.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return joined.select("a", "b", "ta", "tb").mapInArrow(_verify(k, percent), "a long, b long").distinct()


def _cells(rows: DataFrame) -> DataFrame:
    """A cell for each bucket; buckets of more than 2 BLOCK rows get a cell for each pair of blocks."""
    k = F.ceil(F.col("c") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("id"), k).cast("int")
    many = F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.xxhash64("tok", F.least(j, mine), F.greatest(j, mine)))
    cut = rows.withColumn("cell", F.explode(F.when(F.col("c") > 2 * BLOCK, many).otherwise(F.array("tok"))))
    return cut.select("cell", "id", "n", "comp", "sig").repartition("cell").sortWithinPartitions("cell")


def jaccard_classes(documents: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of documents (doc_id, text): doc_id, n_shingles, component_id, text_key (xxhash64 of the text), head_key.

    Words are runs of bytes other than space and 0x09-0x0D, A-Z lower-cased. Documents link when 100 |A & B| >= percent |A | B|.
    Null and empty texts, or texts of white space: n_shingles 0, linked with nothing, component_id their own doc_id.
    Rows without doc_id: component_id null, and they link with nothing. Repeated doc_ids: a row's class is that of its own text, so rows of one doc_id can be
    in different classes. component_id is the smallest doc_id of a class and head_key the text_key of one row that has it, the same for the whole class.
    percent is 50 at least: the search of large buckets compares sets of up to twice the size.
    """
    if percent < 50:
        raise ValueError("percent must be 50 or more")
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64("text"))
    survey = materialize(texts.mapInArrow(_survey(shingle), "doc_id long, key long, n long, d1 long, d2 long, tok array<long>, cnt array<long>"), "jac-survey")
    sizes = survey.where("n is not null")
    counted = survey.where("n is null").select(F.explode(F.arrays_zip("tok", "cnt")).alias("x")).groupBy(F.col("x.tok").alias("tok")).agg(F.sum("x.cnt").alias("df"))
    least = max(CHEAP, -(-(counted.agg(F.sum("df")).first()[0] or 0) // MAX_FREQUENT))  # so the table has MAX_FREQUENT entries at most
    top = sorted((int(r.tok) & (1 << 64) - 1, r.df) for r in counted.where(F.col("df") >= least).collect())
    frequent = spark.sparkContext.broadcast((np.array([x[0] for x in top], np.uint64), np.array([x[1] for x in top], np.int64)))

    sets = sizes.where("n > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.min_by("key", "doc_id").alias("rep_key"))
    reps = materialize(sets.withColumn("id", F.monotonically_increasing_id()), "jac-sets")  # numbers of nodes, fixed by being written
    kept = texts.mapInArrow(_prefixes(shingle, percent, frequent), "doc_id long, n long, l int, d1 long, d2 long, pre array<long>, sig binary")
    nodes = materialize(kept.join(reps.select("d1", "d2", F.col("rep").alias("doc_id"), "id"), ["d1", "d2", "doc_id"]).select("id", "n", "l", "pre", "sig"), "jac-nodes")
    if nodes.count() > reps.count():  # rows that repeat doc_id and set
        nodes = materialize(nodes.dropDuplicates(["id"]), "jac-nodes")
    entries = nodes.select(F.explode("pre").alias("tok"), "id", "n", "l")
    shared = nodes.select(F.explode("pre").alias("tok")).groupBy("tok").agg(F.count("*").alias("c")).where("c > 1")
    buckets = materialize(entries.join(shared, "tok"), "jac-buckets")

    large = buckets.where(F.col("c") > SMALL)
    n_large = large.groupBy("id").agg(F.count("*").alias("h"))
    small = buckets.where(F.col("c") <= SMALL).join(n_large, "id", "left").select("tok", "id", "n", "l", F.coalesce("h", F.lit(0)).alias("h"))
    x = small.select("tok", *(F.col(c).alias(f"{c}a") for c in ("id", "n", "l", "h")))
    y = small.select("tok", *(F.col(c).alias(f"{c}b") for c in ("id", "n", "l", "h")))
    near = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (F.col("ida") < F.col("idb"))
    met = x.join(y, "tok").where(near).groupBy(F.col("ida").alias("a"), F.col("idb").alias("b")).agg(F.count("*").alias("m"), F.max(F.least("la", "lb")).alias("need"), F.max(F.least("ha", "hb")).alias("more"))
    met = met.where("m + more >= need").select("a", "b")  # tokens in large buckets can add `more` matches
    sigs = nodes.select("id", "n", "sig")
    sided = met.join(sigs.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb")), "b")
    small_pairs = materialize(sided.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_bitmap_filter(percent), "a long, b long").distinct(), "jac-small")

    big = materialize(large.select("tok", "id", "n", "c").join(sigs.select("id", "sig"), "id"), "jac-large")
    forest = _cells(big.withColumn("comp", F.col("id"))).mapInArrow(_search(percent, False), "a long, b long").distinct()
    first = small_pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").union(forest).distinct()
    tried = materialize(first, "jac-first")
    links = materialize(verified(tried, texts, reps, shingle, percent), "jac-links")
    comp = components(links, "jac-1")

    label = lambda side: comp.select(F.col("id").alias(side), F.col("component_id").alias(f"c{side}"))
    rest_small = small_pairs.join(label("a"), "a", "left").join(label("b"), "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")
    labelled = big.join(comp.withColumnRenamed("component_id", "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    mixed = labelled.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("tok")
    rest_large = _cells(labelled.join(mixed, "tok", "left_semi")).mapInArrow(_search(percent, True), "a long, b long")
    rest = materialize(rest_small.union(rest_large).distinct().join(tried, ["a", "b"], "left_anti"), "jac-rest")
    if rest.limit(1).count():
        comp = components(links.union(materialize(verified(rest, texts, reps, shingle, percent), "jac-more")), "jac-2")

    linked = materialize(reps.join(comp, "id"), "jac-linked")
    heads = linked.groupBy("component_id").agg(F.min("rep").alias("head_id"), F.min_by("rep_key", "rep").alias("head_key"))
    named = materialize(spread_join(linked, heads, ["component_id"], ["id"]).select("id", "head_id", "head_key"), "jac-heads")
    all_sets = reps.join(named, "id", "left").select("d1", "d2", F.coalesce("head_id", "rep").alias("component_id"), F.coalesce("head_key", "rep_key").alias("head_key"))
    placed = spread_join(sizes.where("n > 0 and doc_id is not null"), all_sets, ["d1", "d2"], ["doc_id"], "left").select("doc_id", "n", "key", "component_id", "head_key")
    alone = sizes.where("n = 0 or doc_id is null").select("doc_id", "n", "key", F.col("doc_id").alias("component_id"), F.col("key").alias("head_key"))
    return placed.union(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("key").alias("text_key"), "head_key")


def one_per_class(documents: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One document of each class stays: that of its smallest doc_id, and where several of its texts have this doc_id, one of them.

    Rows that repeat both doc_id and text are one document and share its fate; rows without doc_id or without words stay.
    """
    classes = jaccard_classes(documents, shingle, percent)
    gone = classes.where("doc_id <> component_id or text_key <> head_key").select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct()
    gone = materialize(gone, "jac-gone")
    return documents.join(gone, (documents["doc_id"].cast("long") == gone["gone_id"]) & (F.xxhash64(documents["text"].cast("string")) == gone["gone_key"]), "left_anti")
