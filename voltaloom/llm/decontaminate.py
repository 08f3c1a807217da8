"""Benchmark decontamination: groups of rare words seed places, Smith-Waterman alignment of words scores them.

Test items are the query set: they are collected in blocks of at most BLOCK_CHARS characters, which bounds what the workers hold, and
all documents are run against each block. An alignment that reaches the threshold matches at least that share of an item's words and spans
a bounded number of words. Of any chosen words of an item, then, all but the unmatched ones stand near each other in the document: an item's seed is `need` of its
`rare` words, in any order and with any gaps, within that span. Whatever was replaced, inserted, cut or swapped, a seed is left, so no alignment is missed. Which
words are taken as rare, those of the fewest items, decides the cost only. Around a seed two bounds of the score are taken: words inside an alignment match the item or
cost a point, and no word matches more often than both hold it. Where a bound stays below the threshold nothing is aligned; elsewhere the item is aligned with the words around.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltaloom.llm.common import small

#: Words that an item has at least; words below which it must stand whole; characters of a block of items.
LEAST_WORDS, SHORT, BLOCK_CHARS = 4, 8, 8_000_000
#: Words of a seed, as a share of an item's words.
SPARE = 0.2
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of the best possible score from which a document counts as contaminated.
THRESHOLD = 0.5

_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def align(item: np.ndarray, window: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment score, as a share of the item's own, and the first and last place in window."""
    n, above, start = len(window), np.zeros(len(window) + 1, np.int64), np.arange(len(window) + 1)
    best, span = 0, (0, 0)
    slope = GAP * np.arange(n + 1)
    for w in item:
        diag = above[:-1] + np.where(window == w, MATCH, MISMATCH)
        cells = np.zeros(n + 1, np.int64)
        cells[1:] = np.maximum(diag, above[1:] + GAP)
        np.maximum(cells, 0, out=cells)
        src = start.copy()
        src[1:] = np.where(cells[1:] == 0, np.arange(1, n + 1), np.where(cells[1:] == diag, start[:-1], start[1:]))
        lifted = cells - slope
        run = np.maximum.accumulate(lifted)
        at = np.maximum.accumulate(np.where(lifted == run, np.arange(n + 1), 0))
        above = run + slope
        start = np.where(above == cells, src, src[at])
        top = int(above.argmax())
        if above[top] > best:
            best, span = int(above[top]), (int(start[top]), top - 1)
    return best / (MATCH * max(1, len(item))), *span


class Items:
    """One block of items: their words' numbers, and for each rare word the items that it seeds."""

    def __init__(self, rows: list[tuple[int, str]], threshold: float = THRESHOLD):
        self.words, self.vocabulary = {}, {}
        for item, text in rows:
            w = words_of(text)
            if len(w) >= LEAST_WORDS:
                self.words[item] = np.array([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w], np.uint64)
        self.counts = {item: Counter(h.tolist()) for item, h in self.words.items()}
        self.distinct = {item: np.unique(h) for item, h in self.words.items()}
        self.ids = np.array(sorted(self.words), np.int64)
        self.threshold, self.need, self.span = {}, np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), np.int64)
        inside = Counter(x for c in self.counts.values() for x in c)
        seeds: list[tuple[int, int]] = []
        for k, item in enumerate(self.ids.tolist()):
            w = self.words[item].tolist()
            least = self.threshold[item] = max(threshold, 1.0) if len(w) < SHORT else threshold
            matched = max(1, int(np.ceil(least * len(w) - 1e-9)))  # words that an alignment at the threshold matches at least
            self.need[k] = min(matched, max(1, int(SPARE * len(w))))
            self.span[k] = len(w) + int((MATCH * (1 - least) * len(w)) // -GAP)  # and the words that it spans at most
            rare = sorted(w, key=lambda x: (inside[x], x))[: len(w) - matched + int(self.need[k])]
            seeds += [(x, k) for x in set(rare)]
        seeds.sort()
        self.seeded = np.array([k for _, k in seeds], np.int64)
        self.first = np.searchsorted(np.array([x for x, _ in seeds], np.int64), np.arange(len(self.vocabulary) + 2))

    def numbers(self, words: list[str]) -> np.ndarray:
        """Each word's number in the block's vocabulary; 0, which no item holds, for all others."""
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.uint64, len(words))

    def regions(self, h: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, from, to) of all places of h in which an alignment at the threshold can lie; those of an item do not overlap."""
        at = np.flatnonzero(h)
        v = h[at].astype(np.int64)
        many = self.first[v + 1] - self.first[v]
        total = int(many.sum())
        if not total:
            return []
        items = self.seeded[np.arange(total) - np.repeat(np.cumsum(many) - many - self.first[v], many)]
        key = np.sort((items << 32) | np.repeat(at, many))
        items, places = key >> 32, key & 0xFFFFFFFF
        end = np.arange(total) + self.need[items] - 1
        inside = np.flatnonzero(end < total)
        begin, end = inside, end[inside]
        near = (items[end] == items[begin]) & (places[end] - places[begin] < self.span[items[begin]])
        begin, end = begin[near], end[near]
        out: list[tuple[int, int, int]] = []
        for k, a, b, span in zip(items[begin].tolist(), places[begin].tolist(), places[end].tolist(), self.span[items[begin]].tolist(), strict=True):
            lo, hi = max(0, b - span + 1), min(len(h), a + span)
            if out and out[-1][0] == k and lo <= out[-1][2]:
                out[-1] = (k, out[-1][1], max(hi, out[-1][2]))
            else:
                out.append((k, lo, hi))
        return [(int(self.ids[k]), lo, hi) for k, lo, hi in out]


def shared(counts: Counter, window: list[int]) -> int:
    """Words of an item that window holds, each as often as both hold it: no alignment matches more."""
    return sum(min(n, counts[w]) for w, n in Counter(filter(counts.__contains__, window)).items())


def most_score(known: np.ndarray, h: np.ndarray) -> int:
    """A bound of the alignment score of h with an item of the sorted words `known`: each word inside an alignment matches or costs at least one point."""
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    run = np.cumsum(np.where(known[at] == h, MATCH, max(MISMATCH, GAP)))
    return int((run - np.minimum.accumulate(np.concatenate([[0], run[:-1]]))).max())


def leaks(items: Items, words: list[str], known: dict) -> list[tuple[int, float, int, int]]:
    """(item, score, first word, last word) of each item whose best alignment with words reaches its threshold; items of fewer than SHORT words must stand whole."""
    h = items.numbers(words)
    found = items.regions(h)
    if not found:
        return []
    best, listed = {}, h.tolist()
    for item, lo, hi in found:
        w, counts, least = items.words[item], items.counts[item], items.threshold[item]
        if most_score(items.distinct[item], h[lo:hi]) < MATCH * least * len(w) - 1e-9 or shared(counts, listed[lo:hi]) < least * len(w) - 1e-9:
            continue
        key = (item, h[lo:hi].tobytes())
        if key not in known:
            if len(known) > 20_000:
                known.clear()
            known[key] = align(w, h[lo:hi])
        score, first, last = known[key]
        if score >= least and (item not in best or score > best[item][1]):
            best[item] = (item, score, lo + first, lo + last)
    return [best[item] for item in sorted(best)]


def _scan(items: Items):
    def run(batches):
        known: dict = {}
        for batch in small(batches):
            rows = [(i, *x) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for x in leaks(items, words_of(t), known)]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["doc_id", "item_id", "score", "first_word", "last_word"])

    return run


def _keep(items: Items):
    def run(batches):
        known: dict = {}
        for batch in small(batches):
            yield batch.filter(pa.array([not leaks(items, words_of(t), known) for t in batch.column("text").to_pylist()], pa.bool_()))

    return run


def item_blocks(benchmark: DataFrame, threshold: float):
    """The items in blocks of about BLOCK_CHARS characters, one at a time."""
    bench = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    blocks = max(1, -(-(bench.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS))
    for b in range(blocks):
        yield Items(sorted(tuple(r) for r in bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()), threshold)


def find_leaks(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Contaminated pairs: doc_id, item_id, score, first_word, last_word (places among the document's lower-cased \\w+ words).

    Null or empty texts contain nothing; items of fewer than LEAST_WORDS words, without text or item_id are not looked for. Rows that repeat
    a doc_id are reported each; of rows that repeat an item_id within a block the last text in order counts. With several places of an item in a document, the best (then first) is reported.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    out = None
    for items in item_blocks(benchmark, threshold):
        found = texts.mapInArrow(_scan(items), "doc_id long, item_id long, score double, first_word long, last_word long")
        out = found if out is None else out.union(found)
    return out


def clean_documents(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of documents in which no item is found. Each row is judged by its own text, whatever its doc_id; nothing is shuffled."""
    docs = documents.withColumn("text", F.col("text").cast("string"))
    for items in item_blocks(benchmark, threshold):
        docs = docs.mapInArrow(_keep(items), docs.schema)
    return docs
