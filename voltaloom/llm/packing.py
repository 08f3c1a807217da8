"""Vector bin packing of tokenised examples by the dot-product heuristic.

A sequence has limits on tokens, segments (pieces of examples) and loss-bearing tokens. Each task packs the examples of its
partition from a window of WINDOW of them: of those that fit whole, the one with the largest dot product of demand and
remaining capacity goes in; if none fits, the example with the largest product is cut to what remains and its rest goes back.
Where short examples fill the window, a sequence starts with them, so that they do not pile up and meet the segment limit.
What cannot be filled to the token limit (the task's last sequences) is laid out in sequences of powers of two,
which need no padding. Nothing is shuffled; memory is the window's.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltaloom.llm.common import materialize, small
from voltaloom.llm.tokens import encoder

TOKENS, SEGMENTS, WINDOW = 4096, 128, 512
#: Turns of a conversation that one example holds.
TURNS = 64


class Packer:
    """Yields sequences: lists of (key, start, length); every sequence has TOKENS tokens or a power of two.

    Demands are (tokens, segments, loss-bearing tokens); an example's loss-bearing tokens count as spread evenly over it.
    """

    def __init__(self, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int | None = None, window: int = WINDOW):
        self.limit = np.array([tokens, segments, tokens if loss is None else loss], float)
        self.window = window
        self.keys, self.start, self.left, self.share = [], np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def add(self, key, tokens: int, loss: int | None = None):
        if tokens > 0:
            self.keys.append(key)
            self.start = np.append(self.start, 0)
            self.left = np.append(self.left, tokens)
            self.share = np.append(self.share, 1.0 if loss is None else loss / tokens)
        while len(self.keys) > self.window:
            yield from self.sequence()

    def finish(self):
        while self.keys:
            yield from self.sequence()

    def sequence(self):
        room, pieces = self.limit.copy(), []
        tiny = np.nonzero(self.left < self.limit[0] / self.limit[1])[0]
        first = tiny[: int(self.limit[1]) // 2].tolist() if 2 * len(tiny) > self.window else []
        done = np.zeros(len(self.keys), bool)
        for k in first:
            if self.fits(k, room):
                self.take(k, int(self.left[k]), room, pieces, done)
        while room[0] >= 1 and room[1] >= 1 and not done.all():
            demand = np.stack([self.left / self.limit[0], np.full(len(self.left), 1 / self.limit[1]), self.left * self.share / self.limit[2]])
            product = (room / self.limit) @ demand
            fit = ~done & (self.left <= room[0]) & (self.left * self.share <= room[2] + 1e-9)
            if room[1] < 2:
                fit &= self.left == room[0]  # the last segment must fill the sequence
            if fit.any():
                k = int(np.where(fit, product, -1).argmax())
                n = int(self.left[k])
            else:
                k = int(np.where(done, -1, product).argmax())
                n = int(min(self.left[k], room[0], room[2] / self.share[k] + 1e-9 if self.share[k] else room[0]))
                if n < 1:
                    break
            self.take(k, n, room, pieces, done)
        keep = np.nonzero(~done)[0]
        self.keys = [self.keys[k] for k in keep]
        self.start, self.left, self.share = self.start[keep], self.left[keep], self.share[keep]
        yield from lay_out(pieces, int(self.limit[0]))

    def fits(self, k: int, room: np.ndarray) -> bool:
        return self.left[k] <= room[0] and room[1] >= 2 and self.left[k] * self.share[k] <= room[2]

    def take(self, k: int, n: int, room: np.ndarray, pieces: list, done: np.ndarray) -> None:
        pieces.append((self.keys[k], int(self.start[k]), n))
        room -= (n, 1, n * self.share[k])
        self.start[k] += n
        self.left[k] -= n
        done[k] = self.left[k] == 0


def lay_out(pieces: list[tuple], limit: int):
    """The pieces as one sequence if they fill it, else cut into sequences of powers of two, the largest first."""
    total, at, used = sum(p[2] for p in pieces), 0, 0
    while total:
        size = limit if total >= limit else 1 << (total.bit_length() - 1)
        total -= size
        out = []
        while size:
            key, start, length = pieces[at]
            n = min(size, length - used)
            out.append((key, start + used, n))
            size -= n
            used += n
            if used == length:
                at, used = at + 1, 0
        yield out


_COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(path: str, end_id: int, limits: dict, share: bool = False):
    def run(batches):
        enc, packer, base, made = encoder(path), Packer(**limits), TaskContext.get().partitionId() << 40, 0
        held: dict[int, tuple[int | None, np.ndarray, int]] = {}
        row = 0
        rows: list[tuple] = []

        def put(sequence):
            nonlocal made
            offset = 0
            for key, start, n in sequence:
                doc, ids, left = held[key]
                rows.append((doc, start, n, zlib.crc32(ids[start : start + n].astype("<u4").tobytes()), len(ids), base + made, offset))
                offset += n
                if left == n:
                    del held[key]
                else:
                    held[key] = (doc, ids, left - n)
            made += 1

        def out():
            cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(7)]
            rows.clear()
            return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in _COLUMNS.split(", ")])

        for batch in small(batches):
            docs, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            loss = batch.column("loss").to_pylist()
            for lo in range(0, len(docs), 128):
                for doc, ids, bear in zip(docs[lo : lo + 128], enc.encode(texts[lo : lo + 128]), loss[lo : lo + 128], strict=True):
                    held[row] = (doc, np.append(ids, ids.dtype.type(end_id)), len(ids) + 1)
                    for s in packer.add(row, len(ids) + 1, None if bear is None else min(max(bear * (len(ids) + 1) if share else bear, 0), len(ids) + 1)):
                        put(s)
                    row += 1
            yield out()
        for s in packer.finish():
            put(s)
        yield out()

    return run


def conversation_examples(conversations: DataFrame, turns: int = TURNS, roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Training examples of conversations (conv_id, turn, role, text): conv_id, part, text, loss_share.

    An example is a conversation's turns numbered from part * turns, as many as `turns`, joined by line feeds, so the longest conversation is many examples. loss_share is the share of its
    characters in turns by one of roles, 0 of an empty text. Null texts are empty; turns of one number stand in order of role and text; rows without
    conv_id or turn are examples by themselves.
    """
    text, bears = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").isin(*roles), F.lit(False))
    alone = F.when(F.col("conv_id").isNull() | F.col("turn").isNull(), F.monotonically_increasing_id())
    rows = conversations.select("conv_id", F.floor(F.col("turn") / turns).cast("long").alias("part"), alone.alias("_alone"), F.struct("turn", "role", text.alias("text"), bears.alias("bears")).alias("t"))
    each = rows.groupBy("conv_id", "part", "_alone").agg(F.array_sort(F.collect_list("t")).alias("t"))
    chars = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + F.length(x["text"]))
    share = F.coalesce(F.try_divide(chars(F.filter("t", lambda x: x["bears"])), chars(F.col("t"))), F.lit(0.0))
    return each.select("conv_id", "part", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("text"), share.alias("loss_share"))


def pack_conversations(conversations: DataFrame, path: str, end_id: int = 2, turns: int = TURNS, **limits) -> DataFrame:
    """Pieces of packed sequences of conversation_examples: conv_id and part instead of doc_id, else as of pack_documents; loss_share of an example's tokens bear loss.

    Examples are written first, so a task that is run again packs the same rows in the same order.
    """
    examples = materialize(conversation_examples(conversations, turns), "examples")
    numbered = materialize(examples.withColumn("doc_id", F.monotonically_increasing_id()), "examples")
    packed = numbered.select("doc_id", "text", F.col("loss_share").alias("loss")).mapInArrow(_pack(path, end_id, limits, True), _COLUMNS)
    return packed.join(numbered.select("doc_id", "conv_id", "part", "loss_share"), "doc_id").drop("doc_id")


def pack_documents(documents: DataFrame, path: str, end_id: int = 2, loss_tokens: Column | None = None, **limits) -> DataFrame:
    """Pieces of packed sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids by the tokenizer at path, then end_id; every id lies in one piece. limits: tokens, segments, loss,
    window of Packer. loss_tokens: how many of a document's ids bear loss (0 to all, taken as spread evenly over them); all where it
    is null or not given. Null and empty texts are the end id alone; repeated rows and rows without
    doc_id are packed each. Row order is the scan's, so a task that is run again makes the same sequences.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.lit(None) if loss_tokens is None else loss_tokens).cast("long").alias("loss"))
    return docs.mapInArrow(_pack(path, end_id, limits), _COLUMNS)
