"""Token ids in files of Simple-8b words, and their vectorised decoding.

A 64-bit word holds a selector in its top 4 bits and, below it, as many values of one width as fit in 60 bits. Selector 0 is the escape:
the next word is one raw 64-bit value. Blocks of BLOCK ids are coded apart, and the file has each block's word offset, so all blocks of a
file are coded and decoded side by side. Values are frequency ranks; the file's table maps rank to id.

File, little-endian: magic "S8BF", u32 task, u32 file of the task, u32 documents, u32 table size, u64 ids, u64 words; table u32;
doc_id i64, missing-doc_id flags u8, ids of each document u64; block offsets u64 (one more than blocks); words u64.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltaloom.llm.common import materialize, shared_dir, small
from voltaloom.llm.tokens import encoder

MAGIC, BLOCK, FILE_IDS = b"S8BF", 4096, 2_000_000
_HEAD = struct.Struct("<4sIIIIQQ")

# Fixed values of the code: values in a word and bits of each, by selector; 0 is the escape.
COUNTS = (1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)


#: Bit lengths of all 16-bit numbers.
_LENGTHS = np.array([n.bit_length() for n in range(1 << 16)], np.uint8)


def _bits(v: np.ndarray) -> np.ndarray:
    """Bit length of each value."""
    if not len(v) or int(v.max()) < 1 << 16:
        return _LENGTHS[v.astype(np.uint16)]
    out = np.zeros(v.shape, np.uint8)
    for k in range(4):
        part = ((v >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.uint16)
        np.maximum(out, np.where(part > 0, _LENGTHS[part] + np.uint8(16 * k), np.uint8(0)), out=out)
    return out


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, block offsets in words) of values (uint64)."""
    n = len(values)
    blocks = -(-n // BLOCK)
    if not n:
        return np.empty(0, np.uint64), np.zeros(1, np.uint64)
    wide = max(COUNTS)
    grid = np.zeros((blocks, BLOCK + wide), np.uint64)
    whole = n // BLOCK
    grid[:whole, :BLOCK] = values[: whole * BLOCK].reshape(whole, BLOCK)
    grid[whole:, : n - whole * BLOCK] = values[whole * BLOCK :]
    reach = {1: _bits(grid.reshape(-1)).reshape(grid.shape)}
    while 2 * max(reach) <= wide:
        k = max(reach)
        top = reach[k].copy()
        np.maximum(top[:, :-k], reach[k][:, k:], out=top[:, :-k])
        reach[2 * k] = top
    choice = np.zeros((blocks, BLOCK), np.uint8)
    for sel in range(15, 0, -1):
        c = COUNTS[sel]
        k = 1 << (c.bit_length() - 1)
        most = np.maximum(reach[k][:, :BLOCK], reach[k][:, c - k : c - k + BLOCK])
        choice[most <= WIDTHS[sel]] = sel
    step = np.array(COUNTS, np.uint8)[choice].reshape(-1)
    ends = np.minimum(BLOCK, n - BLOCK * np.arange(blocks))
    at, live, starts, owners = np.zeros(blocks, np.int64), np.arange(blocks), [], []
    while len(live):  # all blocks take a step together
        starts.append(at[live])
        owners.append(live)
        at[live] += step[live * BLOCK + at[live]]
        live = live[at[live] < ends[live]]
    o, s = np.divmod(np.sort(np.concatenate(owners) * BLOCK + np.concatenate(starts)), BLOCK)
    sel, cells, flat = choice[o, s], grid.reshape(-1), o * (BLOCK + wide) + s
    size = np.where(sel == 0, 2, 1)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for k in range(16):
        at = np.nonzero(sel == k)[0]
        if not len(at):
            continue
        if k == 0:
            words[place[at] + 1] = cells[flat[at]]
            continue
        c, w = COUNTS[k], WIDTHS[k]
        packed = np.full(len(at), np.uint64(k) << np.uint64(60), np.uint64)
        if w:
            first = flat[at]
            for j in range(c):
                packed |= cells[first + j] << np.uint64(j * w)
        words[place[at]] = packed
    offsets = np.zeros(blocks + 1, np.uint64)
    np.cumsum(np.bincount(o, weights=size, minlength=blocks).astype(np.uint64), out=offsets[1:])
    return words, offsets


def unpack(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n values of words; block b starts at word offsets[b] and value b * BLOCK."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    sel = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    zero = np.nonzero(sel == 0)[0]
    if len(zero):  # an escape's raw word may itself look like an escape
        last = -2
        for z in zero.tolist():
            if z != last + 1:
                raw[z + 1] = True
                last = z
    head = np.nonzero(~raw)[0]
    sel = sel[head]
    count = np.array(COUNTS)[sel]
    block = np.searchsorted(offsets, head.astype(np.uint64), "right") - 1
    total = np.cumsum(count) - count
    first = np.searchsorted(head, offsets[:-1].astype(np.int64))
    start = total - total[first][block] + block * BLOCK
    end = np.minimum((block + 1) * BLOCK, n)
    for k in range(16):
        at = np.nonzero(sel == k)[0]
        if not len(at):
            continue
        if k == 0:
            out[start[at]] = words[head[at] + 1]
        elif WIDTHS[k]:
            w, mask = words[head[at]], np.uint64((1 << WIDTHS[k]) - 1)
            for j in range(COUNTS[k]):
                to = start[at] + j
                ok = to < end[at]
                out[to[ok]] = (w[ok] >> np.uint64(j * WIDTHS[k])) & mask
    return out


def write_file(docs: list[int | None], ids: list[np.ndarray], task: int, number: int) -> bytes:
    flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
    freq = np.bincount(flat, minlength=1)
    table = np.argsort(-freq, kind="stable")[: int((freq > 0).sum())]
    rank = np.zeros(len(freq), np.uint64)
    rank[table] = np.arange(len(table), dtype=np.uint64)
    words, offsets = pack(rank[flat])
    head = _HEAD.pack(MAGIC, task, number, len(docs), len(table), len(flat), len(words))
    parts = (table.astype("<u4"), np.array([d or 0 for d in docs], "<i8"), np.array([d is None for d in docs], "u1"), np.array([len(x) for x in ids], "<u8"), offsets.astype("<u8"), words.astype("<u8"))
    return head + b"".join(p.tobytes() for p in parts)


def read_file(data: bytes) -> tuple[int, int, list[int | None], list[np.ndarray]]:
    """(task, file of the task, doc_ids, ids of each document)."""
    magic, task, number, n_docs, n_table, n_ids, n_words = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a Simple-8b token file")
    at = _HEAD.size

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        a = np.frombuffer(data, kind, n, at)
        at += a.nbytes
        return a

    table, docs, missing, sizes = take("<u4", n_table), take("<i8", n_docs), take("u1", n_docs), take("<u8", n_docs)
    offsets = take("<u8", -(-n_ids // BLOCK) + 1)
    flat = table[unpack(take("<u8", n_words), offsets, n_ids).astype(np.int64)] if n_ids else np.empty(0, "<u4")
    ends = np.cumsum(sizes.astype(np.int64))
    return task, number, [None if m else int(d) for d, m in zip(docs, missing, strict=True)], np.split(flat, ends[:-1]) if n_docs else []


def _write(path: str, end_id: int, folder: str):
    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        enc, task, number, docs, ids, size = encoder(path), TaskContext.get().partitionId(), 0, [], [], 0
        made: list[tuple] = []

        def flush():
            nonlocal number, size
            name, draft = f"{root}/{task:06d}-{number:06d}.s8b", f"{root}/_{task:06d}-{number:06d}-{TaskContext.get().taskAttemptId()}"
            with store.open_output_stream(draft) as f:
                f.write(write_file(docs, ids, task, number))
            store.move(draft, name)
            made.append((task, number, size))
            docs.clear()
            ids.clear()
            number, size = number + 1, 0

        for batch in small(batches):
            keys, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            for lo in range(0, len(keys), 128):
                for key, x in zip(keys[lo : lo + 128], enc.encode(texts[lo : lo + 128]), strict=True):
                    if docs and size + len(x) + 1 > FILE_IDS:
                        flush()
                    docs.append(key)
                    ids.append(np.append(x.astype(np.uint32), np.uint32(end_id)))
                    size += len(x) + 1
        if docs:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], pa.int64()) for k in range(3)], ["task", "number", "ids"])

    return run


def write_tokens(documents: DataFrame, path: str, folder: str, end_id: int = 2) -> DataFrame:
    """Write the ids of all documents, in ascending doc_id order over the files (task, then number); returns task, number, ids, base of each file.

    base: ids of all files before. folder is a URI that pyarrow's file systems open on every executor; files are
    moved into place whole, so a task that is run again leaves no part of a file. Null texts are empty; rows without doc_id come first; equal doc_ids
    are ordered by text.
    """
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sorted_docs = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    files = materialize(sorted_docs.mapInArrow(_write(path, end_id, folder), "task long, number long, ids long"), "s8b-files")
    tasks = files.groupBy("task").agg(F.sum("ids").alias("n"))  # a row for each task: the running sum over them is small
    before = tasks.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("task", "before")
    within = F.coalesce(F.sum("ids").over(Window.partitionBy("task").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return files.withColumn("base", within).join(before, "task").select("task", "number", "ids", (F.col("base") + F.col("before")).alias("base"))


def _read(batches):
    for batch in small(batches):
        for data in batch.column("content"):
            task, number, docs, ids = read_file(data.as_buffer())
            sizes = np.array([len(x) for x in ids], np.int64)
            crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
            n = len(docs)
            cols = [pa.array([task] * n, pa.int64()), pa.array([number] * n, pa.int64()), pa.array(docs, pa.int64()), pa.array(np.cumsum(sizes) - sizes), pa.array(sizes), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["task", "number", "doc_id", "at", "n_tokens", "ids_crc32"])


def read_tokens(files: DataFrame, folder: str) -> DataFrame:
    """What the files hold, of each document: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""
    got = files.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.s8b").load(folder).select("content")
    rows = got.mapInArrow(_read, "task long, number long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(files.select("task", "number", "base"), ["task", "number"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_folder(documents: DataFrame) -> str:
    import uuid

    return f"{shared_dir(documents.sparkSession)}/voltaloom/s8b-{uuid.uuid4().hex}"
