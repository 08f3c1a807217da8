"""Removal of passages of several lines that earlier documents already hold, by content-defined line chunks.

Lines with a word are hashed. Of every window, the fewest lines from a line on that have WINDOW_WORDS words, the last line with the
smallest hash ends a chunk, and lines of LONG_LINE words or more are chunks of their own. So a line's choice depends only on lines
within WINDOW_WORDS words of it: all copies of a passage have the same boundaries but for the words at its ends (EDGE_WORDS at most),
and one of over 50 words holds a whole chunk, however short its lines are. Chunks that occur
twice or more in the corpus are compared, byte for byte, with their first occurrence (smallest doc_id, then position);
what equals it is removed if the run of removed chunks, widened line by line into the chunks beside it, has
min_words words or more. Blank lines do not count and go with the lines around them.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltaloom.llm.common import materialize, small, spread_join

WINDOW_WORDS, LONG_LINE = 6, 25
MIN_WORDS = 40
#: Chunks on either side into which a run may widen, and words of short lines that they hold at least: lines around a passage can move the boundaries at its ends.
BESIDE, EDGE_WORDS = 2, 20


def ends(words: list[int], hashes: list[int]) -> set[int]:
    """Places of the lines that end a chunk: of each window the last line with the smallest hash."""
    out, stop, total = set(), 0, 0
    for start, n in enumerate(words):
        while total < WINDOW_WORDS and stop < len(words):
            total += words[stop]
            stop += 1
        if total < WINDOW_WORDS:
            break
        out.add(min(range(start, stop), key=lambda k: (hashes[k], -k)))
        total -= n
    return out


def chunks(text: bytes) -> list[tuple[int, int, list[bytes], list[int]]]:
    """(hash, words, lines, line numbers) of each chunk, in order."""
    rows = [(line, i, n) for i, line in enumerate(text.split(b"\n")) if (n := len(line.split()))]
    hashed = [xxhash.xxh3_64_intdigest(line) for line, _, _ in rows]
    last = ends([n for _, _, n in rows], hashed)
    out, lines, at, hashes, words = [], [], [], [], 0

    def close():
        nonlocal lines, at, hashes, words
        if lines:
            h = xxhash.xxh3_64_intdigest(b"".join(x.to_bytes(8, "little") for x in hashes))
            out.append((h - (1 << 64) if h >> 63 else h, words, lines, at))
        lines, at, hashes, words = [], [], [], 0

    for k, (line, i, n) in enumerate(rows):
        if n >= LONG_LINE:
            close()
        lines.append(line)
        at.append(i)
        hashes.append(hashed[k])
        words += n
        if k in last:
            close()
    close()
    return out


def _rows(batch, *names):
    cols = [batch.column(n) for n in names]
    return zip(*((c.cast(pa.binary()) if pa.types.is_string(c.type) else c).to_pylist() for c in cols), strict=True)


def _hashes(batches):
    for batch in small(batches):
        got = [(i, k, chunks(t)) for i, k, t in _rows(batch, "doc_id", "key", "text") if i is not None and t]
        ids = [pa.array([g[n] for g in got], pa.int64()) for n in (0, 1)]
        yield pa.RecordBatch.from_arrays([*ids, pa.array([[c[0] for c in x] for *_, x in got], pa.list_(pa.int64()))], ["doc_id", "key", "h"])


def _beside(c: list, p: int, step: int) -> list[tuple]:
    """The chunks next to p in one direction, in text order; a long line ends them, as it is a chunk wherever it stands.

    Past BESIDE chunks they go on only where lines of fewer than WINDOW_WORDS words may still belong to a passage: all others end a chunk
    in every copy.
    """
    out, short = [], 0
    for q in range(p + step, len(c) if step > 0 else -1, step):
        if len(c[q][2]) == 1 and c[q][1] >= LONG_LINE:
            break
        if len(out) >= BESIDE and (short >= EDGE_WORDS or len(c[min(q, q - step)][2][-1].split()) >= WINDOW_WORDS):
            break
        out.append(c[q])
        short += sum(n for x in c[q][2] if (n := len(x.split())) < WINDOW_WORDS)
    return out[::step]


def _text(some: list[tuple]) -> bytes:
    return b"\n".join(x for k in some for x in k[2])


_OCCURRENCE = "h long, doc_id long, key long, pos int, first boolean, text binary, left binary, right binary"


def _occurrences(min_words: int):
    """Of each document, the chunks that stand first in the corpus, and repeated ones in runs that may reach min_words."""

    def run(batches):
        for batch in small(batches):
            rows = []
            for *i, t, marks in _rows(batch, "doc_id", "key", "text", "marks"):
                c = chunks(t)
                good = {m["pos"]: m["first"] for m in marks if m["pos"] < len(c) and c[m["pos"]][0] == m["h"]}
                for p in (p for p, first in good.items() if first):
                    rows.append((c[p][0], *i, p, True, _text(c[p : p + 1]), _text(_beside(c, p, -1)), _text(_beside(c, p, 1))))
                again = sorted(p for p, first in good.items() if not first)
                for lo, hi in _runs(again):
                    if sum(x[1] for x in _beside(c, lo, -1) + c[lo : hi + 1] + _beside(c, hi, 1)) >= min_words:
                        rows += [(c[p][0], *i, p, False, _text(c[p : p + 1]), _text(_beside(c, p, -1)) if p == lo else b"", _text(_beside(c, p, 1)) if p == hi else b"") for p in range(lo, hi + 1)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["h", "doc_id", "key", "pos", "first", "text", "left", "right"])

    return run


def _runs(places: list[int]):
    start = prev = None
    for p in places:
        if prev is None or p != prev + 1:
            if prev is not None:
                yield start, prev
            start = p
        prev = p
    if prev is not None:
        yield start, prev


def _same(a: bytes, b: bytes, back: bool) -> int:
    """Lines that a and b have in common at their end (back) or start."""
    x, y, n = a.split(b"\n"), b.split(b"\n"), 0
    if not a or not b:
        return 0
    for p, q in zip(reversed(x) if back else x, reversed(y) if back else y, strict=False):
        if p != q:
            break
        n += 1
    return n


def _compare(batches):
    """Byte comparison with the first occurrence, and how many lines of the chunks beside also agree."""
    for batch in small(batches):
        rows = [(i, k, p, h, _same(l, fl, True), _same(r, fr, False)) for i, k, p, h, t, l, r, ft, fl, fr in _rows(batch, "doc_id", "key", "pos", "h", "text", "left", "right", "ft", "fl", "fr") if t == ft]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["doc_id", "key", "pos", "h", "el", "er"])


def _cut(min_words: int):
    def run(batches):
        for batch in small(batches):
            texts, lines, words = [], [], []
            for t, cuts in _rows(batch, "text", "cuts"):
                n = w = 0
                if t and cuts:
                    c = chunks(t)
                    at = {x["pos"]: x for x in cuts if x["pos"] < len(c) and c[x["pos"]][0] == x["h"]}
                    all_lines, drop = t.split(b"\n"), set()
                    for lo, hi in _runs(sorted(at)):
                        el, er = at[lo]["el"], at[hi]["er"]
                        numbers = [k for p in range(lo, hi + 1) for k in c[p][3]]
                        if el:
                            numbers = [k for x in _beside(c, lo, -1) for k in x[3]][-el:] + numbers
                        numbers += [k for x in _beside(c, hi, 1) for k in x[3]][:er]
                        size = sum(len(all_lines[k].split()) for k in numbers)
                        if size >= min_words:
                            drop.update(range(numbers[0], numbers[-1] + 1))
                            n += len(numbers)
                            w += size
                    if drop:
                        t = b"\n".join(x for k, x in enumerate(all_lines) if k not in drop)
                texts.append(t)
                lines.append(n)
                words.append(w)
            keep = [k for k, name in enumerate(batch.schema.names) if name not in ("cuts", "text")]
            cols = [batch.column(k) for k in keep] + [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(words, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, [batch.schema.names[k] for k in keep] + ["text", "removed_lines", "removed_words"])

    return run


def remove_repeated_chunks(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of documents (doc_id long, text, any others) with repeated passages cut out of text, and removed_lines, removed_words.

    The first occurrence stays. Null and empty texts and rows without doc_id come back unchanged with 0 removed. Rows that repeat doc_id and text
    are one document: a passage that stands first in it stays in each of them; rows that repeat a doc_id with another text are documents of their
    own, ordered by a hash of the text. Columns of documents named like the added ones, or `cuts`, are replaced or left out.
    """
    names = [c for c in documents.columns if c not in ("removed_lines", "removed_words", "cuts")]
    docs = documents.select(*names).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("string"))
    pairs = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    same = ["doc_id", "key"]
    listed = materialize(pairs.mapInArrow(_hashes, "doc_id long, key long, h array<long>"), "chunk-hashes")
    each = listed.select(*same, F.posexplode("h").alias("pos", "h"))
    first = F.min(F.struct(*same, "pos")).alias("f")
    again = materialize(each.groupBy("h").agg(F.count("*").alias("c"), first).where("c > 1").select("h", "f"), "chunk-again")
    is_first = F.struct(*same, "pos") == F.col("f")
    marked = spread_join(each, again, ["h"], same).select(*same, F.struct("pos", "h", is_first.alias("first")).alias("m"))
    marks = materialize(marked.groupBy(*same).agg(F.collect_set("m").alias("marks")), "chunk-marks")  # a set: repeated rows add nothing
    found = materialize(pairs.where("text is not null").join(marks, same).mapInArrow(_occurrences(min_words), _OCCURRENCE), "chunk-texts")
    firsts = found.where("first").groupBy("h").agg(F.first("text").alias("ft"), F.first("left").alias("fl"), F.first("right").alias("fr"))
    equal = spread_join(found.where("not first"), firsts, ["h"], same).mapInArrow(_compare, "doc_id long, key long, pos int, h long, el int, er int")
    cuts = equal.groupBy(*same).agg(F.collect_set(F.struct("pos", "h", "el", "er")).alias("cuts"))
    cuts = materialize(cuts.select(F.col("doc_id").alias("cut_id"), F.col("key").alias("cut_key"), "cuts"), "chunk-cuts")
    joined = docs.join(cuts, (docs["doc_id"] == cuts["cut_id"]) & (F.xxhash64(docs["text"]) == cuts["cut_key"]), "left")
    order = [c for c in names if c != "text"]
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in order] + ["text string", "removed_lines long", "removed_words long"]
    return joined.select(*(docs[c] for c in order), docs["text"], cuts["cuts"]).mapInArrow(_cut(min_words), ", ".join(fields)).select(*names, "removed_lines", "removed_words")
