"""Fill-in-middle transformation: texts cut at two places and put together again with markers, by overlapping chunks.

A text's bytes are decomposed into chunks of CHUNK bytes, each with the byte before it. A predicate on adjacent bytes says where a unit
begins, so chunks count their boundaries without knowing one another, each a row of its own. Prefix sums of a text's counts give its number of
units and route the ranks of both cuts to the chunks that own them; only those are scanned again, for the cut's place.
Texts of one chunk are counted and cut where they stand, in one pass over Arrow buffers; only longer ones are dealt as chunks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltaloom.llm.common import materialize

#: Bytes of a chunk.
CHUNK = 1 << 16
#: Texts that hold one of these stay plain.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Per cent of texts that stay plain, and of the others those that begin with the suffix.
PLAIN_PERCENT, SPM_PERCENT = 10, 20


def _code_points(before: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return (byte & 0xC0) != 0x80


def _white(byte: np.ndarray) -> np.ndarray:
    return (byte == 0x20) | ((byte >= 0x09) & (byte <= 0x0D))


def _words(before: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return _white(before) & ~_white(byte)


def _lines(before: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return before == 0x0A


#: Where a unit begins, from a byte of UTF-8 and the one before it. A text's first byte always begins one.
UNITS = {"code points": _code_points, "words": _words, "lines": _lines}


def _bytes_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary array, without copying; nulls are empty."""
    array = array.cast(pa.large_binary())
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _starts(data: np.ndarray, offsets: np.ndarray, unit: str, first_begins: np.ndarray) -> np.ndarray:
    """Places in data where a unit begins; the first byte of part i begins one if first_begins[i]."""
    begins = np.empty(len(data), bool)
    begins[1:] = UNITS[unit](data[:-1], data[1:])
    filled = offsets[1:] > offsets[:-1]
    begins[offsets[:-1][filled]] = first_begins[filled]
    return np.flatnonzero(begins)


def _cut_whole(unit: str):
    """Texts and hashes of both cuts to the number of units, the ranks of the cuts and their places in bytes."""

    def cut(text: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
        data, offsets = _bytes_of(text)
        starts = _starts(data, offsets, unit, np.ones(len(text), bool))
        before = np.searchsorted(starts, offsets)  # boundaries before each text: prefix sums over the batch
        n = np.diff(before)
        ranks = np.sort(np.stack([np.asarray(h) % (n + 1) for h in (one, two)]), axis=0)
        places = np.append(starts, len(data))
        at = [np.where(r == n, offsets[1:], places[before[:-1] + np.minimum(r, n)]) - offsets[:-1] for r in ranks]
        names = ("n", "rank1", "rank2", "at1", "at2")
        return pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (n, *ranks, *at)], names=names)

    return F.arrow_udf(cut, "n long, rank1 long, rank2 long, at1 long, at2 long")


def _chunk_starts(piece: pa.Array, k: pa.Array, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """(places where a unit begins, offsets) over chunks; all but the first chunk of a text carry the byte before them."""
    data, offsets = _bytes_of(piece)
    starts = _starts(data, offsets, unit, np.asarray(k) == 0)  # a carried byte counts in its own chunk
    return starts, offsets


def _count(unit: str):
    def count(piece: pa.Array, k: pa.Array) -> pa.Array:
        starts, offsets = _chunk_starts(piece, k, unit)
        return pa.array(np.diff(np.searchsorted(starts, offsets)).astype(np.int64))

    return F.arrow_udf(count, T.LongType())


def _find(unit: str, chunk: int):
    """The place in the text, in bytes, of the local-th boundary of a chunk."""

    def find(piece: pa.Array, k: pa.Array, local: pa.Array) -> pa.Array:
        starts, offsets = _chunk_starts(piece, k, unit)
        number = np.asarray(k)
        at = starts[np.searchsorted(starts, offsets[:-1]) + np.asarray(local)] - offsets[:-1]
        return pa.array((number * chunk + at - (number > 0)).astype(np.int64))

    return F.arrow_udf(find, T.LongType())


def _cut_chunks(texts: DataFrame, unit: str, chunk: int) -> DataFrame:
    """(key, h1, h2, n, rank1, rank2, at1, at2) of texts (key, h1, h2, text) longer than a chunk; equal keys have equal texts."""
    asked = texts.select("key", "h1", "h2").distinct()
    one = texts.groupBy("key").agg(F.first("text").alias("b"))
    cut = F.transform(F.sequence(F.lit(0), ((F.octet_length("b") - 1) / chunk).cast("int")), lambda k: F.struct(k.alias("k"), F.when(k == 0, F.substring("b", F.lit(1), F.lit(chunk))).otherwise(F.substring("b", k * chunk, F.lit(chunk + 1))).alias("piece")))
    dealt = one.select("key", F.explode(cut).alias("c")).select("key", "c.k", "c.piece")
    chunks = materialize(dealt.repartition("key", "k"), "infill-chunks")
    counts = chunks.select("key", "k", _count(unit)("piece", "k").alias("units"))
    # A text's counts are one short array; its prefix sums are taken within it.
    sums = F.aggregate(F.transform(F.array_sort("each"), lambda x: x["units"]), F.array(F.lit(0).cast("long")), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))
    prefix = counts.groupBy("key").agg(F.collect_list(F.struct("k", "units")).alias("each")).select("key", sums.alias("sums"))
    ranked = asked.join(prefix, "key").withColumn("n", F.element_at("sums", -1))
    ranked = ranked.withColumn("r1", F.col("h1") % (F.col("n") + 1)).withColumn("r2", F.col("h2") % (F.col("n") + 1))
    ranked = ranked.select("key", "h1", "h2", "sums", "n", F.least("r1", "r2").alias("rank1"), F.greatest("r1", "r2").alias("rank2"))
    # Rank r is boundary number r, counted from 0; rank n is the end and has no chunk.
    routed = ranked.select("key", "h1", "h2", "n", "rank1", "rank2", "sums", F.explode(F.array("rank1", "rank2")).alias("rank"))
    owner = F.size(F.filter("sums", lambda s: s <= F.col("rank"))) - 1
    routed = routed.where("rank < n").withColumn("k", owner).select("key", "h1", "h2", "rank", "k", (F.col("rank") - F.get("sums", F.col("k"))).alias("local")).distinct()
    found = routed.join(chunks, ["key", "k"]).select("key", "h1", "h2", "rank", _find(unit, chunk)("piece", "k", "local").alias("at"))
    end = texts.groupBy("key").agg(F.max(F.octet_length("text")).cast("long").alias("bytes"))
    places = found.groupBy("key", "h1", "h2").agg(F.collect_list(F.struct("rank", "at")).alias("places"))
    at = lambda r: F.coalesce(F.get(F.filter("places", lambda p: p["rank"] == F.col(r)), F.lit(0))["at"], F.col("bytes"))
    joined = ranked.drop("sums").join(end, "key").join(places, ["key", "h1", "h2"], "left")
    return joined.select("key", "h1", "h2", F.struct("n", "rank1", "rank2", at("rank1").alias("at1"), at("rank2").alias("at2")).alias("cut"))


def row_hashes(doc_id: Column) -> list[Column]:
    """The first four 8-digit groups of the sha256 of `1:` and the document's number."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(documents: DataFrame, unit: str = "code points", chunk: int = CHUNK) -> DataFrame:
    """One row for each row of documents (doc_id, text): doc_id, n, form, prefix_units, middle_units, text, output.

    n counts the text's units (code points, words or lines; a word or line unit holds the white space after it), the cuts come from the doc_id
    alone, so repeated rows and reruns give equal outputs. Null texts are empty, empty ones and those that hold a marker stay plain, with null
    counts; a row without doc_id is cut by the hash of no digits. Other columns are left out, whatever their names. An empty table gives no rows.
    """
    h1, h2, h3, h4 = row_hashes(F.col("doc_id"))
    rows = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), h4.alias("h4"))
    short = rows.where(F.octet_length("text") <= chunk).withColumn("cut", _cut_whole(unit)(F.col("text").cast("binary"), "h1", "h2"))
    long = rows.where(F.octet_length("text") > chunk).withColumn("key", F.sha2("text", 256))
    cuts = _cut_chunks(long.select("key", "h1", "h2", F.col("text").cast("binary").alias("text")), unit, chunk)
    both = short.unionByName(long.join(cuts, ["key", "h1", "h2"]).drop("key"))
    marked = F.lit(False)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(marker))
    plain = (F.length("text") == 0) | marked | (F.col("h3") % 100 >= 100 - PLAIN_PERCENT)
    formed = both.withColumn("form", F.when(plain, "plain").when(F.col("h4") % 100 < SPM_PERCENT, "spm").otherwise("psm"))
    raw = F.col("text").cast("binary")
    prefix = F.substring(raw, F.lit(1), F.col("cut.at1").cast("int")).cast("string")
    middle = F.substring(raw, (F.col("cut.at1") + 1).cast("int"), (F.col("cut.at2") - F.col("cut.at1")).cast("int")).cast("string")
    suffix = F.substring(raw, (F.col("cut.at2") + 1).cast("int"), F.octet_length("text")).cast("string")
    p, s, m = F.lit(PREFIX), F.lit(SUFFIX), F.lit(MIDDLE)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    cut_form = F.col("form") != "plain"
    return formed.select(
        "doc_id", F.col("cut.n").alias("n"), "form", F.when(cut_form, F.col("cut.rank1")).alias("prefix_units"),
        F.when(cut_form, F.col("cut.rank2") - F.col("cut.rank1")).alias("middle_units"), "text", output.alias("output"),
    )


def restore(output: Column, form: Column) -> Column:
    """The text that an output of that form was made of. No marker can arise across a cut: it begins with < and ends with >, and holds neither inside."""

    def part(text: Column, left: str, right: str | None) -> Column:
        start = F.instr(text, left) + len(left)
        return F.substr(text, start) if right is None else F.substr(text, start, F.instr(text, right) - start)

    psm = F.concat(part(output, PREFIX, SUFFIX), part(output, MIDDLE, None), part(output, SUFFIX, MIDDLE))
    spm = F.concat(part(output, PREFIX, MIDDLE), part(output, MIDDLE, None), part(output, SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
