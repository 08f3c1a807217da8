"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A text is the multiset of its words: a term's weight is how often it occurs. For each of LANES samples a term draws r and c from Gamma(2, 1) and b from the
unit interval, all from hashes of the term and the sample's number; with t = floor(ln(weight) / r + b), the term whose c / exp(r (t - b + 1)) is least
is sampled as (term, t). Two texts take the same sample with a chance equal to the generalised Jaccard similarity of their weights,
the sum of the lesser weights over the sum of the greater ones.

A sample is kept as one long, the least of (quantised logarithm, hash of term and t), so that samples are partial minima of a hash aggregate in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Samples of a fingerprint, and how many of them one row computes at once.
SAMPLES, LANES = 32, 4
#: Rows that a part of the order by doc_id has about, and the most parts there are.
PART_ROWS, MAX_PARTS = 1000, 1 << 16
#: What stands in a fingerprint for a sample of a text without words.
NONE = "-" * 8


def _uniform(h: Column, shift: int) -> Column:
    """21 bits of a hash as a number inside the unit interval."""
    return (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << 21) - 1)) + F.lit(0.5)) * F.lit(2.0**-21)


def least_samples(terms: DataFrame, keys: list[str], weights: list[str], samples: int = SAMPLES) -> DataFrame:
    """keys and for each weight column an array of its samples, from terms (keys, term long, weights); null where no term has a weight above 0.

    Several weight columns share a term's draws. Each term occurs once for its keys.
    """
    lanes = range(LANES)
    rows = terms.select(*keys, "term", *[F.log(F.col(w)).alias(f"l{j}") for j, w in enumerate(weights)], F.explode(F.sequence(F.lit(0), F.lit((samples - 1) // LANES))).alias("lane"))
    kept = [*keys, "lane", *[f"l{j}" for j in range(len(weights))]]
    rows = rows.select(*kept, "term", *[F.xxhash64("term", "lane", F.lit(2 * i + k)).alias(f"h{i}{k}") for i in lanes for k in (0, 1)])
    rows = rows.select(
        *kept, *[f"h{i}0" for i in lanes],
        *[(-F.log(_uniform(F.col(f"h{i}0"), 0) * _uniform(F.col(f"h{i}0"), 21))).alias(f"r{i}") for i in lanes],
        *[F.log(-F.log(_uniform(F.col(f"h{i}0"), 42) * _uniform(F.col(f"h{i}1"), 0))).alias(f"c{i}") for i in lanes],
        *[_uniform(F.col(f"h{i}1"), 21).alias(f"b{i}") for i in lanes],
    )
    each = [(i, j) for i in lanes for j in range(len(weights))]
    rows = rows.select(*keys, "lane", *[f"h{i}0" for i in lanes], *[f"{x}{i}" for x in "rcb" for i in lanes], *[F.floor(F.col(f"l{j}") / F.col(f"r{i}") + F.col(f"b{i}")).alias(f"t{i}{j}") for i, j in each])

    def sample(i: int, j: int) -> Column:
        r, c, b, t = F.col(f"r{i}"), F.col(f"c{i}"), F.col(f"b{i}"), F.col(f"t{i}{j}")
        order = F.floor((c - r * (t - b + 1) + F.lit(128.0)) * F.lit(float(1 << 23)))  # logarithms lie between -128 and 128
        mark = F.col(f"h{i}0").bitwiseXOR(t).bitwiseAND(F.lit(0xFFFFFFFF))  # tells (term, t) apart within a sample
        return F.shiftleft(order, 32).bitwiseOR(mark)

    least = rows.groupBy(*keys, "lane").agg(*[F.min(sample(i, j)).alias(f"m{i}{j}") for i, j in each])
    packed = least.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("lane", *[f"m{i}{j}" for i, j in each]))).alias("rows"))

    def in_turn(j: int) -> Column:
        return F.slice(F.flatten(F.transform("rows", lambda x: F.array(*[x[f"m{i}{j}"] for i in lanes]))), 1, samples)

    return packed.select(*keys, *[in_turn(j).alias(w) for j, w in enumerate(weights)])


def fingerprint(samples: Column) -> Column:
    """Eight hexadecimal digits a sample."""
    digits = lambda x: F.coalesce(F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0"), F.lit(NONE))
    return F.array_join(F.transform(samples, digits), "")


def likeness(one: Column, two: Column) -> Column:
    """Share of equal samples; two texts without words are alike."""
    same = F.filter(F.zip_with(one, two, lambda x, y: x.eqNullSafe(y)), lambda x: x)
    return F.size(same) / F.size(one)


def _first_ids(documents: DataFrame) -> list[int]:
    """The least doc_id of each part of the order by doc_id, ascending; at most MAX_PARTS numbers come to the driver."""
    ids = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"))
    parts = min(MAX_PARTS, ids.count() // PART_ROWS + 1)
    bounds = ids.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.25 / parts) if parts > 1 else []
    found = ids.groupBy(_part(sorted({int(b) for b in bounds}), F.col("doc_id")).alias("part")).agg(F.min("doc_id").alias("first"))
    return sorted(r["first"] for r in found.collect())


def _part(bounds: list[int], value: Column) -> Column:
    """How many of bounds are at most value, by binary search."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    array = F.lit(bounds).cast("array<long>")
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(F.coalesce(F.get(array, at + step - 1) <= value, F.lit(False)), at + step).otherwise(at))


def in_order(documents: DataFrame) -> DataFrame:
    """(part, kind, at, doc_id, text, next_text): documents in parts of the order by doc_id, each row with the text of its next one.

    Rows of one doc_id follow one another by their text; after the last comes the first. A part also holds the first rows of the part after it, as kind 1,
    so that one shuffle brings each row together with its next one. Rows without doc_id have kind 2, are dealt by their text and have no next text.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    firsts = _first_ids(documents)
    parts = max(1, len(firsts))
    own = F.greatest(_part(firsts, F.col("doc_id")) - 1, F.lit(0))
    before = F.pmod(own - 1, F.lit(parts))
    first = F.coalesce(F.get(F.lit(firsts or [0]).cast("array<long>"), own) == F.col("doc_id"), F.lit(False))
    place = lambda part, kind: F.struct(part.cast("int").alias("part"), F.lit(kind).alias("kind"))
    loose = place(F.pmod(F.xxhash64("text"), F.lit(parts)), 2)
    places = F.when(F.col("doc_id").isNull(), F.array(loose)).when(first, F.array(place(own, 0), place(before, 1))).otherwise(F.array(place(own, 0)))
    dealt = rows.select("doc_id", "text", F.explode(places).alias("p")).select("p.part", "p.kind", "doc_id", "text")
    order = W.partitionBy("part").orderBy("kind", "doc_id", F.xxhash64("text"), "text")
    follows = F.lead("kind").over(order)
    return dealt.select("part", "kind", F.row_number().over(order).alias("at"), "doc_id", "text", F.when((F.col("kind") < 2) & (follows < 2), F.lead("text").over(order)).alias("next_text"))


def fingerprints(documents: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """One row for each row of documents (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many of the next document, in ascending doc_id.
    Null texts are empty. A text without words has a fingerprint of its own, equal to that of all such texts. Rows of one doc_id count each and follow one
    another by their text; a row without doc_id has an empty text as its next one. Other columns are left out. An empty table gives no rows.
    Texts are shuffled once, by parts of the order; words, weights and samples stay in their part. A part has about PART_ROWS rows; only the rows
    of one and the same doc_id are never parted.
    """
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    rows = in_order(documents).withColumn("edited", edited)
    keys = ["part", "at"]
    told = rows.where("kind <> 1").select(*keys, "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.col("next_text").isNull().alias("alone"))
    versions = rows.select(*keys, F.posexplode(F.array("text", "edited")).alias("version", "t"))
    words = versions.select(*keys, "version", F.explode(F.split("t", "[\\x20\\x09-\\x0D]+")).alias("word"))  # an empty word keeps texts without words
    words = words.select(*keys, "version", F.when(F.col("word") != "", F.xxhash64("word")).alias("term"))
    terms = words.groupBy(*keys, "term").agg(*[F.count_if(F.col("term").isNotNull() & (F.col("version") == v)).alias(w) for v, w in enumerate(("own", "changed"))])
    after = F.lead("own").over(W.partitionBy("part").orderBy("at"))
    signed = least_samples(terms, keys, ["own", "changed"], samples).withColumn("after", after)
    signed = signed.select(
        *keys, fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("changed")).alias("edited_fingerprint"), F.get("own", F.lit(0)).isNull().alias("wordless"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.coalesce("after", "own")).alias("near_next"),
    )
    near_next = F.when(F.col("alone"), F.col("wordless").cast("double")).otherwise(F.col("near_next"))
    return told.join(signed, keys).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", near_next.alias("near_next"))
