"""Quality rules of documents and of the hosts they come from, in DataFrame functions only.

A document's rules give counts and a base verdict. Failures are summed by host, each host's rate is shrunk towards a beta prior that is
fitted to all hosts by moments, and the host's verdict is joined back: documents of a host whose shrunken failure
rate reaches HOST_RATE are rejected. Hosts are joined with the documents' counts, not texts; a host of many documents is dealt over tasks.

Repeated 8-word windows are found by 64-bit window hashes within one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltaloom.llm.common import WORD_SPACE, materialize, spread_join

WINDOW, LEAST_WORDS, REPEAT_PERCENT, HOST_RATE = 8, 20, 30, 0.5
SYMBOLS = "#*$%&|<>"


def _shifted(a: Column, by: int) -> Column:
    """Hashes of a's items each with the item `by` later; that many fewer."""
    n = F.size(a) - by
    return F.when(n > 0, F.zip_with(F.slice(a, 1, n), F.slice(a, by + 1, n), lambda x, y: F.xxhash64(x, y)))


def _covered(h: Column) -> Column:
    """Words in windows whose hash in h occurs twice or more; h has the window hash at each place."""
    pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def scan(p: Column) -> Column:
        n = F.size(p) - 1
        near = F.zip_with(F.slice(p, 1, n), F.slice(p, 2, n), lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"])).otherwise(F.array().cast("array<int>")))
        places = F.array_sort(F.array_distinct(F.flatten(near)))
        start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(places, start, lambda s, i: F.struct((s["sum"] + F.least(F.lit(WINDOW), i - s["last"])).alias("sum"), i.alias("last")), lambda s: s["sum"])

    return F.element_at(F.transform(F.array(pairs), scan), 1)


def text_rules(documents: DataFrame) -> DataFrame:
    """doc_id, host and the counts of each text; null and empty texts count nothing and fail the base rule."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = documents.select("doc_id", "host", text.alias("t"))
    words = F.filter(F.split("t", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split("t", "\n"), lambda x: F.translate(x, WORD_SPACE, "") != "")
    one = base.select(
        "doc_id", "host",
        F.transform(words, lambda w: F.xxhash64(w)).alias("w"),
        F.length(F.translate("t", WORD_SPACE, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.transform(F.array(lines), lambda a: F.size(a) - F.size(F.array_distinct(a)))[0]).cast("long").alias("n_dup_lines"),
    )
    h = one.withColumn("h", _shifted(F.col("w"), 1)).withColumn("h", _shifted(F.col("h"), 2)).withColumn("h", _shifted(F.col("h"), 4))
    repeats = F.when(F.size("h") > F.size(F.array_distinct("h")), _covered(F.col("h"))).otherwise(F.lit(0).cast("long"))
    counts = h.select("doc_id", "host", F.size("w").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.coalesce(repeats, F.lit(0).cast("long")).alias("n_repeat_words"))
    return counts.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def host_rates(rules: DataFrame, failed: str = "base_failed") -> DataFrame:
    """host, n, failures, rate: (failures + a) / (n + a + b) with the beta prior (a, b) that has the hosts' mean and variance.

    Rows without host are no host. With one host, or no spread between hosts, the prior is worth a hundred documents.
    """
    each = rules.where("host is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col(failed).cast("long")).alias("failures"))
    each = each.withColumn("p", F.col("failures") / F.col("n"))
    m = each.agg((F.sum("failures") / F.sum("n")).alias("mean"), F.var_pop("p").alias("var"), F.avg(1 / F.col("n")).alias("noise"))
    spread = F.greatest(F.col("var") - F.col("mean") * (1 - F.col("mean")) * F.col("noise"), F.lit(0.0))  # less what chance alone gives
    weight = F.coalesce(F.least(F.greatest(F.try_divide(F.col("mean") * (1 - F.col("mean")), spread) - 1, F.lit(2.0)), F.lit(100.0)), F.lit(100.0))
    prior = m.select("mean", weight.alias("weight"))
    shrunk = (F.col("failures") + F.col("mean") * F.col("weight")) / (F.col("n") + F.col("weight"))
    return each.join(F.broadcast(prior)).select("host", "n", "failures", shrunk.alias("rate"))  # the prior is one row


def judge(documents: DataFrame, host: Column) -> DataFrame:
    """One row for each row of documents (doc_id, text): the counts, base_failed, host_rate, kept.

    A document is kept if its base rules hold and its host's shrunken failure rate is below HOST_RATE; without host, if its base rules hold.
    Repeated rows count each. An empty table gives no rows.
    """
    rules = materialize(text_rules(documents.select("doc_id", host.cast("string").alias("host"), "text")), "quality")
    joined = spread_join(rules, host_rates(rules).select("host", F.col("rate").alias("host_rate")), ["host"], ["doc_id"], "left")
    kept = ~F.col("base_failed") & (F.coalesce("host_rate", F.lit(0.0)) < HOST_RATE)
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "host_rate")
