"""A corpus pipeline of five stages; each reads what its predecessor wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltaloom.llm import decontaminate, jaccard, line_chunks, packing, toxicity
from voltaloom.llm.common import materialize
from voltaloom.llm.queries import held_out, table, tokenizer

#: Score from which a document is rejected as toxic.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below TOXIC, by a lexicon learned from the labelled documents outside the held-out third."""
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return toxicity.score_toxicity(docs, lexicon).where(F.col("score") < TOXIC).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages cut out, n_chars counted anew; documents that have no word left after a cut go."""
    cut = line_chunks.remove_repeated_chunks(docs)
    changed = F.col("removed_lines") > 0
    left = cut.where(~changed | (F.trim(F.translate("text", "\t\n\x0b\f\r", "     ")) != ""))
    return left.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents the one with the smallest doc_id; each row is judged by its own text."""
    return jaccard.one_per_class(docs).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item aligns."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("line dedup", dedup_lines), ("near duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("packing", pack)]

#: No stage before packing, nor packing itself, can be told in SQL; the operators they call are tested against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
