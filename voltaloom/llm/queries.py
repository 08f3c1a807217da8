"""The operators applied to their whole tables, as the entry module registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltaloom.deploy import ship
from voltaloom.llm import decontaminate, hard_negatives, html_text, infill, jaccard, licenses, line_chunks, packing, quality, simple8b, tokens, toxicity, weighted_samples


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows that labels are never learned from: crc32 of the doc_id's digits leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(table(spark, sf_dir, "pages"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), path)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), F.col("source")).drop("host_rate")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.section_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def conversations_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction data: conversations packed so that at most a quarter of a sequence's tokens bear loss."""
    return packing.pack_conversations(table(spark, sf_dir, "conversations"), tokenizer("word_bpe_49k.json"), loss=1024)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon = toxicity.learn(docs, labels.where(~held_out()))
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), lexicon)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_hits")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = simple8b.token_folder(docs)
    return simple8b.read_tokens(simple8b.write_tokens(docs, tokenizer("byte_bpe_50k.json"), folder), folder)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chunks.remove_repeated_chunks(table(spark, sf_dir, "documents")).select("doc_id", "text", "removed_lines", "removed_words")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents")).drop("text_key", "head_key")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(infill.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op12_weighted_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_samples.fingerprints(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.whole_vectors(table(spark, sf_dir, "embeddings"), F.col("vec_id"), moved, F.col("embedding"))
    return hard_negatives.mine_hard_negatives(rows, F.col("vec_id") % 50 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_decontamination, op2_html_text, op3_licenses, op4_quality, op5_token_counts, op6_packing, op7_toxicity, op8_token_files, op9_line_dedup, op10_jaccard_join, op11_fill_in_middle, op12_weighted_samples, op13_hard_negatives, conversations_packed)
    return {f.__name__: f for f in found}


_OP4 = r"""
WITH d AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d
), c AS (
  SELECT doc_id, host, words,
    CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
       - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines
  FROM w
), g AS (
  SELECT doc_id, i, list_slice(words, i, i + 7) AS win
  FROM (SELECT doc_id, words, unnest(range(1, n_words - 6)) AS i FROM c WHERE n_words >= 8)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS k FROM g) WHERE k > 1
), p AS (
  SELECT doc_id, CAST(sum(least(8, i - coalesce(before, -8))) AS BIGINT) AS n_repeat_words
  FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM r) GROUP BY doc_id
), b AS (
  SELECT c.doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    n_words < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * n_words AS base_failed
  FROM c LEFT JOIN p ON c.doc_id = p.doc_id
), h AS (
  SELECT host, count(*) AS n, sum(CAST(base_failed AS INTEGER)) AS f FROM b WHERE host IS NOT NULL GROUP BY host
), m AS (
  SELECT sum(f) / sum(n) AS mean, var_pop(f / n) AS var, avg(1 / n) AS noise FROM h
), k AS (
  SELECT mean, coalesce(least(greatest(mean * (1 - mean) / nullif(greatest(var - mean * (1 - mean) * noise, 0), 0) - 1, 2), 100), 100) AS weight FROM m
), v AS (
  SELECT host, (f + mean * weight) / (n + weight) AS rate FROM h, k
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(rate, 0) < 0.5 AS kept
FROM b LEFT JOIN v ON b.host = v.host
"""


_OP11 = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents
), h AS (
  SELECT *, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2, CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t
    WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
    ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM c
"""


_OP13 = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS row_id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM r AS a, r WHERE a.vec_id % 50 = 0
), p AS (
  SELECT * FROM (SELECT anchor_id, row_id, score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, row_id) AS k FROM s WHERE same AND row_id <> anchor_id) WHERE k <= 5
), n AS (
  SELECT p.anchor_id, p.row_id AS positive_id, p.score AS positive_score, s.row_id AS negative_id, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.row_id ORDER BY s.score DESC, s.row_id) AS INTEGER) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_quality": _OP4, "op11_fill_in_middle": _OP11, "op13_hard_negatives": _OP13}
