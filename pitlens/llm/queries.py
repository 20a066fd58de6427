"""One query per operator, over its whole table with production parameters, and its SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlens.llm import byte_pair, chat, fingerprints, importance, language, mixing, near_duplicates, neighbours, quality, spelling, substrings, token_counts, toxicity

CONTEXT_TOKENS = 4_096


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(_read(spark, sf_dir, "documents"), width=3, threshold=(85, 100)).drop("first")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(_read(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.deduplicate(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_read(spark, sf_dir, "embeddings"), "embedding", F.col("vec_id") % 100 == 0, k=10)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return token_counts.over_limit(counted, CONTEXT_TOKENS)


def _held_out(modulus: int, remainder: int) -> Column:
    """Rows kept from learning; a null id is in no fold and is not learned from either."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False)).alias("held_out")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = language.fit(docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    return language.predict(docs, model).select("doc_id", _held_out(4, 2), "lang_pred", "score")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    return quality.score(docs, model).select("doc_id", _held_out(3, 1), F.col("quality_score").alias("score"),
                                             (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = _read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(more)
    out = chat.format_conversations(turns).select(
        "conv_id", F.length("formatted").cast("long").alias("formatted_chars"), chat.read_turns(F.col("formatted")).alias("turns"),
        chat.read_loss(F.col("formatted"), F.col("loss")).alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
                      F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


OP9_SQL = r"""
WITH turns AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', ''))
      + len(regexp_extract_all(text, '<\|role\|>|<\|turn\|>|</?s>|\[/?INST\]|<<SYS>>|<</SYS>>')) AS text_len,
    length(role) + length(role) - length(replace(role, '\', ''))
      + len(regexp_extract_all(role, '<\|role\|>|<\|turn\|>|</?s>|\[/?INST\]|<<SYS>>|<</SYS>>')) AS role_len,
    row_number() OVER w AS k, lag(role) OVER w AS before
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(text_len + CASE WHEN before IS DISTINCT FROM role OR k = 1 THEN length('<s><|role|></s>') + role_len ELSE length('<|turn|>') END)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""


def op10_byte_pair_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = byte_pair.encode_and_decode(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    return toxicity.score(docs, model).select("doc_id", _held_out(3, 1), F.col("toxicity").alias("score"),
                                              (F.col("toxicity") >= 0.7).cast("int").alias("predicted"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_read(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {f.__name__: f for f in (op1_minhash_near_dedup, op2_source_mixing, op3_document_fingerprints, op4_substring_dedup,
                                   op5_nearest_neighbours, op6_token_counts, op7_language_id, op8_quality_classifier,
                                   op9_chat_formatting, op10_byte_pair_encoding, op11_toxicity, op12_spelling_variants, op13_importance_resampling)}
ORACLE_SQL = {"op9_chat_formatting": OP9_SQL}
