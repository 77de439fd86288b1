"""One query for each operator of this subpackage, with production parameters and over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat_repair, exact_dedup, language_filters, line_dedup, line_rules, mil_quality, mixing, quotes, sharding, simhash, sp_transducer, toxicity, vector_codes
from .common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.linked_conversations(table(spark, sf_dir, "conversations"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.fair_queue(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "turns", "taken")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_rules.line_verdicts(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_common_words")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_common_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_transducer.encoded(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("text_md5")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mil_quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_filters.languages(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.repair_conversations(table(spark, sf_dir, "conversations"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))
    digest = F.lit(vector_codes.codebook_digest(books)).alias("codebooks_sha256")
    return vector_codes.with_label_error(coded).select("vec_id", "code", "error", "label_error", digest)


def queries() -> dict:
    return {f.__name__: f for f in (op1_sharding, op2_chat_formatting, op3_mixing, op4_quality_rules, op5_line_dedup, op6_sentencepiece, op7_exact_dedup, op8_quality_classifier, op9_simhash, op10_toxicity, op11_language_id, op12_conversation_repair, op13_vector_codes)}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return dict(ORACLES)
