"""The queries of this subpackage by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, collocations, cotraining, decontamination, exact_dedup, hard_negatives, language_id, mixing, ngram_join, piece_codec, repetition, token_store, url_filters
from .common import table


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.formatted_conversations(table(spark, sf_dir, "conversations"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("fingerprint")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.codec_summary(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(table(spark, sf_dir, "documents"), 3, Fraction(90, 100))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filtered_pages(table(spark, sf_dir, "pages"))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_output(table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_summary(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.quality_rules(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("case when vec_id % 7 = 0 then (cast(label as bigint) + 1) % 10 else label end")
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chat_format, op2_exact_dedup, op3_sentencepiece, op4_ngram_jaccard_join, op5_url_filters, op6_token_output, op7_source_mixing, op8_quality_classifier, op9_quality_rules, op10_language_id, op11_phrase_mining, op12_hard_negatives, op13_decontamination)}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": exact_dedup.ORACLE, "op4_ngram_jaccard_join": ngram_join.ORACLE, "op5_url_filters": url_filters.ORACLE, "op9_quality_rules": repetition.ORACLE, "op11_phrase_mining": collocations.ORACLE, "op12_hard_negatives": hard_negatives.ORACLE, "op13_decontamination": decontamination.ORACLE}
