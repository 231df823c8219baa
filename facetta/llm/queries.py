"""The queries of this package; each runs its operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from facetta.llm import chat, decontaminate, html_text, mixing, quality_classifier, quality_rules, simhash, token_output, url_filter, warc
from facetta.llm.common import table


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(table(spark, sf_dir, "pages"))


def op2_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.compression_quality(table(spark, sf_dir, "documents"))


def op3_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents")).drop("row_hash")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"))


def op5_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("row_hash")


def op6_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(table(spark, sf_dir, "pages"))


def op7_prefix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), null_items=True).drop("row_hash")


def op8_huffman_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_records(table(spark, sf_dir, "documents"))


def op9_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.linked_conversations(table(spark, sf_dir, "conversations"))


def op10_golden_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(table(spark, sf_dir, "documents")).drop("source", "row_hash")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    found = [op1_html_text, op2_compression_bands, op3_simhash_pivots, op4_url_filter, op5_neighbour_quality, op6_warc_segments, op7_prefix_decontamination, op8_huffman_tokens, op9_quotation_links, op10_golden_mix]
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {}
