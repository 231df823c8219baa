"""The corpus pipeline: classify, deduplicate, decontaminate, mix, tokenise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from facetta.llm import decontaminate, mixing, quality_classifier, simhash, token_output
from facetta.llm.common import stored, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays."""
    return simhash.keep_one(docs)


def decontaminate_docs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"), null_items=True)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their source takes them."""
    return mixing.mixed_texts(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: one row for each document."""
    return token_output.token_records(docs)


STAGES = [("quality classifier", classify), ("SimHash near-dedup", deduplicate), ("benchmark decontamination", decontaminate_docs), ("mixing sources", mix), ("token-ID output", tokenise)]

#: Fingerprints, neighbours and token ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs, _ = stored(spark, docs, f"pipeline-{i}")
    return docs
