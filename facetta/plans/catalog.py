"""The registered queries and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from facetta.plans import frames, images, jobs, retrieval, scoring, templates, texts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {}
    for name in templates.PLANS:
        found[name] = lambda spark, sf_dir, name=name: templates.run(spark, sf_dir, name)
    return found | retrieval.QUERIES | texts.QUERIES | images.QUERIES | frames.QUERIES | scoring.QUERIES | jobs.QUERIES


def oracle_sql() -> dict[str, str]:
    return {name: templates.oracle(name) for name in templates.PLANS} | retrieval.ORACLES | texts.ORACLES | frames.ORACLES | images.ORACLES | scoring.ORACLES | jobs.ORACLES
