"""Every query of the engine with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from braidlex.plans import dialogues, evaluation, generation, pools, retrieval

Query = Callable[[SparkSession, str], DataFrame]
PARTS = (evaluation, dialogues, generation, pools, retrieval)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluator's verdict on every document."""
    return queries()["q_verdict"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: query for part in PARTS for name, query in part.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.oracle_sql().items()}
