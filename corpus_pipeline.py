"""Cleaning pipeline over ``documents``: toxicity, near duplicates, benchmark leaks, mixture, shards.

Each stage is one operator of ``braidlex.llm`` over all documents that the
stage before it kept; its result is written as Parquet in the shared folder
and read again by the next one. All stages but the last return the columns of
``documents``.

There is no SQL for the rows of ``run``: the toxicity model is fitted
iteratively and the fingerprints are XXH64, which SQL does not have; the tests
compare each stage with brute force.

Defined results. Documents with null or empty text: not toxic, near copies of
each other (one stays), no leak, weight 0 in the mixture (no words), so they
are not drawn. Rows without an id are compared like all others in the near-copy
stage, which keeps the one with an id where there is one, and share one draw of
the mixture; texts that share an id are told apart by the text. Repeated rows:
one stays in the near-copy stage. An empty table passes through all stages. Extra columns, whatever their names, come with
their documents up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from braidlex.llm import decontaminate, mixing, sharding, simhash_dedup, toxicity
from braidlex.llm.base import cut, table
from braidlex.llm.queries import MIX_POWERS

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model rejects go; it learns from the labels of all input documents."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id stays; five-word shingles."""
    return simhash_dedup.keep_one(docs, shingle=5)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a passage with a test item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def draw_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by calibrated probabilities; a document comes as often as it is drawn."""
    return mixing.sample(docs, MIX_POWERS)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets a shard and a slot."""
    return sharding.digest(docs, shards=24)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", draw_mixture),
    ("sharding", deal_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
