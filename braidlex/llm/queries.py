"""The registered queries of this subpackage: thin digests of the operators' output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_extract, importance, license_scan, lm_score, media, mixing, sharding, simhash_dedup, substring_dedup, topk_search, toxicity, whitening
from .base import table

#: Production targets: shares proportional to a dimension's tokens to these powers.
MIX_POWERS = {"source": 0.3, "lang": 0.5, "topic": 0.7}


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.drop_repeats(table(spark, sf_dir, "documents"), window_words=20, with_text=False)


def _lm_scores(spark: SparkSession, sf_dir: str, order: int) -> DataFrame:
    scored = lm_score.score(table(spark, sf_dir, "documents"), order)
    return scored.select("doc_id", "n_words", "n_backoff", F.round("log_score", 5).alias("log_score"), F.round("mean_log_score", 7).alias("mean_log_score"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigrams, as its SQL twin."""
    return _lm_scores(spark, sf_dir, 2)


def op2_lm_score_order3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigrams with two backoff steps."""
    return _lm_scores(spark, sf_dir, 3)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and test item that share a passage."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=20, similarity=0.8)


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4, seed=42)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), MIX_POWERS)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(table(spark, sf_dir, "documents"), shards=24)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_words", F.size("passages").alias("n_passages"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files are written, read back and decoded; the tensors (rgb) are stored with the result."""
    return media.from_media(media.stored(table(spark, sf_dir, "documents")), with_tensor=True)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=4)


def op12_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5, least_words=20)


_ALL = (
    op1_substring_dedup,
    op2_lm_score,
    op2_lm_score_order3,
    op3_decontaminate,
    op4_html_extract,
    op5_simhash_dedup,
    op6_mixing,
    op7_sharding,
    op8_toxicity,
    op9_media,
    op10_license_scan,
    op11_whitening,
    op12_topk_search,
    op13_importance,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": substring_dedup.SQL, "op2_lm_score": lm_score.SQL, "op6_mixing": mixing.mix_sql(MIX_POWERS), "op12_topk_search": topk_search.search_sql()}
