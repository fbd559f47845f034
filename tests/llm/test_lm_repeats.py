"""Rows repeated very often are one document with copies, in chunks of bounded size."""

from pyspark.sql import functions as F

from braidlex.llm import lm_score


def test_repeated_rows_do_not_fill_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", 50_000)
    hot = spark.range(100_000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "'a b c' AS text")
    docs = hot.unionByName(spark.range(1000).selectExpr("id AS doc_id", "concat('a b ', id, ' x') AS text")).unionByName(spark.range(20_000).selectExpr("5L AS doc_id", "CAST(NULL AS STRING) AS text"))
    texts, n_bytes, n_words = lm_score._documents(docs)
    assert texts.count() == 1002 and n_words == 300_000 + 4000 and n_bytes >= 500_000
    out = lm_score.score(docs)
    counts = {r.n: r["count"] for r in out.groupBy(F.coalesce("doc_id", F.lit(-1)).alias("n")).count().filter("count > 1").collect()}
    assert counts == {-1: 100_000, 5: 20_001} and out.count() == 121_000
    # each copy leaves out its own words only, so "a b" is known to it from the other copies
    assert {r.n_backoff for r in out.filter("doc_id is null").select("n_backoff").distinct().collect()} == {0}
