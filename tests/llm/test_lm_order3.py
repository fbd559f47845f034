"""A registered query scores with trigrams."""

from braidlex.llm import queries


def test_order3_query_backs_off_twice(spark, tmp_path):
    rows = [(1, "a b c"), (2, "a b c"), (3, "a b d"), (4, "x y z")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.n_backoff for r in queries.queries()["op2_lm_score_order3"](spark, str(tmp_path)).collect()}
    assert got == {1: 0, 2: 0, 3: 2, 4: 3}
