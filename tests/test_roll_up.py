"""Roll-ups of dialogues against their SQL twins where a mean is a half, and where a role is missing."""

import duckdb
import pytest
from pyspark.sql import functions as F

from braidlex.operators import dialogue as D
from braidlex.plans import registry


def test_mean_score_is_rounded_as_in_sql(spark):
    lists = [[9.8, 9.35], [8.4, 8.65], [9.0, None], [None], [], [8.405], [1.005, 1.005], [9.35, 9.8, 0.1, 0.2, 0.3]]
    got = [r.x for r in spark.createDataFrame(list(enumerate(lists)), "i int, s array<double>").coalesce(1).orderBy("i").select(D.mean_score(F.col("s")).alias("x")).collect()]
    assert got == [duckdb.execute("SELECT round(avg(x), 2) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [s]).fetchone()[0] for s in lists]
    assert got[0] == 9.57  # 957.4999999999999 hundredths, 9.575 in decimals


@pytest.mark.parametrize("name", ["dg10_roll_up", "dg20_dialogue_json"])
def test_rolled_up_dialogues_equal_their_sql(spark, tmp_path, name):
    turns = [
        (1604, 0, "user", "la " * 7 + "word " * 33), (1604, 1, "assistant", "la " * 9 + "word " * 23), (7, 1, None, "oui of course"), (7, 0, "user", None),
        (8, 0, "user", "une \"line\"\n\\ \x01 \x1f / é 😀 data"),
    ]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    got = registry.queries()[name](spark, str(tmp_path)).collect()
    duckdb.execute(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = duckdb.execute(registry.oracle_sql()[name]).fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 3
