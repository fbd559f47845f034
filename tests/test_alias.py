"""Alias tables hold the weights exactly, and draws follow them."""

import math

import pytest
from pyspark.sql import functions as F

from braidlex.operators import alias, sampling


def masses(table):
    """The mass of each value of each group, from the buckets alone."""
    held = {}
    for r in table.collect():
        assert 0 <= r.threshold <= r.total
        held[r.g, r.v] = held.get((r.g, r.v), 0) + r.threshold
        held[r.g, r.alias] = held.get((r.g, r.alias), 0) + r.total - r.threshold
    return held


POOLS = {
    "one": [5.0], "even": [1.0] * 7, "steep": [2.0**-k for k in range(20)], "one heavy": [1000.0, *[1.0] * 30], "zeros": [0.0, 3.0, 0.0, 1.0, 0.0], "light last": [9.0, 8.0, 7.0, 1.0, 1.0, 1.0], "light first": [1.0, 1.0, 1.0, 7.0, 8.0, 9.0],
    "ends meet": [1.0, 3.0, 1.0, 3.0], "mixed": [float(1 + k * k % 17) for k in range(101)], "bad": [math.nan, -1.0, math.inf, 2.0, 4.0],
}


def test_masses_are_the_weights(spark):
    pool = spark.createDataFrame([(g, i, w) for g, ws in POOLS.items() for i, w in enumerate(ws)], "g string, v long, weight double")
    table = alias.alias_table(pool, ["g"], "v", "weight").cache()
    held = masses(table)
    whole = {(r.g, r.v): r.w for r in alias.whole_weights(pool, ["g"], "v", "weight").collect()}
    for (g, v), w in whole.items():
        n = len(POOLS[g])
        assert held[g, v] == n * w, (g, v)
    buckets = {g: sorted(r.bucket for r in table.collect() if r.g == g) for g in POOLS}
    assert buckets == {g: list(range(len(ws))) for g, ws in POOLS.items()}
    table.unpersist()


def test_repeats_nulls_and_groups_without_weight(spark):
    rows = [("a", 1, 1.0), ("a", 1, 1.0), ("a", 2, 2.0), ("a", None, 50.0), ("a", 3, None), ("none", 1, 0.0), ("none", 2, None)]
    table = alias.alias_table(spark.createDataFrame(rows, "g string, v long, weight double"), ["g"], "v", "weight")
    held = masses(table)
    assert held["a", 1] == held["a", 2] and held["a", 3] == 0 and {g for g, _ in held} == {"a"}
    asked = spark.createDataFrame([(i, g) for i in range(400) for g in ("a", "none", "other", None)], "row long, g string")
    drawn = alias.alias_draw(asked, table, ["g"], "v", "s")
    assert drawn.columns == ["row", "g", "v"] and drawn.count() == 1600
    seen = {(r.g, r.v): r["count"] for r in drawn.groupBy("g", "v").count().collect()}
    assert set(seen) == {("a", 1), ("a", 2), ("none", None), ("other", None), (None, None)} and abs(seen["a", 1] - 200) < 60


def test_empty_pool_and_empty_rows(spark):
    pool = spark.createDataFrame([], "v string, weight double")
    table = alias.alias_table(pool, [], "v", "weight")
    assert table.count() == 0
    assert [r.v for r in alias.alias_draw(spark.range(3).withColumnRenamed("id", "row"), table, [], "v", "s").collect()] == [None] * 3
    full = alias.alias_table(spark.createDataFrame([("x", 1.0)], "v string, weight double"), [], "v", "weight")
    assert alias.alias_draw(spark.range(0).withColumnRenamed("id", "row"), full, [], "v", "s").count() == 0


@pytest.mark.parametrize("size", [10_000, 200_000])
def test_draws_of_a_large_pool_follow_the_weights(spark, size):
    weight = F.when(F.col("id") % 1000 == 0, 50.0).otherwise(1.0 + F.col("id") % 5)
    table = alias.alias_table(spark.range(size).select(F.col("id").alias("v"), weight.alias("weight")), [], "v", "weight")
    drawn = alias.alias_draw(spark.range(60_000).withColumnRenamed("id", "row"), table, [], "v", "s")
    got = drawn.agg(F.count("v").alias("n"), F.sum((F.col("v") % 1000 == 0).cast("int")).alias("rare"), F.sum((F.col("v") % 5 == 4).cast("int")).alias("fives"), F.countDistinct("v").alias("kinds")).first()
    expected = 50.0 / (50.0 + 999 * 3.0 + 2.0)  # a thousand values weigh 50 and, the rest, 3 on average
    assert got.n == 60_000 and abs(got.rare / 60_000 - expected) < 0.003 and abs(got.fives / 60_000 - 1000 / 3049) < 0.01 and got.kinds > 5000


def test_profiles_by_alias_tables(spark):
    """The same rules and weights as the cumulative form."""
    rows, dims = spark.range(6000).withColumnRenamed("id", "row"), sampling.dimensions(spark)
    plain, tables = sampling.sample(rows, dims), sampling.sample(rows, dims, tables=True)
    assert sorted(plain.columns) == sorted(tables.columns) and tables.count() == 6000
    share = lambda df, c: {r[c]: r["count"] / 6000 for r in df.groupBy(c).count().collect()}
    for column in ("persona", "archetype", "topic", "relationship", "dialogue_type"):
        a, b = share(plain, column), share(tables, column)
        assert set(a) == set(b) and all(abs(a[k] - b[k]) < 0.035 for k in a), column
