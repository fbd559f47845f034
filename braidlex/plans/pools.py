"""Draws from long pools by alias tables: customers as personas, weighted by their balance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidlex.operators.alias import alias_draw, alias_draw_sql, alias_sql, alias_table
from braidlex.plans.tables import cut


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_mktsegment", "c_custkey", "c_acctbal")


def dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as dialogues to fill; each asks for the segment of its customer."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return orders.join(pool(spark, sf_dir).select("c_custkey", "c_mktsegment"), "c_custkey").select("o_orderkey", "c_mktsegment")


def one_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = cut(alias_table(pool(spark, sf_dir), [], "c_custkey", "c_acctbal"), "alias")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    return alias_draw(rows, table, [], "c_custkey", "pool", row="o_orderkey", name="drawn")


def pool_a_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = cut(alias_table(pool(spark, sf_dir), ["c_mktsegment"], "c_custkey", "c_acctbal"), "alias")
    return alias_draw(dialogues(spark, sf_dir), table, ["c_mktsegment"], "c_custkey", "segment", row="o_orderkey", name="drawn")


def masses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the buckets hold of each value; the twin knows it from the weights alone."""
    table = alias_table(pool(spark, sf_dir), ["c_mktsegment"], "c_custkey", "c_acctbal")
    parts = F.array(F.struct(F.col("c_custkey").alias("value"), F.col("threshold").alias("mass")), F.struct(F.col("alias").alias("value"), (F.col("total") - F.col("threshold")).alias("mass")))
    return table.select("c_mktsegment", F.explode(parts).alias("part")).groupBy("c_mktsegment", "part.value").agg(F.sum("part.mass").alias("mass")).withColumnRenamed("value", "c_custkey")


def queries() -> dict:
    return {"sa1_pool_draw": one_pool, "sa3_pool_draw_by_group": pool_a_segment, "sa1_alias_mass": masses}


def oracle_sql() -> dict:
    whole, by_segment = alias_sql("customer", "0", "c_custkey", "c_acctbal"), alias_sql("customer", "c_mktsegment", "c_custkey", "c_acctbal")
    asked = "(SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey)"
    return {
        "sa1_pool_draw": f"WITH {whole}\n{alias_draw_sql('(SELECT o_orderkey FROM orders)', '0', 'pool', 42, 'o_orderkey', 'drawn')}",
        "sa3_pool_draw_by_group": f"WITH {by_segment}\n{alias_draw_sql(asked, 'r.c_mktsegment', 'segment', 42, 'o_orderkey', 'drawn')}",
        "sa1_alias_mass": """WITH p AS (SELECT c_mktsegment, c_custkey, greatest(c_acctbal, 0.0::DOUBLE) AS r, max(greatest(c_acctbal, 0.0::DOUBLE)) OVER (PARTITION BY c_mktsegment) AS most FROM customer)
SELECT c_mktsegment, c_custkey, (count(*) OVER (PARTITION BY c_mktsegment) * floor(r / most * 1073741824::DOUBLE + 0.5::DOUBLE))::BIGINT AS mass FROM p WHERE most > 0""",
    }
