"""Places in an order without sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidlex.plans.tables import cut

#: Rows of a range, on average.
RANGE_ROWS = 500_000


def in_ranges(df: DataFrame, key: str) -> DataFrame:
    """``df`` written in ranges of its key, with the number of each row's range.

    Spark samples the key, so ranges hold about RANGE_ROWS rows each, however
    the keys lie; their number grows with the table.
    """
    ranges = max(1, -(-df.count() // RANGE_ROWS))
    ranged = df.repartitionByRange(ranges, key) if ranges > 1 else df.coalesce(1)
    return cut(ranged.withColumn("__range", F.spark_partition_id()), "ranged")


def place_in_order(ranged: DataFrame, by: list[str], key: str, name: str, counted: str | None = None) -> DataFrame:
    """``ranged`` (of ``in_ranges``) plus the number of rows of its group with a smaller key (rows of one key are not before each other).

    With ``counted``, a boolean column, only rows where it holds are counted.

    Rows are counted by group and range, the counts are summed up to each
    range, and rows are ranked within their range only.
    """
    one = F.col(counted).cast("long") if counted else F.lit(1).cast("long")
    counts = ranged.groupBy(*by, "__range").agg(F.sum(one).alias("__n"))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select(*by, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__ahead"))
    up_to = F.sum(one).over(Window.partitionBy(*by, "__range").orderBy(key).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    alike = F.sum(one).over(Window.partitionBy(*by, "__range", key))
    return ranged.join(ahead, [*by, "__range"]).withColumn(name, F.col("__ahead") + F.coalesce(up_to - alike, F.lit(0))).drop("__ahead")


#: Rows of one key that a join takes to one task, and keys that are broadcast at most.
HOT_ROWS, HOT_KEYS = 1_000_000, 50_000


def with_first(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """``rows`` plus the smallest ``value`` of their key; no key meets one task with more than its bound of rows.

    First occurrences come from an aggregate with partial minima and are
    written with their counts. Keys with more rows than the bound get theirs
    where their rows are, from a broadcast; all others by a shuffle. The bound
    grows with the table so that at most ``HOT_KEYS`` keys can be above it:
    keys times bound cannot exceed the rows.
    """
    first = cut(rows.groupBy(key).agg(F.min(value).alias(name), F.count(F.lit(1)).alias("__n")), "first")
    return joined_to(rows, first, key)


def joined_to(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` joined to ``table``, which is written and has one row a key with the number of its ``rows`` in ``__n``; hot keys are split."""
    total = table.agg(F.sum("__n").alias("n")).first().n or 0  # one number
    bound = max(HOT_ROWS, -(-total // HOT_KEYS))
    hot = table.filter(F.col("__n") > bound).drop("__n")
    if hot.isEmpty():
        return rows.join(table.drop("__n"), key)
    few = F.broadcast(hot)
    cold = rows.join(few.select(key), key, "left_anti").join(table.filter(F.col("__n") <= bound).drop("__n"), key)
    return cold.unionByName(rows.join(few, key).select(*cold.columns))
