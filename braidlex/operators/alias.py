"""Weighted draws in constant time: alias tables built by prefix sums.

A group of n values becomes n buckets of equal mass. A bucket holds its own
value up to a threshold and one other value, its alias, above it; a draw
chooses a bucket, then a side. So a draw is one lookup, whatever the size of
the pool.

The tables are built without a loop. Lay the gaps of the light values (below
the mean) and the surpluses of the heavy ones end to end on two equal lines, in
the order of the values. A light bucket is filled by the heavy value that
stands where its gap begins. A heavy value that ends inside a gap has given too
much; it keeps what is left and is filled by the next heavy one. All of it are
running sums and lookups in windows of the group, in whole numbers, so any
engine builds the same table. A group's windows are one task's sort, which
may spill; groups are built side by side.

Defined results. Weights that are null, negative or not finite count as 0, and
a value of weight 0 is never drawn. Repeated values add up; null values are
left out. A group without a positive weight has no table: rows that draw from
it, or from an unknown group, get null. Weights are rounded to a part in
2**30 of the group's largest (fewer bits above four million values).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of the digest that make one uniform number, and their range.
DIGITS, RANGE = 13, 16.0**13
_WHOLE = "decimal(38,0)"


def whole_weights(pool: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """One row a group and value: by, value, w (long, at least 0) of groups that have a positive weight."""
    group = Window.partitionBy(*by)
    real = F.col(weight).cast("double")
    rows = pool.filter(F.col(value).isNotNull()).select(*by, value, F.when((real > 0) & (real < float("inf")), real).otherwise(0.0).alias("__real"))
    bits = F.least(F.lit(30), F.lit(52) - F.length(F.bin(F.count(F.lit(1)).over(group))))  # the sum of a group stays below 2**53
    scaled = rows.withColumns({"__most": F.max("__real").over(group), "__scale": F.pow(F.lit(2.0), bits)}).filter("__most > 0")
    return scaled.groupBy(*by, value).agg(F.sum(F.floor(F.col("__real") / F.col("__most") * F.col("__scale") + 0.5)).alias("w"))


def alias_table(pool: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """by, bucket (from 0, in the order of the values), value, ``alias``, threshold, total, n: a bucket gives its value below threshold / total, else its alias."""
    group = Window.partitionBy(*by)
    w = F.col("w").cast("decimal(20,0)")
    sized = whole_weights(pool, by, value, weight).withColumns({"n": F.count(F.lit(1)).over(group), "total": F.sum("w").over(group), "bucket": F.row_number().over(group.orderBy(value)) - F.lit(1)})
    surplus = (F.col("n").cast("decimal(18,0)") * w).cast(_WHOLE) - F.col("total").cast(_WHOLE)
    gaps = sized.withColumn("__surplus", surplus.cast(_WHOLE)).withColumns({"__heavy": F.col("__surplus") > 0, "__gap": F.abs("__surplus")})
    side = Window.partitionBy(*by, "__heavy").orderBy(value)
    lines = gaps.withColumns({"__end": F.sum("__gap").over(side).cast(_WHOLE), "__next": F.lead(value).over(side)}).withColumn("__begin", (F.col("__end") - F.col("__gap")).cast(_WHOLE))
    # heavy values go before light ones that begin at the same place: they fill them, and do not end inside them
    heavy_first = (~F.col("__heavy")).cast("int")
    filling = F.last(F.when(F.col("__heavy"), F.col(value)), ignorenulls=True).over(group.orderBy("__begin", heavy_first, value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    edge = F.when(F.col("__heavy"), F.col("__end")).otherwise(F.col("__begin"))
    filled_to = F.max(F.when(~F.col("__heavy"), F.col("__end"))).over(group.orderBy(edge, heavy_first, value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = lines.withColumns({"__filling": filling, "__filled": filled_to})
    lacking = F.when(F.col("__heavy"), F.greatest(F.coalesce(F.col("__filled"), F.lit(0).cast(_WHOLE)) - F.col("__end"), F.lit(0).cast(_WHOLE))).otherwise(F.col("__gap"))
    other = F.when(F.col("__heavy"), F.col("__next")).otherwise(F.col("__filling"))
    return met.select(*by, F.col("bucket").cast("long"), value, F.coalesce(F.when(lacking > 0, other), F.col(value)).alias("alias"), (F.col("total") - lacking.cast("long")).alias("threshold"), "total", "n")


def uniform(stage: str, seed: int, row: Column, which: int) -> Column:
    """The first or second uniform number of a row's digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}|{stage}|"), row.cast("string")))
    return F.conv(F.substring(digest, 1 + which * DIGITS, DIGITS), 16, 10).cast("double") / F.lit(RANGE)


def alias_draw(rows: DataFrame, table: DataFrame, by: list[str], value: str, stage: str, seed: int = 42, row: str = "row", name: str | None = None) -> DataFrame:
    """``rows`` plus a value drawn from the table of their group (null where there is none).

    The sizes of the groups come from the tables' first buckets, without an
    aggregate, so that Spark can split a hot group; the buckets of a group are
    drawn evenly, so the second join spreads it.
    """
    name = name or value
    sizes = table.filter("bucket = 0").select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("n").alias("__n"))
    on_group = F.lit(True)
    for c in by:
        on_group = on_group & (F.col(c) == F.col(f"__by_{c}"))
    sized = rows.join(sizes, on_group, "left").drop(*[f"__by_{c}" for c in by])  # one row a group
    chosen = sized.withColumn("__bucket", F.floor(uniform(stage, seed, F.col(row), 0) * F.col("__n")))
    buckets = table.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("bucket").alias("__of"), F.col(value).alias("__own"), F.col("alias").alias("__alias"), F.col("threshold").alias("__threshold"), F.col("total").alias("__total"))
    own_side = uniform(stage, seed, F.col(row), 1) * F.col("__total") < F.col("__threshold")
    drawn = chosen.join(buckets, on_group & (F.col("__bucket") == F.col("__of")), "left").withColumn(name, F.when(own_side, F.col("__own")).otherwise(F.col("__alias")))
    return drawn.drop("__n", "__bucket", "__of", "__own", "__alias", "__threshold", "__total", *[f"__by_{c}" for c in by])


def alias_sql(pool: str, by: str, value: str, weight: str, name: str = "alias") -> str:
    """DuckDB CTEs for ``alias_table`` (groups up to four million values): the lookups are as-of joins."""
    real = f"CASE WHEN {weight} > 0 AND {weight} < 'inf'::DOUBLE THEN {weight}::DOUBLE ELSE 0.0::DOUBLE END"
    return f"""{name}_p AS (SELECT {by} AS g, {value} AS v, {real} AS r, max({real}) OVER (PARTITION BY {by}) AS most FROM {pool} WHERE {value} IS NOT NULL),
{name}_w AS (SELECT g, v, sum(floor(r / most * 1073741824::DOUBLE + 0.5::DOUBLE)::BIGINT)::HUGEINT AS w FROM {name}_p WHERE most > 0 GROUP BY g, v),
{name}_s AS (SELECT *, count(*) OVER (PARTITION BY g) AS n, sum(w) OVER (PARTITION BY g) AS total, row_number() OVER (PARTITION BY g ORDER BY v) - 1 AS bucket FROM {name}_w),
{name}_l AS (SELECT *, n * w > total AS heavy, abs(n * w - total) AS gap, sum(abs(n * w - total)) OVER (PARTITION BY g, n * w > total ORDER BY v) AS upto, lead(v) OVER (PARTITION BY g, n * w > total ORDER BY v) AS after FROM {name}_s),
{name}_h AS (SELECT *, upto - gap AS begins FROM {name}_l WHERE heavy), {name}_f AS (SELECT *, upto - gap AS begins FROM {name}_l WHERE NOT heavy AND gap > 0),
{name} AS (SELECT g, v, w, n, total, bucket, total AS threshold, v AS other FROM {name}_l WHERE gap = 0
UNION ALL SELECT f.g, f.v, f.w, f.n, f.total, f.bucket, f.total - f.gap, h.v FROM {name}_f f ASOF JOIN {name}_h h ON f.g = h.g AND f.begins >= h.begins
UNION ALL SELECT h.g, h.v, h.w, h.n, h.total, h.bucket, h.total - greatest(coalesce(f.upto, 0) - h.upto, 0), CASE WHEN f.upto > h.upto THEN h.after ELSE h.v END FROM {name}_h h ASOF LEFT JOIN {name}_f f ON h.g = f.g AND h.upto > f.begins)"""


def uniform_sql(stage: str, seed: int, row: str, which: int) -> str:
    return f"(('0x' || substr(md5('{seed}|{stage}|' || {row}), {1 + which * DIGITS}, {DIGITS}))::BIGINT / {RANGE:.0f}::DOUBLE)"


def alias_draw_sql(rows: str, group: str, stage: str, seed: int, row: str, drawn: str, name: str = "alias") -> str:
    """DuckDB SELECT of all columns of ``rows`` and the drawn value."""
    u = lambda which: uniform_sql(stage, seed, f"r.{row}", which)
    return f"""SELECT r.*, CASE WHEN {u(1)} * b.total::DOUBLE < b.threshold::DOUBLE THEN b.v ELSE b.other END AS {drawn}
FROM {rows} r LEFT JOIN (SELECT DISTINCT g, n FROM {name}) s ON s.g = {group} LEFT JOIN {name} b ON b.g = s.g AND b.bucket = floor({u(0)} * s.n)::BIGINT"""
