"""Sharding by proportional stratified interleaving.

Rows are shuffled within each source by a seeded hash and ranked; a row's
fractional rank is its place in its source over the source's size, moved by a
fixed fraction of a step for each source, so that small sources do not all
stand at one point. All rows are sorted by it and cut into shards of equal
counts: any stretch holds each source in proportion, to within one row.

No sort of a whole source runs in one task: ranks come from counts of fine
hash buckets, prefix sums over them (in two levels) and a sort within each
bucket, about ``BUCKET_ROWS`` rows, whatever the share of a source. Equal rows
are one row with a count until their places are known, so a row that is
repeated without end is one row of its bucket too.

Defined results. A null source counts as the empty name. Null text: no bytes.
A null doc_id is shuffled like any other. Repeated rows keep a slot each. An
empty table gives an empty table; with fewer rows than shards some stay empty.
``interleave`` carries extra columns through (of any type that can be grouped,
so no maps) and refuses a table that has ``shard`` or ``slot`` already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import cut, repeated

#: Rows of a bucket that are sorted together, on average.
BUCKET_ROWS = 256


def _prefix(counts: DataFrame, by: list[str], bits: int) -> DataFrame:
    """counts(by, __bucket, __cnt) plus ``__before``: rows in smaller buckets, summed in two levels."""
    coarse = counts.withColumn("__coarse", F.shiftright("__bucket", (bits + 1) // 2))
    heads = coarse.groupBy(*by, "__coarse").agg(F.sum("__cnt").alias("__m"))
    ahead = Window.partitionBy(*by).orderBy("__coarse").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(*by, "__coarse", F.coalesce(F.sum("__m").over(ahead), F.lit(0)).alias("__head"))
    inner = Window.partitionBy(*by, "__coarse").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    fine = coarse.withColumn("__within", F.coalesce(F.sum("__cnt").over(inner), F.lit(0)))
    return fine.join(heads, [*by, "__coarse"]).select(*by, "__bucket", (F.col("__head") + F.col("__within")).alias("__before"))


def ranked(df: DataFrame, by: list[str], order: list[str], bits: int, name: str, weight: Column) -> DataFrame:
    """``df`` plus the weight before it within ``by``; ``__bucket`` must grow with ``order`` and have ``bits`` bits."""
    before = _prefix(df.groupBy(*by, "__bucket").agg(F.sum(weight).alias("__cnt")), by, bits)
    inner = Window.partitionBy(*by, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = df.join(before, [*by, "__bucket"]).withColumn(name, F.col("__before") + F.coalesce(F.sum(weight).over(inner), F.lit(0)))
    return placed.drop("__bucket", "__before")


def interleave(df: DataFrame, shards: int = 24, seed: int = 11, source: str = "source", tie: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``df`` plus shard and slot; counts of shards differ by one at most. ``tie`` orders rows of one source."""
    taken = {"shard", "slot"} & set(df.columns) | {c for c in df.columns if c.startswith("__")}
    if taken:
        raise ValueError(f"columns {sorted(taken)} are in the way of the result")
    n = df.count()
    bits = max(0, (n // BUCKET_ROWS).bit_length())
    base, extra = divmod(n, shards)
    keyed = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__copies")).withColumns({
        "__source": F.coalesce(F.col(source).cast("string"), F.lit("")),
        "__h": F.shiftrightunsigned(F.xxhash64(F.lit(seed), *tie), 1),
        "__rest": F.xxhash64(*df.columns),
    }).withColumn("__bucket", F.shiftright("__h", 63 - bits))
    copies = F.col("__copies")
    in_source = ranked(keyed, ["__source"], ["__h", *tie, "__rest"], bits, "__rank", copies)
    sizes = keyed.groupBy("__source").agg(F.sum(copies).alias("__n"))
    shift = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "__source"), 11) / F.lit(float(1 << 53))
    each = repeated(in_source, "__copies").withColumn("__rank", F.col("__rank") + F.col("__copy"))
    spread = each.join(sizes, "__source").withColumn("__at", (F.col("__rank") + shift) / F.col("__n"))
    spread = spread.withColumns({"__bucket": F.least(F.floor(F.col("__at") * (1 << bits)), F.lit((1 << bits) - 1)), "__all": F.lit(0)})
    whole = ranked(spread, ["__all"], ["__at", "__source", "__rank"], bits, "__place", F.lit(1))
    place, large = F.col("__place"), extra * (base + 1)
    high = F.floor((place - large) / max(base, 1)) + extra
    shard = F.when(place < large, F.floor(place / (base + 1))).otherwise(high).cast("int")
    slot = F.when(place < large, place % (base + 1)).otherwise((place - large) % max(base, 1)).cast("long")
    return whole.select(*df.columns, shard.alias("shard"), slot.alias("slot"))


def digest(docs: DataFrame, shards: int = 24, seed: int = 11) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: the assignment without the texts."""
    light = docs.select(  # written once, so that the texts are read once
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    out = interleave(cut(light, "sizes"), shards, seed, tie=("doc_id", "text_crc32", "size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
