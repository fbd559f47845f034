"""The order of the shards recomputed row by row, and rows repeated very often."""

import zlib

import pytest
from pyspark.sql import functions as F

from braidlex.llm import sharding


def brute(spark, rows, shards, seed=11):
    """Sort each source by its hash, then all by fractional rank, then cut: in plain Python (hashes come from Spark)."""
    cols = "doc_id long, source string, size long, crc long"
    frame = spark.createDataFrame([(i, s, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, s, t in rows], cols)
    hashed = frame.select("*", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "crc", "size"), 1).alias("h"), F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce("source", F.lit(""))), 11).alias("s")).collect()
    by_source = {}
    for r in hashed:
        by_source.setdefault(r.source or "", []).append(r)
    order = []
    for source, group in by_source.items():
        group.sort(key=lambda r: (r.h, r.doc_id is not None, r.doc_id, r.crc, r.size, r.source is not None))
        order += [((k + r.s / (1 << 53)) / len(group), source, k, r) for k, r in enumerate(group)]
    order.sort(key=lambda x: x[:3])
    base, extra = divmod(len(rows), shards)
    out, at = [], 0
    for shard in range(shards):
        n = base + (shard < extra)
        out += [(str(r.doc_id), r.size, r.crc, shard, slot) for slot, (*_, r) in enumerate(order[at : at + n])]
        at += n
    return sorted(out)


@pytest.mark.parametrize("bucket", [256, 3])
def test_order_is_that_of_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", bucket)
    rows = [(i, "hot" if i % 3 else f"s{i % 5}" if i % 2 else None, "x" * (i % 11) if i % 7 else None) for i in range(200)]
    rows += [rows[5]] * 30 + [(None, "hot", "x")] * 4
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "0 AS shard", "1 AS slot")
    got = sorted((str(r.doc_id), r.size, r.text_crc32, r.shard, r.slot) for r in sharding.digest(docs, 7).collect())
    assert got == brute(spark, rows, 7)


def test_a_row_repeated_very_often(spark):
    """100 000 equal rows are one row until they get their places, so no task sorts them."""
    docs = spark.range(100_000).selectExpr("7L AS doc_id", "'same' AS text", "'hot' AS source").unionByName(spark.range(500).selectExpr("id AS doc_id", "'t' AS text", "'hot' AS source"))
    out = sharding.digest(docs, 24)
    counts = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert len(counts) == 24 and max(counts) - min(counts) <= 1 and out.groupBy("shard").agg(F.countDistinct("slot").alias("n"), F.count(F.lit(1)).alias("m")).filter("n <> m").isEmpty()


def test_columns_in_the_way(spark):
    with pytest.raises(ValueError, match="shard"):
        sharding.interleave(spark.sql("SELECT 1L AS doc_id, 'a' AS source, 2 AS shard"))
    out = sharding.interleave(spark.sql("SELECT 1L AS doc_id, 'a' AS source, array(1, 2) AS more"))
    assert out.columns == ["doc_id", "source", "more", "shard", "slot"] and out.first().more == [1, 2]
