"""Importance resampling towards a target distribution, with hashed n-grams.

Features are runs of 1 to ``length`` words, joined by a space, in ``buckets``
of their CRC-32. One scan of a document keeps a ring of running zlib states,
one for each of its last ``length`` starts; each word starts a state and
extends the others by a space and itself, and every state met is a feature. So
no n-gram is built, and a text of any length needs a ring and one piece of
buckets. The scan emits the buckets; they are written once and read twice.

The corpus and the target are counted by partition (``buckets`` numbers each)
and added up by bucket. A bucket's gain is floor(1000 * ln((t + 1) * (S +
buckets) / ((s + 1) * (T + buckets)))), s of S the corpus' and t of T the
target's counts with one added to each. A document's weight is the sum of its
features' gains. Drawing a share without replacement adds Gumbel noise of a
seeded hash of the id to the weight and takes the highest scores. Places in
that order come from ranges that Spark samples and their prefix sums; equal
rows are one row with a count meanwhile, so no task sorts more than a range.

What the driver and every task hold is one number a bucket, a parameter.

Defined results. Null or empty text: no features, weight 0, never drawn. A null
id draws its noise as the empty string and comes last among ties. Repeated rows
count as often as they stand there and get places side by side. An empty corpus
gives an empty table; an empty target has T = 0. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import binary, columns_as, cut, repeated

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Features held as Python integers at a time, and bytes of buckets in one Arrow batch.
PIECE, BATCH_BYTES = 300_000, 16_000_000
#: Rows of a range of scores, on average.
RANGE_ROWS = 500_000
_HASHES = float(1 << 32)


def bucket_type(buckets: int) -> np.dtype:
    return np.dtype("<u2" if buckets <= 1 << 16 else "<u4")


def scan(text: bytes, length: int, buckets: int) -> tuple[int, bytes]:
    """The number of words and the buckets of all features, by a ring of running CRC states."""
    kind = bucket_type(buckets)
    pieces: list[bytes] = []
    met: list[int] = []
    ring: list[int] = []
    n_words = 0

    def flush() -> None:
        pieces.append((np.array(met, np.uint32) % np.uint32(buckets)).astype(kind).tobytes())
        met.clear()

    for match in _WORD.finditer(text.translate(_LOWER)):
        word = match[0]
        spaced = b" " + word
        ring = [crc32(word), *[crc32(spaced, state) for state in ring]]
        met += ring
        n_words += 1
        if len(ring) == length:
            ring.pop()  # the oldest start is complete
        if len(met) >= PIECE:
            flush()
    flush()
    return n_words, b"".join(pieces)


def features(docs: DataFrame, key: str | None, length: int = 3, buckets: int = 10_000) -> DataFrame:
    """key (where named), n_words and ``found``, the buckets of all features as packed integers."""
    keys = [key] if key else []
    texts = columns_as(docs, **dict.fromkeys(keys, "bigint"), text="string")

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        names = [*keys, "n_words", "found"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [*[pa.int64()] * (1 + len(keys)), pa.binary()])], names=names)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            ids = [batch.column(k).to_pylist() for k in keys]
            for row in zip(*ids, binary(batch.column("text"))):
                n_words, found = scan(row[-1] or b"", length, buckets)
                rows.append((*row[:-1], n_words, found))
                size += len(found) + 64
                if size >= BATCH_BYTES:
                    yield batch_of(rows)
                    rows, size = [], 0
        if rows:
            yield batch_of(rows)

    return texts.mapInArrow(rows_of, ", ".join([*[f"`{k}` long" for k in keys], "n_words long", "found binary"]))


def unpacked(column: pa.Array, kind: np.dtype) -> Iterator[np.ndarray]:
    for value in column:
        yield np.frombuffer(value.as_buffer(), kind) if value.is_valid else np.zeros(0, kind)


def counts(found: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket stands in ``found``; one number a bucket to the driver."""
    kind = bucket_type(buckets)

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for one in unpacked(batch.column("found"), kind):
                total += np.bincount(one, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in found.select("found").mapInArrow(of_partition, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket."""
    b, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    ratio = [float((t + 1) * (s_all + b)) / float((s + 1) * (t_all + b)) for s, t in zip(corpus.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weights(found: DataFrame, key: str, gain: np.ndarray) -> DataFrame:
    """key, n_words, n_features, weight."""
    kind = bucket_type(len(gain))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, weight = [], []
            for one in unpacked(batch.column("found"), kind):
                n.append(len(one))
                weight.append(int(gain[one].sum()))
            columns = [batch.column(key), batch.column("n_words"), pa.array(n, pa.int64()), pa.array(weight, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "n_words", "n_features", "weight"])

    return found.mapInArrow(rows_of, f"`{key}` long, n_words long, n_features long, weight long")


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of a SHA-256."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(_HASHES)
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln(uniform)))


def placed(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` plus ``rank``: places from 1 by falling score, ties by ``key`` (null last)."""
    equal = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("__copies"))
    order = [F.desc("score"), F.asc_nulls_last(key), *[F.col(c) for c in rows.columns if c not in ("score", key)]]
    ranged = equal.repartitionByRange(max(1, -(-rows.count() // RANGE_ROWS)), *order)
    ranged = cut(ranged.withColumn("__range", F.spark_partition_id()), "ranged")
    ahead = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    before = ranged.groupBy("__range").agg(F.sum("__copies").alias("__n")).select("__range", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__ahead"))
    within = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("__ahead") + F.coalesce(F.sum("__copies").over(within), F.lit(0)) + 1
    return repeated(ranged.join(before, "__range").withColumn("__first", first), "__copies").select(*rows.columns, (F.col("__first") + F.col("__copy")).alias("rank"))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, length: int = 3, buckets: int = 10_000, seed: int = 42, key: str = "doc_id"
) -> DataFrame:
    """One row per document: key, n_features, weight, score, and ``rank`` for the drawn ones.

    Drawn are the highest scores, floor(percent / 100) of the documents with
    ``least_words`` words or more.
    """
    found = cut(features(docs, key, length, buckets), "buckets", "none")
    gain = gains(counts(found, buckets), counts(features(target, None, length, buckets), buckets))
    scored = cut(weights(found, key, gain).withColumn("score", F.col("weight") + noise(F.col(key), seed)), "scored")
    long_enough = scored.filter(F.col("n_words") >= least_words)
    drawn = long_enough.count() * percent // 100
    ranks = placed(long_enough, key).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    short = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranks.unionByName(short).select(key, "n_features", "weight", "score", "rank", "n_words")
