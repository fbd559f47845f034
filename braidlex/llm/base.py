"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64

#: Entries of a worker's word-hash cache before it is emptied (about 60 MB).
CACHE_WORDS = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a folder of our own only where it is unset and Spark runs on one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="braidlex-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables."""
    return f"{shared_dir(spark)}/braidlex/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Remove the intermediate tables of this application; results that are not written yet can no longer be computed."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, label: str = "step", compression: str = "snappy") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Lineage ends there, each row is computed once, and a lost executor costs
    only the tasks it was running. ``release`` removes the tables.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class WordHashes(dict):
    """Word (bytes) to a 64-bit hash; a bounded cache in front of XXH3."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def hash_words(words: list[bytes], cache: WordHashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), dtype=U64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, so that their order looks random."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x = x ^ (x >> U64(27))
    x = x * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


class Rolling:
    """Polynomial hashes (mod 2^64) of any run of words in one array."""

    def __init__(self, words: np.ndarray, base: int) -> None:
        n = len(words)
        inverse = pow(base, -1, 1 << 64)
        self.inverse_powers = _powers(inverse, n + 1)
        self.prefix = np.zeros(n + 1, U64)
        np.cumsum(words * _powers(base, n), out=self.prefix[1:])

    def runs(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.prefix[stop] - self.prefix[start]) * self.inverse_powers[start]

    def windows(self, length: int) -> np.ndarray:
        count = len(self.prefix) - length
        if count <= 0:
            return np.zeros(0, U64)
        return (self.prefix[length:] - self.prefix[:count]) * self.inverse_powers[:count]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


#: Rows of one key that a join takes to one task.
HOT_ROWS = 100_000


def split_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``left`` joined to ``right``, which has one row a key; keys with more than HOT_ROWS rows on the left are cut into parts.

    ``left`` is a written table, so that a row's partition is the same whenever it is read.
    """
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > HOT_ROWS)
    hot = cut(counts.select(key, F.ceil(F.col("__n") / HOT_ROWS).cast("int").alias("__parts")), "hot")
    if hot.isEmpty():
        return left.join(right, key, how)
    small = F.broadcast(hot)  # a row for at least HOT_ROWS rows of the left side
    parts = F.coalesce("__parts", F.lit(1))
    salted = left.join(small, key, "left").withColumn("__part", F.pmod(F.xxhash64(F.spark_partition_id(), *left.columns), parts).cast("int")).drop("__parts")
    many = right.join(small, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return salted.join(many, [key, "__part"], how).drop("__part")


#: Copies of a row that are written out at a time.
COPIES = 8192


def repeated(df: DataFrame, copies: str, number: str = "__copy") -> DataFrame:
    """Each row as often as ``copies`` says, numbered from 0 in ``number``; no array is longer than COPIES or one COPIES-th of the copies."""
    stretch = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(copies) - 1) / COPIES)))
    copy = F.explode(F.sequence(F.col("__stretch") * COPIES, F.least(copies, (F.col("__stretch") + 1) * COPIES) - 1))
    return df.filter(F.col(copies) > 0).withColumn("__stretch", stretch).withColumn(number, copy).drop("__stretch")


def columns_as(df: DataFrame, **types: str) -> DataFrame:
    """The named columns with the named types; a column that has its type is taken as it is, so equal scans stay equal."""
    have = dict(df.dtypes)
    return df.select(*[name if have[name] == kind else df[name].cast(kind).alias(name) for name, kind in types.items()])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def binary(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def doc_chunks(batches: Iterator[pa.RecordBatch], size_of, limit: int) -> Iterator[list[dict]]:
    """Rows gathered until the sum of ``size_of(row)`` reaches ``limit``; bounds a worker's memory."""
    rows, total = [], 0
    for batch in batches:
        for row in batch.to_pylist():
            rows.append(row)
            total += size_of(row)
            if total >= limit:
                yield rows
                rows, total = [], 0
    if rows:
        yield rows
