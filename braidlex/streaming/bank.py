"""The example bank and the counters of a run, filled by a stream of turns.

Each micro-batch becomes one folder of the bank and one row of the counters,
both named by the batch. A batch that is run again after a failure overwrites
what it wrote, so no example is admitted twice and no turn is counted twice;
counters go on after a restart. Folders sort as batches do, and a batch's lines
are in the order of its turns, so ``config.read_examples(spark, f"{path}/*")``
numbers the examples in their order of admission.

Defined results. A turn without a score is counted as failed and not admitted.
A batch without turns leaves an empty folder and zeros.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from braidlex.plans.tables import cut

COUNTERS = ("turns", "admitted", "retries", "failed")


def admit(batch: DataFrame, number: int, path: str, least: float = 8.0, order: tuple[str, ...] = ("conv_id", "turn"), counters: str | None = None) -> None:
    """Write the good turns of one batch to the bank and its counts to ``counters``; both are functions of the batch.

    The counts are observed while the batch is written, without a pass of
    their own. It is written before it is sorted, as a sort's sample would be
    counted too.
    """
    spark = batch.sparkSession
    good = F.coalesce(F.col("score") >= least, F.lit(False))
    tries = F.coalesce(F.col("attempt") - 1, F.lit(0)) if "attempt" in batch.columns else F.lit(0)
    seen = Observation()
    sums = {"admitted": good.cast("long"), "retries": tries.cast("long"), "failed": F.col("score").isNull().cast("long")}
    written = cut(batch.observe(seen, F.count(F.lit(1)).alias("turns"), *[F.sum(x).alias(name) for name, x in sums.items()]), "batch")
    written.filter(good).orderBy(*order).write.mode("overwrite").json(f"{path}/batch-{number:012d}")
    if counters:
        found = seen.get
        row = [tuple(int(found.get(name) or 0) for name in COUNTERS)]
        spark.createDataFrame(row, ", ".join(f"{name} long" for name in COUNTERS)).coalesce(1).write.mode("overwrite").parquet(f"{counters}/batch={number}")


def append_examples(turns: DataFrame, path: str, checkpoint: str, least: float = 8.0, order: tuple[str, ...] = ("conv_id", "turn"), counters: str | None = None):
    """Start admitting the good turns of the stream ``turns`` (score, the columns of ``order``, optionally attempt)."""
    return turns.writeStream.foreachBatch(lambda batch, number: admit(batch, number, path, least, order, counters)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(spark: SparkSession, counters: str) -> DataFrame:
    """One row: the sums over all batches."""
    schema = ", ".join(f"{name} long" for name in COUNTERS)
    return spark.read.schema(schema).parquet(f"{counters}/batch=*").agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in COUNTERS])
