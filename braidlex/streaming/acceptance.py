"""Diversity that accepts only what passes, as a stream.

Each micro-batch is judged against what earlier ones accepted and, in the
order of its ids, against its own. What was accepted is kept as tables that all
executors share: shingles, text hashes, counts of patterns, one folder a
batch. A batch's folders are functions of the batch and of those before it, so
a batch that is run again after a failure writes the same. State is never one
task's: a batch joins it, hot shingles split, as the batch form does.

Batches follow the order of the ids: each one's ids are greater than those of
the batches before, or it is judged as if they were.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidlex.functions.lang import LanguagePair
from braidlex.operators import scoring as S
from braidlex.plans import evaluation
from braidlex.plans.tables import cut

_TABLES = {"grams": "gram long", "hashes": "text_hash string", "patterns": "pattern string, n long"}


def _batches(spark: SparkSession, folder: str, before: int) -> list[int]:
    """The numbers of the batches that are complete and come before this one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/judged/batch=*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    numbers = sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)
    return [n for n in numbers if n < before]


def known(spark: SparkSession, folder: str, before: int) -> S.Known | None:
    """What the batches before this one accepted."""
    done = _batches(spark, folder, before)
    if not done:
        return None
    read = {name: spark.read.schema(schema).parquet(*[f"{folder}/{name}/batch={n}" for n in done]) for name, schema in _TABLES.items()}
    patterns = read["patterns"].groupBy("pattern").agg(F.sum("n").alias("n"))
    return S.Known(read["grams"], read["hashes"], patterns, read["patterns"].agg(F.sum("n").alias("n")).first().n or 0)  # one number


def judge(batch: DataFrame, number: int, folder: str, pair: LanguagePair, passes: str = "decision = 'pass'") -> None:
    """Judge one batch of texts (doc_id, text) and add what passes to the tables in ``folder``."""
    spark = batch.sparkSession
    if number in _batches(spark, folder, number + 1):
        return  # run again after it was complete
    texts = cut(batch.select("doc_id", "text"), "batch")
    verdicts = cut(evaluation.accepted_verdicts(texts, pair, passes, known(spark, folder, number), ("text_hash", "pattern", "grams")), "verdicts")
    passed = verdicts.filter("accepted")
    new = {
        "grams": passed.select(F.explode("grams").alias("gram")).distinct(), "hashes": passed.select("text_hash").distinct(),
        "patterns": passed.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")),
    }
    for name, table in new.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
    verdicts.drop("text_hash", "pattern", "grams").write.mode("overwrite").parquet(f"{folder}/judged/batch={number}")  # last: its mark says that the batch is complete


def accept_stream(texts: DataFrame, folder: str, checkpoint: str, pair: LanguagePair, passes: str = "decision = 'pass'"):
    """Start judging the stream ``texts`` (doc_id, text); ``verdicts`` reads what was judged."""
    return texts.writeStream.foreachBatch(lambda batch, number: judge(batch, number, folder, pair, passes)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """All verdicts of the complete batches, with their batch."""
    done = _batches(spark, folder, 1 << 62)
    return spark.read.option("basePath", f"{folder}/judged").parquet(*[f"{folder}/judged/batch={n}" for n in done])
