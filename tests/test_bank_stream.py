"""The bank and the counters filled by a stream: once each, in order, over restarts."""

import pytest
from pyspark.sql import functions as F

from braidlex.sources import config
from braidlex.streaming import bank

SCHEMA = "conv_id long, turn long, attempt int, score double, archetype_id string, speaker_text string"


def turns(spark, conversations):
    rows = [(c, t, 1 + (c + t) % 3, None if (c * t) % 7 == 3 else float((c * 3 + t * 5) % 11), f"ARC_0{c % 3 + 1}", f"text {c} {t}") for c in conversations for t in range(1, 5)]
    return spark.createDataFrame(rows, SCHEMA)


def expected(rows):
    return {"turns": len(rows), "admitted": sum(r.score is not None and r.score >= 8 for r in rows), "retries": sum(r.attempt - 1 for r in rows), "failed": sum(r.score is None for r in rows)}


def test_stream_with_restart(spark, tmp_path):
    source, path, counters = (str(tmp_path / x) for x in ("in", "bank", "counters"))
    seen = []
    for conversations in (range(5, 30), range(30, 60)):
        part = turns(spark, conversations)
        part.repartition(3).write.mode("append").json(source)
        seen += part.collect()
        stream = spark.readStream.schema(SCHEMA).json(source)
        bank.append_examples(stream, path, str(tmp_path / "checkpoint"), counters=counters).awaitTermination()
        assert bank.totals(spark, counters).first().asDict() == expected(seen)
    lines = config.read_examples(spark, f"{path}/*").orderBy("seq").collect()
    good = sorted((r for r in seen if r.score is not None and r.score >= 8), key=lambda r: (r.conv_id >= 30, r.conv_id, r.turn))
    assert [r.speaker_text for r in lines] == [r.speaker_text for r in good] and [r.seq for r in lines] == list(range(1, len(good) + 1))


def test_batch_run_again_is_written_once(spark, tmp_path):
    path, counters = str(tmp_path / "bank"), str(tmp_path / "counters")
    part = turns(spark, range(10))
    for number in (0, 1, 1, 0):
        bank.admit(part.filter(F.col("conv_id") % 2 == number), number, path, counters=counters)
    assert bank.totals(spark, counters).first().asDict() == expected(part.collect())
    assert spark.read.json(f"{path}/*").count() == expected(part.collect())["admitted"]


def test_failure_between_bank_and_counters(spark, tmp_path, monkeypatch):
    """What a failed batch left is overwritten when it is run again."""
    path, counters = str(tmp_path / "bank"), str(tmp_path / "counters")
    part = turns(spark, range(12))

    def lost(*_, **__):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(type(spark), "createDataFrame", lost)
        with pytest.raises(OSError, match="lost"):
            bank.admit(part, 0, path, counters=counters)
    bank.admit(part, 0, path, counters=counters)
    assert bank.totals(spark, counters).first().asDict() == expected(part.collect())
    assert spark.read.json(f"{path}/*").count() == expected(part.collect())["admitted"]


def test_empty_batch_and_no_attempts(spark, tmp_path):
    path, counters = str(tmp_path / "bank"), str(tmp_path / "counters")
    none = spark.createDataFrame([], SCHEMA)
    bank.admit(none, 0, path, counters=counters)
    assert bank.totals(spark, counters).first().asDict() == dict.fromkeys(bank.COUNTERS, 0)
    bank.admit(turns(spark, range(4)).drop("attempt"), 1, path, counters=counters)
    assert bank.totals(spark, counters).first().retries == 0 and bank.totals(spark, counters).first().turns == 16
