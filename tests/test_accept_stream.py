"""The stream that accepts only what passes equals the batch form, also after a failure in the middle of a batch."""

import numpy as np
import pytest

from braidlex.functions.lang import PAIRS
from braidlex.plans import evaluation as E
from braidlex.streaming import acceptance

WORDS = "report the question with today bonjour merci avec pour dans maison weather market".split()
PASSES = "diversity > 7.0 and doc_id % 5 <> 1"
COLUMNS = ["doc_id", "is_copy", "diversity", "final_score", "decision", "accepted"]


def test_stream_is_the_batch_form(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(WORDS, rng.integers(4, 12))) for _ in range(180)]
    for i in range(3, 180, 4):
        texts[i] = texts[i - 3] + (" encore" if i % 8 else "")
    for i in range(100, 180, 7):
        texts[i] = texts[i - 90]  # copies of texts in earlier batches
    rows = list(enumerate(texts)) + [(200, None), (201, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for k, (low, high) in enumerate(((0, 70), (70, 130), (130, 999))):
        docs.filter(f"doc_id >= {low} and doc_id < {high}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"part={k}"))
    folder, checkpoint = str(tmp_path / "state"), str(tmp_path / "checkpoint")
    source = spark.readStream.schema("doc_id long, text string, part int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    want = sorted(map(str, E.accepted_verdicts(docs, PAIRS["fr_en"], PASSES).select(COLUMNS).collect()))
    judge, calls = acceptance.judge, []

    def failing(batch, number, *rest):
        calls.append(number)
        if len(calls) == 2:
            judge(batch, number, *rest)
            (tmp_path / "state" / "judged" / f"batch={number}" / "_SUCCESS").unlink()  # the tables are written, the batch is not complete
            raise RuntimeError("an executor was lost")
        judge(batch, number, *rest)

    monkeypatch.setattr(acceptance, "judge", failing)
    with pytest.raises(Exception, match="lost"):
        acceptance.accept_stream(source, folder, checkpoint, PAIRS["fr_en"], PASSES).awaitTermination()
    acceptance.accept_stream(source, folder, checkpoint, PAIRS["fr_en"], PASSES).awaitTermination()
    assert calls == [0, 1, 1, 2]
    out = acceptance.verdicts(spark, folder)
    assert sorted(map(str, out.select(COLUMNS).collect())) == want and out.select("batch").distinct().count() == 3
    assert {r.accepted for r in out.collect()} == {True, False}
