"""Rounds of acceptance write the shingles once."""

import glob

from braidlex.functions.lang import PAIRS
from braidlex.plans import evaluation as E
from braidlex.plans import tables

FR = PAIRS["fr_en"]


def _written(spark) -> set[str]:
    return set(glob.glob(f"{tables.run_dir(spark).removeprefix('file:')}/*"))


def test_rounds_write_shared_shingles_only(spark):
    texts = [f"le la {chr(97 + i // 26)}{chr(97 + i % 26)}x pour the q{chr(97 + i // 26)}{chr(97 + i % 26)} report la market le" for i in range(60)]
    before = _written(spark)
    judged = E.accepted_verdicts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), FR)
    assert judged.count() == 60
    new = _written(spark) - before
    assert len([p for p in new if "grams" in spark.read.parquet(p).columns]) == 1  # written once, not once a round
