"""Lexicons of any size give the rows of the list; the example bank keeps its order."""

import pytest
from pyspark.sql import functions as F

from braidlex.functions.lang import FRENCH_WORDS, PAIRS
from braidlex.operators import analysis as A
from braidlex.operators import dialogue as D
from braidlex.plans import lexicon, ranks
from braidlex.sources import config

FR = PAIRS["fr_en"]
COLUMNS = ["doc_id", "toks", "tags", "segs", "n1", "n2", "cmi", "motives"]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, " ".join(["le", "chat", "w%d" % (i % 50), "the", "Avec", "VOUS", "3", "ok!"][: 1 + i % 8]) + " " + "le the " * (i % 5)) for i in range(400)] + [(900, None), (901, ""), (1, "le même"), (None, "la")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


@pytest.mark.parametrize("hot", [1_000_000, 100])
def test_a_million_words_as_a_table(spark, texts, monkeypatch, hot):
    monkeypatch.setattr(ranks, "HOT_ROWS", hot)
    words = spark.range(1_000_000).select(F.concat(F.lit("x"), "id").alias("word")).unionByName(spark.createDataFrame([(w.upper(),) for w in FRENCH_WORDS] + [("Le",), (None,)], "word string"))
    want = sorted(map(str, A.analyze(texts, FR).select(COLUMNS).collect()))
    # the corpus' words in the lexicon are few: a list again; with a limit of 3 they are joined
    assert sorted(map(str, lexicon.analyze(texts, FR, words).select(COLUMNS).collect())) == want
    joined = lexicon.analyze(texts, FR, words, limit=3)
    assert sorted(map(str, joined.select(COLUMNS).collect())) == want and not [c for c in joined.columns if c.startswith("__")]


def test_empty_lexicon_and_table(spark, texts):
    nothing = spark.createDataFrame([], "word string")
    assert lexicon.analyze(texts, FR, nothing).agg(F.sum("n1")).first()[0] == 0
    assert lexicon.analyze(texts.limit(0), FR, spark.createDataFrame([("le",)], "word string"), limit=0).count() == 0


def test_a_long_lexicon_of_a_folder_stays_a_table(spark, tmp_path, monkeypatch):
    folder = tmp_path / "fr_big"
    folder.mkdir()
    (folder / "language.yaml").write_text("l1_code: fr\nl2_code: en\ndetection_mode: lexicon\n")
    (folder / "l1_lexicon.txt").write_text("le\nla\navec\n")
    for name in ("personas.yaml", "evaluation.yaml", "prompts.yaml"):
        (folder / name).write_text("{}\n")
    (folder / "calibration.json").write_text("{}")
    monkeypatch.setattr(config, "MAX_LEXICON", 2)
    found = config.read_pair(spark, str(tmp_path), "fr_big")
    assert found.language.outside and found.lexicon.count() == 3
    docs = spark.createDataFrame([(1, "le chat avec the dog")], "doc_id long, text string")
    assert lexicon.analyze(docs, found.language, found.lexicon, limit=0).first().n1 == 2


def test_the_bank_keeps_its_order(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(['{"archetype_id": "X", "topic": "t", "speaker_text": "%s", "eval_score": 1}' % t for t in ("first", "second", "third", "third")] + ["broken {", "{}"]) + "\n")
    (tmp_path / "b.jsonl").write_text('{"archetype_id": "X", "topic": "t", "speaker_text": "fourth", "eval_score": 9}\n')
    many = "".join('{"archetype_id": "Y", "topic": "u", "speaker_text": "s%d"}\n' % i for i in range(3000))
    (tmp_path / "c.jsonl").write_text(many)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "20k"):  # one block a file, and many
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = config.read_examples(spark, str(tmp_path)).orderBy("seq").collect()
            assert [r.speaker_text for r in rows] == ["first", "second", "third", "third", "fourth", *[f"s{i}" for i in range(3000)]]
            assert [r.seq for r in rows] == list(range(1, 3006))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    bank = config.read_examples(spark, str(tmp_path / "a.jsonl"))
    asked = spark.createDataFrame([(1, "X", "t")], "req long, archetype string, topic string")
    got = D.retrieve_examples(asked, bank, 9).filter("tier = 3").orderBy("rank").collect()
    assert [r.seq for r in got] == [1, 2, 3, 4]
