"""The sample itself has the target marginals: documents come as often as they are drawn."""

from collections import Counter

import pytest

from braidlex.llm import mixing


def test_sample_has_the_target_marginals(spark):
    rows = [(i, "word " * (5 + i % 7), "en" if i % 20 else "es", "big" if i % 10 else "small", i) for i in range(4000)] + [(None, "word word", "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, extra int")
    wanted = {"source": 0.3, "lang": 0.5, "topic": 1.0}
    drawn = mixing.sample(docs, wanted).toPandas()
    assert list(drawn.columns) == docs.columns
    copies = {r.doc_id: r.copies for r in mixing.mix(docs, wanted).collect() if r.copies}
    assert max(copies.values()) > 1
    assert Counter(None if x != x else int(x) for x in drawn.doc_id) == copies
    drawn["n"] = drawn.text.str.split().str.len()
    every = [(len(t.split()), lang, source or "") for _, t, lang, source, _ in rows]
    for dim, at in (("lang", 1), ("source", 2)):
        tokens = Counter()
        for row in every:
            tokens[row[at]] += row[0]
        goal = {k: v ** wanted[dim] for k, v in tokens.items()}
        seen = drawn.n.groupby(drawn[dim].fillna("")).sum() / drawn.n.sum()
        assert all(abs(seen.get(k, 0) - g / sum(goal.values())) < 0.02 for k, g in goal.items())


def test_raking_settles_either_way(spark, monkeypatch):
    """Both ways of raking meet the marginals; an extra column named topic is no topic."""
    rows = [(i, "word " * (1 + i % 5), f"l{i % 3}", f"s{i % 4}", "mine") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic string")
    wanted = {"source": 0.0, "lang": 0.5, "topic": 1.0}
    few = {r.doc_id: r.weight for r in mixing.mix(docs, wanted).collect()}
    monkeypatch.setattr(mixing, "FEW_CELLS", 0)
    many = mixing.mix(docs, wanted).collect()
    assert {r.doc_id: r.weight for r in many} == few and {r.topic for r in many} == {"prose"}
    tokens = Counter()
    for i, r in few.items():
        tokens[rows[i][3]] += r * len(rows[i][1].split())
    assert max(tokens.values()) - min(tokens.values()) < 1e-3
    monkeypatch.undo()
    assert {r.topic for r in mixing.mix(docs, wanted, topic="topic", sweeps=1).collect()} == {"mine"}


def test_goals_that_cannot_be_met_end_with_the_topics_met(spark):
    """Each source has one language, so equal sources and the languages' own shares exclude each other."""
    apart = spark.createDataFrame([(1, "a a a", "en", "x"), (2, "b", "fr", "y"), (3, "1 2 3 4", "fr", "y")], "doc_id long, text string, lang string, source string")
    out = mixing.mix(apart, {"source": 0.0, "lang": 1.0, "topic": 0.0}).collect()
    mass = Counter()
    for r in out:
        mass[r.topic] += r.weight * r.n_tokens
    assert abs(mass["prose"] - 4) < 1e-3 and abs(mass["numeric"] - 4) < 1e-3


def test_raking_goes_on_over_a_plateau(spark):
    """A cell that starts at a millionth of its source has to grow to a fifth of all; the marginals stand still meanwhile."""
    cells = spark.createDataFrame([("a", "x", "t", 10**6), ("a", "y", "t", 1), ("b", "x", "t", 1), ("b", "y", "t", 10**6)], "source string, lang string, topic string, tokens long")

    def table(**shares):
        return spark.createDataFrame(list(shares.items()), "value string, share double")

    raked = mixing.rake(cells, {"source": table(a=0.6, b=0.4), "lang": table(x=0.4, y=0.6), "topic": 1.0})
    got = {(r.source, r.lang): r.mass for r in raked.collect()}
    assert abs(got["a", "y"] - 0.2) < 1e-9 and abs(got["a", "x"] - 0.4) < 1e-9 and abs(got["b", "y"] - 0.4) < 1e-9
    assert "before" not in raked.columns


def test_raking_says_what_it_missed(spark, monkeypatch, caplog):
    apart = spark.createDataFrame([("x", "en", "t", 9), ("y", "fr", "t", 1)], "source string, lang string, topic string, tokens long")
    wanted = {"source": 0.0, "lang": 1.0, "topic": 1.0}
    with caplog.at_level("WARNING"):
        mixing.rake(apart, wanted).collect()
    assert "cannot be met" in caplog.text and "0.4" in caplog.text
    slow = spark.createDataFrame([("a", "x", "t", 10**6), ("a", "y", "t", 1), ("b", "x", "t", 1), ("b", "y", "t", 10**6)], "source string, lang string, topic string, tokens long")
    monkeypatch.setattr(mixing, "MAX_SWEEPS", 4)
    shares = spark.createDataFrame([("x", 0.4), ("y", 0.6)], "value string, share double")
    with pytest.raises(ValueError, match="away from their targets"):
        mixing.rake(slow, {"source": 1.0, "lang": shares, "topic": 1.0})
