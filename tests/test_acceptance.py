"""Diversity that accepts only what passes, second voices, failed assemblies, ambiguous words."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidlex.functions import audio
from braidlex.functions.lang import PAIRS
from braidlex.operators import analysis as A
from braidlex.operators import scoring as S
from braidlex.operators import voice as V
from braidlex.plans import evaluation as E

WORDS = "report the question with today bonjour merci avec pour dans maison weather market".split()


def one_by_one(rows, passes):
    """The recurrence as it reads: each text against what was accepted before it."""
    grams, hashes, patterns, count, out = set(), set(), {}, 0, {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        own = set(r["grams"] or [])
        overlap = len(own & grams) / len(own) if own else 0.0
        share = patterns.get(r["pattern"], 0) / count if count else 0.0
        novel = 2.0 if overlap > 0.7 else 5.0 if overlap > 0.5 else 7.5 if overlap > 0.3 else 10.0
        pattern = 5.0 if count > 100 and share > 0.1 else 7.5 if count > 100 and share > 0.05 else 10.0
        score = 0.0 if r["text_hash"] in hashes else 10.0 if not count else (novel + pattern) / 2
        accepted = bool(passes(r, score))
        out[r["doc_id"]] = (score, accepted)
        if accepted:
            grams |= own
            hashes.add(r["text_hash"])
            patterns[r["pattern"]] = patterns.get(r["pattern"], 0) + 1
            count += 1
    return out


def test_only_what_passes_is_remembered(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(WORDS, rng.integers(4, 12))) for _ in range(150)]
    for i in range(3, 150, 4):  # chains: each repeats most of an earlier text, some all of it
        texts[i] = texts[i - 3] + (" encore" if i % 8 else "")
    docs = spark.createDataFrame(list(enumerate(texts)) + [(200, None), (201, "")], "doc_id long, text string")
    rows = E._scores(docs, PAIRS["fr_en"]).collect()
    got = {r.doc_id: (r.diversity, r.accepted) for r in E.accepted_verdicts(docs, PAIRS["fr_en"], "diversity > 7.0 and doc_id % 5 <> 1").collect()}
    want = one_by_one([r.asDict() for r in rows], lambda r, score: score > 7.0 and r["doc_id"] % 5 != 1)
    assert got == want
    assert {a for _, a in got.values()} == {True, False}
    every = {r.doc_id: r.diversity for r in S.diversity(E._scores(docs, PAIRS["fr_en"]).select("doc_id", "text_hash", "pattern", "grams"), "doc_id").collect()}
    assert every == {k: s for k, (s, _) in one_by_one([r.asDict() for r in rows], lambda r, score: True).items()}
    assert E.accepted_verdicts(docs.limit(0), PAIRS["fr_en"]).count() == 0


def voices(spark, n):
    rows = [(f"v{i}", "female" if i % 2 else "male", "young", ["en"], "") for i in range(n)]
    return spark.createDataFrame(rows, "voice string, gender string, age string, languages array<string>, accent string")


def dialogues(spark):
    row = (1, ["en"], "male", "young", "", "female", "young", "")
    return spark.createDataFrame([row, row], "id long, languages array<string>, gender_a string, age_a string, accent_a string, gender_b string, age_b string, accent_b string")


def test_second_voice(spark):
    assert [tuple(r) for r in V.voice_pairs(dialogues(spark), voices(spark, 2)).collect()] == [(1, "v0", "v1")] * 2  # equal rows stay apart
    assert [tuple(r) for r in V.voice_pairs(dialogues(spark), voices(spark, 1), strict=False).collect()] == [(1, "v0", None)] * 2
    assert [tuple(r) for r in V.voice_pairs(dialogues(spark), voices(spark, 0), strict=False).collect()] == [(1, None, None)] * 2
    with pytest.raises(Exception, match="no second voice for dialogue 1"):
        V.voice_pairs(dialogues(spark), voices(spark, 1)).collect()


def test_failed_assembly_keeps_the_dialogue(spark):
    sound = audio.write_wav(np.zeros(1600, np.int16), 16000)
    turns = [(1, 0, sound, 0), (1, 1, sound, 0), (2, 0, sound, 0), (2, 1, b"no sound", 0), (3, 0, sound, 0), (3, 1, None, 0)]
    df = spark.createDataFrame(turns, "conv_id long, turn int, wav binary, pause_ms int")
    got = {r.conv_id: r for r in audio.assemble(df).collect()}
    assert set(got) == {1, 2}
    assert got[1].wav is not None and got[1].seconds == 0.2 and got[1].error is None
    assert got[2].wav is None and got[2].seconds is None and got[2].error


def test_ambiguous_words_leave_the_index(spark):
    pair = PAIRS["fr_en"]
    assert pair.ambiguous
    word = pair.ambiguous[0]
    df = spark.createDataFrame([(1, f"bonjour {word} merci with the"), (2, f"{word} {word}"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_ambiguous, r.n_content, round(r.cmi_clear, 6)) for r in A.clear_mixing(A.analyze(df, pair), pair).collect()}
    n1 = sum(w in pair.lexicon for w in ("bonjour", "merci", "with", "the"))
    assert got == {1: (1, 5, round((4 - max(n1, 4 - n1)) / 4, 6)), 2: (2, 2, 0.0), 3: (0, 0, 0.0)}
    assert A.clear_mixing(A.analyze(df, PAIRS["zh_en"]), PAIRS["zh_en"]).agg(F.max("n_ambiguous")).first()[0] == 0
