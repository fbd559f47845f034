"""Scores recomputed by brute force, counts of features recounted, and rows with clashing columns, nulls and repeats."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from braidlex.llm import toxicity


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(11)
    plain, bad = [f"word{i}" for i in range(150)] + ["é", "Ünder"], ["vile", "nasty", "zorkel"]
    rows, labels = [], []
    for i in range(400):
        w = r.choices(plain, k=r.randrange(1, 60))
        for _ in range(3 * (i % 4 == 0)):
            w.insert(r.randrange(len(w) + 1), r.choice(bad) + r.choice(["", "s", "ing"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    rows += [(None, "vile nasty zorkel"), (None, None), (900, ""), (901, "vile nasty vile word1 " * 20_000), rows[8], rows[8]]
    labels += [(4, 0), (4, 1), (5, None), (None, 1)]  # of several labels the largest counts
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS toxic", "0.5D AS score", "'x' AS n_words", "2 AS fold").repartition(3)
    return rows, labels, docs, spark.createDataFrame(labels, "doc_id long, toxic int").selectExpr("*", "'y' AS text")


def words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        low = c.lower() if c.isascii() else c
        if low.isascii() and not low.isalpha():
            out += [word] if word else []
            word = ""
        else:
            word += low
    return out


def features(word):
    return [word] + [word[:k] + "*" for k in (3, 4, 5, 6) if len(word) > k]


def test_feature_counts(tables):
    rows, labels, docs, known = tables
    training = toxicity.training_rows(docs, known, 20_000)
    label = {}
    for i, toxic in labels:
        if i is not None and toxic is not None:
            label[i] = max(label.get(i, 0), toxic)
    import zlib

    learnt = {i: t for i, t in label.items() if zlib.crc32(str(i).encode()) % 5}
    assert training.count() == len(learnt)
    want = {0: Counter(), 1: Counter()}
    for i, text in dict(r for r in rows if r[0] in learnt).items():
        want[learnt[i]].update({f for w in words(text) for f in features(w)})
    got = {0: Counter(), 1: Counter()}
    for r in toxicity.feature_counts(training).collect():
        for toxic in (0, 1):
            got[toxic][bytes(r.feature).decode()] += sum(r[f"n{toxic}_{k}"] for k in range(toxicity.FOLDS))
    assert all(+got[t] == +want[t] for t in (0, 1))


def stretches(values, shift=0):
    """All maximal segments by their definition: the best stretch, then the same beside it."""
    best = max(((sum(values[i:j]), -(j - i), -i, j) for i in range(len(values)) for j in range(i + 1, len(values) + 1)), default=(0,))
    if best[0] <= 0:
        return []
    i, j = -best[2], best[3]
    return stretches(values[:i], shift) + [(shift + i, shift + j, best[0])] + stretches(values[j:], shift + j)


def test_scores_are_those_of_brute_force(tables):
    rows, _, docs, known = tables
    model = toxicity.fit(docs, known)
    weights = {k.decode(): v for k, v in model.weights.items()}
    got = {}
    for r in toxicity.score(docs, model).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows) and len(got[8]) == 3
    seen_toxic = 0
    for i, text in rows:
        if i is None or i == 901:
            continue
        w = words(text)
        values = [max([weights[f] for f in features(x) if f in weights], default=toxicity.PENALTY) for x in w]
        evidence, best, found = 0.0, 0.0, []
        for a, b, s in stretches(values):
            best = max(best, s)
            expected = model.scale * len(w) * math.exp(-model.rate * s)
            if expected <= toxicity.MAX_E:
                evidence -= math.log(max(expected, 1e-300))
                found.append((a, b))
        z = model.curve[0] + model.curve[1] * math.log1p(evidence) + model.curve[2] * math.log1p(best)
        for r in got[i]:
            assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9) and r.predicted == int(r.score >= 0.5)
            assert [(p.start, p.stop) for p in r.passages] == found and r.n_words == len(w)
            seen_toxic += r.predicted
    assert seen_toxic >= 95 and got[901][0].predicted == 1 and sorted(r.n_words for r in got[None]) == [0, 3]


def test_clean_carries_clashing_columns_through(tables):
    _, _, docs, known = tables
    kept = toxicity.clean(docs, known)
    assert kept.columns == docs.columns and kept.filter("toxic = 1 and score = 0.5 and n_words = 'x'").count() == kept.count() > 250


def test_a_labelled_row_repeated_very_often_is_learnt_once(spark, tables):
    _, _, docs, known = tables
    many = docs.unionByName(docs.filter("doc_id = 7").limit(1).crossJoin(spark.range(5000)).drop("id"))
    assert toxicity.training_rows(many, known, 20_000).count() == toxicity.training_rows(docs, known, 20_000).count()
    assert toxicity.training_rows(docs, known, 10).count() == 10
    assert toxicity.training_rows(docs, known, 10).agg(F.max("fold")).first()[0] < toxicity.FOLDS
