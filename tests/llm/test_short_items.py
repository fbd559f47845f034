"""Test items of 1 to 40 words: every allowed exchange of words is found, and no other one."""

import itertools
import random
import re

import pytest

from braidlex.llm import decontaminate


@pytest.mark.parametrize("n", range(1, 20))
def test_one_run_is_whole_after_any_exchange(n):
    runs = decontaminate.runs_of(n, 20, 0.8)
    exchanged = n - decontaminate.least_same(n, 20, 0.8)
    for gone in itertools.combinations(range(n), exchanged):
        assert any(not set(gone) & set(range(start, start + length)) for start, length in runs)
    assert all(start + length <= n for start, length in runs)


def test_short_items_are_found(spark):
    items = {n: [f"i{n}w{k}" for k in range(n)] for n in range(1, 20)}
    texts, want = [], set()
    for n, words in items.items():
        exchanged = n - decontaminate.least_same(n, 20, 0.8)
        for change in (exchanged, exchanged + 1):
            for gone in itertools.combinations(range(n), change):
                if len(texts) % 7 == 0:  # no more words than the item
                    around = ([], [])
                else:
                    around = (["before"] * 9, ["after"] * 9)
                if change == exchanged:
                    want.add((len(texts), n))
                texts.append(" ".join([*around[0], *["other" if k in gone else w for k, w in enumerate(words)], *around[1]]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tests = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, tests).collect()} == want


@pytest.mark.parametrize("n", [20, 21, 30, 40])
def test_long_items_are_found(spark, n):
    """Items of 20 words and more: any 20 of their words with up to four exchanged."""
    r = random.Random(n)
    words = [f"i{k}" for k in range(n)]
    texts, want = [], set()
    for change in (0, 4, 5):
        for _ in range(60):
            start = r.randrange(n - 19)
            gone = set(r.sample(range(start, start + 20), change))
            around = r.choice([[], ["before"] * 9])
            texts.append(" ".join([*around, *["other" if k in gone else words[k] for k in range(start, start + 20)], *around]))
            if change <= 4:
                want.add(len(texts) - 1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tests = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    assert {x.doc_id for x in decontaminate.leaks(docs, tests).collect()} == want


def brute(texts, items, window=20, similarity=0.8):
    """Every document, item and pair of places."""
    found = set()
    for i, text in texts:
        d = re.findall("[a-z0-9]+", (text or "").lower())
        for j, item in items:
            t = re.findall("[a-z0-9]+", (item or "").lower())
            n = min(len(t), window)
            if n and any(
                sum(x == y for x, y in zip(d[a : a + n], t[b : b + n], strict=True)) >= n * similarity - 1e-9 for a in range(len(d) - n + 1) for b in range(len(t) - n + 1)
            ):
                found.add((i, j))
    return found


@pytest.mark.parametrize("hits", [20_000, 7])
def test_against_brute_force(spark, monkeypatch, hits):
    """Few words, so that items share passages; repeated rows, null ids, and columns named as those of the result."""
    monkeypatch.setattr(decontaminate, "CHUNK_HITS", hits)
    r = random.Random(3)
    vocabulary = ["a", "b", "c", "d", "e"]
    items = [(j, " ".join(r.choices(vocabulary, k=r.choice([1, 2, 4, 5, 7, 9, 14, 19, 20, 26])))) for j in range(40)] + [(90, None), (91, "")]
    texts = [(i, " ".join(r.choices(vocabulary, k=r.randrange(40)))) for i in range(60)] + [(None, items[5][1]), (98, None), (99, "")]
    want = brute(texts, items)
    docs = spark.createDataFrame([*texts, texts[3], texts[3]], "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS n_same")
    got = decontaminate.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id) for x in got} == want
    assert len(got) == len(want) + 2 * sum(i == texts[3][0] for i, _ in want)
    clean = decontaminate.clean(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert clean.columns == docs.columns and {x.doc_id for x in clean.collect()} == {i for i, _ in texts} - {i for i, _ in want}
