"""A chunk's n-grams are counted by sorting: right, and without slow lookups of each one."""

import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from braidlex.llm import lm_score


def _plain(h, doc):
    known = sorted(set(h))
    own = Counter(zip(h, doc, strict=True))
    return [known.index(x) for x in h], [own[x] for x in zip(h, doc, strict=True)]


@pytest.mark.parametrize("kinds", [1, 3, 40, 10**6])
def test_places_and_own_occurrences(kinds):
    r = random.Random(kinds)
    h = [(r.randrange(kinds) * 0x9E3779B97F4A7C15 + 7) % (1 << 64) for _ in range(500)]
    doc = sorted(r.randrange(9) for _ in h)
    at, own = lm_score._places(np.array(h, np.uint64), np.array(doc))
    assert (at.tolist(), own.tolist()) == _plain(h, doc)


def test_places_of_nothing():
    assert [x.tolist() for x in lm_score._places(np.zeros(0, np.uint64), np.zeros(0, np.int64))] == [[], []]


def test_scoring_a_chunk_costs_few_sorts():
    r = random.Random(7)
    words = [f"word{k}" for k in range(60_000)]
    texts = [" ".join(r.choices(words, k=300)) for _ in range(2000)]
    n = len(texts)
    docs = pa.table({"doc_id": pa.array(range(n), pa.int64()), "text": pa.array(texts), "copies": pa.array([1] * n, pa.int64())})
    asked = lm_score._requests(2, 1)((pa.scalar(0),), docs)
    answers = lm_score._answers(asked)
    _, _, grams = lm_score._chunk_ngrams(docs, 2)
    h = np.concatenate([g[0] for g in grams])

    def least(f):
        took = []
        for _ in range(3):
            start = time.process_time()
            f()
            took.append(time.process_time() - start)
        return min(took)

    # without the reading of the words, which both need
    scoring = least(lambda: lm_score._scores(2, 10**6)(docs, answers)) - least(lambda: lm_score._chunk_ngrams(docs, 2))
    assert scoring < 14 * least(lambda: np.argsort(h)), scoring
