"""Importance resampling against plain loops over built n-grams."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from braidlex.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, length=3):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i : i + k]).encode() for i in range(len(words)) for k in range(1, length + 1) if i + k <= len(words)]


def brute(rows, target, percent=5, least=20, length=3, buckets=10_000, seed=42):
    def tally(texts):
        out = [0] * buckets
        for t in texts:
            for g in grams(t, length)[1]:
                out[zlib.crc32(g) % buckets] += 1
        return out

    s, t = tally(x for _, x in rows), tally(target)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for i, text in rows:
        n, found = grams(text, length)
        weight = sum(gain[zlib.crc32(g) % buckets] for g in found)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    long_enough = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(long_enough[: len(long_enough) * percent // 100]):
        r[4] = rank + 1
    return sorted(map(str, map(tuple, out)))


def corpus():
    body = "Der Hund, the DOG and 3 cats; naïve Ünï-Code ÉÄ x_y "
    rows = [(i, body * (i % 9) + f"word{chr(97 + i % 26)} " * (i % 40)) for i in range(300)]
    rows += [(301, None), (302, ""), (303, "... 123 !!"), (None, body * 5), (None, body * 7), (304, "tail " * 40_000), (305, "a\x00b\x7fc É É")]
    return rows + [rows[8]] * 3 + [(8, body)], ["the dog and the cat", None, "", "Hund " * 30]


@pytest.mark.parametrize("settings", [{}, {"percent": 50, "least": 3, "length": 2, "buckets": 97, "seed": 7}, {"percent": 100, "least": 0, "length": 1, "buckets": 70_000}])
@pytest.mark.parametrize("limits", [(300_000, 16_000_000, 500_000), (5, 100, 20)])
def test_resample(spark, monkeypatch, settings, limits):
    for name, value in zip(("PIECE", "BATCH_BYTES", "RANGE_ROWS"), limits):
        monkeypatch.setattr(importance, name, value)
    rows, target = corpus()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, rank int, weight string").repartition(4)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    names = {"least": "least_words"}
    got = importance.resample(docs, bench, **{names.get(k, k): v for k, v in settings.items()})
    assert dict(got.dtypes) == dict.fromkeys(["doc_id", "n_features", "weight", "score", "rank", "n_words"], "bigint")
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows, target, **settings)


def test_ring_is_the_crc_of_built_ngrams():
    for text in ("", "one", "one two", "A b C d É 9x9 " * 50):
        n, found = grams(text, 4)
        n_words, got = importance.scan(text.encode(), 4, 1 << 16)
        assert n_words == n and sorted(np.frombuffer(got, "<u2")) == sorted(zlib.crc32(g) % (1 << 16) for g in found)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c " * 20)], "doc_id long, text string")
    assert importance.resample(none, some).count() == 0 and importance.resample(none, none).count() == 0
    assert [tuple(r) for r in importance.resample(some, none, percent=100).collect()] == [eval(x) for x in brute([(1, "a b c " * 20)], [], percent=100)]
