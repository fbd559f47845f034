"""Benchmark decontamination by spaced-seed hashing.

A mask keeps some places of a short span and ignores the others, so a word
exchanged at an ignored place leaves the hash as it was. The masked spans of
the test items and of the training texts are hashed and joined; around each
hit the texts are laid side by side and counted word by word.

A passage counts as a leak where ``window`` aligned words (the whole item, if
it is shorter) agree in at least ``similarity`` of their places. The fixed
masks find every such passage of 20 words with up to four exchanged words,
wherever these stand (the tests try all 4845 places). For a shorter item the
masks keep one stretch of its places each and ignore all others: there is one
stretch more than it may have exchanged words, so one of them is whole (the
tests try all places for each length).

Size. The test items are hashed in blocks of at most ``BLOCK_WORDS`` words, a
bound checked by a count; each block is sent to the workers, which scan the
training texts once for it. One block is enough up to 400 000 words of tests;
a larger suite takes more scans, and each stays within the same memory.

Words: runs of ASCII letters, digits and non-ASCII bytes, A-Z lower-cased.

Defined results. Null or empty texts have no words and no hits, on either
side. An item of any length counts, down to one word (under five words none
may be exchanged). Repeated documents each get their rows (one per row and
item); repeated items with one id count as one row each. A null doc_id or
item_id is carried through. Extra columns, also ones with the names of the
result, are ignored (``clean`` carries them through).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import U64, WordHashes, binary, columns_as, hash_words, mix

#: The places that each mask keeps (1); any four exchanges in 20 words leave one of them whole.
MASKS = ("1101111", "100100010111", "110100110001")
#: Test words in one block, words of training text hashed at a time, and hits compared at a time.
BLOCK_WORDS, CHUNK_WORDS, CHUNK_HITS = 400_000, 600_000, 20_000
#: Bits of the filter in front of the table of test hashes.
FILTER_BITS = 23
_NAMES = ["doc_id", "item_id", "doc_start", "item_start", "n_words", "n_same"]
_HITS = ", ".join(f"{name} long" for name in _NAMES)
_WORD_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def masked(words: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """The hash at each place where the mask's span fits."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.full(n, salt, U64)
    factor = 0x9E3779B97F4A7C15
    for i, kept in enumerate(mask):
        if kept == "1":
            out += words[i : i + n] * U64(factor)
            factor = factor * 0xD1342543DE82EF95 % (1 << 64) | 1
    return mix(out)


def least_same(n: int, window: int, similarity: float) -> int:
    """How many words of an item of n words, or of a window of it, must agree."""
    return math.ceil(min(n, window) * similarity - 1e-9)


def runs_of(n: int, window: int, similarity: float) -> list[tuple[int, int]]:
    """(start, length) of disjoint runs of a short item, one more than words may be exchanged."""
    runs = n - least_same(n, window, similarity) + 1
    return [(i * (n // runs), n // runs) for i in range(runs)]


@dataclass
class Tests:
    """One block of test items, ready to be looked up."""

    ids: list
    words: np.ndarray
    starts: np.ndarray
    least: np.ndarray
    masks: list[tuple[str, int]]
    keys: np.ndarray
    places: np.ndarray
    bits: np.ndarray

    @classmethod
    def of(cls, items: list[tuple], cache: WordHashes, window: int, similarity: float) -> Tests:
        kept = [(i, w) for i, t in items if (w := (t or b"").translate(_WORD_TABLE).split())]
        arrays = [hash_words(w, cache) for _, w in kept]
        starts = np.zeros(len(kept) + 1, np.int64)
        np.cumsum([len(a) for a in arrays], out=starts[1:])
        words = np.concatenate(arrays) if arrays else np.zeros(0, U64)
        item_of = np.repeat(np.arange(len(kept)), np.diff(starts))
        size = np.diff(starts)
        runs: dict[int, list[int]] = {}
        for i in np.flatnonzero(size < window):
            for start, length in runs_of(int(size[i]), window, similarity):
                runs.setdefault(length, []).append(int(starts[i]) + start)
        masks, keys, places = [], [np.zeros(0, U64)], [np.zeros(0, np.int64)]
        if (size >= window).any():
            for m, mask in enumerate(MASKS):
                h = masked(words, mask, m)
                at = np.arange(len(h))
                inside = (at + len(mask) <= starts[item_of[: len(h)] + 1]) & (size[item_of[: len(h)]] >= window)
                masks.append((mask, m))
                keys.append(h[inside])
                places.append(at[inside])
        for length, found in runs.items():
            masks.append(("1" * length, len(MASKS) + length))
            places.append(np.array(found, np.int64))
            keys.append(masked(words, *masks[-1])[places[-1]])
        key, place = np.concatenate(keys), np.concatenate(places)
        order = np.argsort(key, kind="stable")
        key, place = key[order], place[order]
        bits = np.zeros(1 << FILTER_BITS, bool)
        bits[key >> U64(64 - FILTER_BITS)] = True
        least = np.array([least_same(int(n), window, similarity) for n in size], np.int64)
        return cls([i for i, _ in kept], words, starts, least, masks, key, place, bits)


def _verified(doc_words: np.ndarray, doc_starts: np.ndarray, doc: np.ndarray, at: np.ndarray, item: np.ndarray, place: np.ndarray, tests: Tests, window: int) -> tuple:
    """The best window on each hit's diagonal: whether it is a leak, its start and its agreeing words."""
    reach = window + max(map(len, MASKS))
    offset = np.arange(-reach, reach + 1)
    d, t = at[:, None] + offset, place[:, None] + offset
    inside = (d >= doc_starts[doc][:, None]) & (d < doc_starts[doc + 1][:, None]) & (t >= tests.starts[item][:, None]) & (t < tests.starts[item + 1][:, None])
    same = inside & (doc_words[np.where(inside, d, 0)] == tests.words[np.where(inside, t, 0)])
    total = np.zeros((len(at), len(offset) + 1), np.int32)
    np.cumsum(same, axis=1, out=total[:, 1:])
    length = np.minimum(tests.starts[item + 1] - tests.starts[item], window)
    best = np.full(len(at), -1, np.int64)
    first = np.zeros(len(at), np.int64)
    for n in np.unique(length):
        rows = np.flatnonzero(length == n)
        counts = total[rows, n:] - total[rows, :-n]
        counts = np.where(inside[rows][:, : counts.shape[1]] & inside[rows][:, n - 1 :], counts, -1)
        top = counts.argmax(axis=1)
        best[rows], first[rows] = counts[np.arange(len(rows)), top], top
    return best >= tests.least[item], at + offset[first], place + offset[first], length, best


def _hit_chunks(n: np.ndarray) -> Iterator[slice]:
    """Stretches of places with about CHUNK_HITS hits together, so that test items with shared passages fit in memory."""
    total = np.cumsum(n)
    start = 0
    while start < len(n):
        done = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, done + CHUNK_HITS, "right")))
        yield slice(start, stop)
        start = stop


def _expanded(at: np.ndarray, low: np.ndarray, n: np.ndarray, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
    """For each hit its place in the texts and in the test items."""
    return np.repeat(at, n), tests.places[np.repeat(low, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]


def _found(rows: list[tuple], tests: Tests, window: int) -> list[tuple]:
    """For rows (number, word hashes): (number, item, doc_start, item_start, n_words, n_same) of each leak."""
    starts = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(r[1]) for r in rows], out=starts[1:])
    words = np.concatenate([r[1] for r in rows])
    doc_of = np.repeat(np.arange(len(rows)), np.diff(starts))
    found: dict[tuple, tuple] = {}
    for mask, salt in tests.masks:
        h = masked(words, mask, salt)
        at = np.flatnonzero(tests.bits[h >> U64(64 - FILTER_BITS)])
        at = at[at + len(mask) <= starts[doc_of[at] + 1]]
        low, high = np.searchsorted(tests.keys, h[at], "left"), np.searchsorted(tests.keys, h[at], "right")
        n = high - low
        for part in _hit_chunks(n):
            place_at, item_place = _expanded(at[part], low[part], n[part], tests)
            for k in range(0, len(place_at), CHUNK_HITS):  # one place alone may have more hits than a chunk
                some, place = place_at[k : k + CHUNK_HITS], item_place[k : k + CHUNK_HITS]
                doc, item = doc_of[some], np.searchsorted(tests.starts, place, "right") - 1
                leak, d, t, length, same = _verified(words, starts, doc, some, item, place, tests, window)
                for i in np.flatnonzero(leak):
                    key = (int(doc[i]), int(item[i]))
                    value = (int(same[i]) / int(length[i]), -int(d[i]), -int(t[i]), int(length[i]), int(same[i]))
                    found[key] = max(found.get(key, value), value)
    return [
        (rows[doc][0], item, -d - int(starts[doc]), -t - int(tests.starts[item]), length, same)
        for (doc, item), (_, d, t, length, same) in sorted(found.items())
    ]


def _chunks(texts: list[bytes | None], cache: WordHashes) -> Iterator[list[tuple]]:
    """(number, word hashes) of the texts with words, about CHUNK_WORDS words at a time."""
    rows, total = [], 0
    for number, text in enumerate(texts):
        if not text or not (words := text.translate(_WORD_TABLE).split()):
            continue
        rows.append((number, hash_words(words, cache)))
        total += len(words)
        if total >= CHUNK_WORDS:
            yield rows
            rows, total = [], 0
    if rows:
        yield rows


def _scan(items, window: int, similarity: float, drop: bool):
    """Rows of each leak or, with ``drop``, the batches without the rows that have one."""

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        tests = Tests.of(items.value, cache, window, similarity)
        for batch in batches:
            found = []
            if len(tests.keys):
                for rows in _chunks(binary(batch.column("text")), cache):
                    found += _found(rows, tests, window)
            if drop:
                clean = np.ones(batch.num_rows, bool)
                clean[[f[0] for f in found]] = False
                yield batch.filter(pa.array(clean))
            else:
                ids = batch.column("doc_id").to_pylist()
                out = [(ids[n], tests.ids[item], *rest) for n, item, *rest in found]
                columns = list(zip(*out, strict=True)) or [[]] * len(_NAMES)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=_NAMES)

    return rows_of


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple]]:
    """The test items in blocks of a checked size."""
    tests = columns_as(benchmark, item_id="bigint", text="string")
    n_bytes = tests.select(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    blocks = max(1, math.ceil(n_bytes / 2 / BLOCK_WORDS))  # a word takes two bytes at least, with the space after it
    for block in range(blocks):
        part = tests.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else tests
        yield [(r.item_id, r.text.encode() if r.text else b"") for r in part.toLocalIterator()]


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = 20, similarity: float = 0.8) -> DataFrame:
    """One row per document and test item that share a passage.

    doc_id, item_id, doc_start, item_start (in words), n_words compared and
    n_same of them: the best window, the earliest on ties.
    """
    share = docs.sparkSession.sparkContext.broadcast
    texts = columns_as(docs, doc_id="bigint", text="string")
    found = [texts.mapInArrow(_scan(share(items), window, similarity, False), _HITS) for items in _blocks(benchmark)]
    return reduce(DataFrame.unionByName, found)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 20, similarity: float = 0.8) -> DataFrame:
    """The documents, all columns, that share no passage with a test item; nothing is shuffled."""
    share = docs.sparkSession.sparkContext.broadcast
    for items in _blocks(benchmark):
        docs = docs.mapInArrow(_scan(share(items), window, similarity, True), docs.schema)
    return docs
