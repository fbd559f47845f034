"""Substring dedup by level-wise doubling.

A window of ``2n`` words can repeat only where a window of ``n`` words inside
it repeats. So windows are compared at a short length first, and those that
repeat there (those alone) are extended to twice that length, level after
level, until no candidates survive or the wanted length is reached: 5, 10 and
20 words for windows of 20. Longer levels would cover no word that windows of
the wanted length do not cover. A level without candidates gives the next one
nothing to read.

A level ``n`` below the wanted length. Of the ``n``-word windows inside each
full window only the one with the smallest hash counts (leftmost on ties):
equal full windows choose it at the same place, so nothing is lost, and only
about ``2 / (window - n + 2)`` of the positions are shuffled. Neighbouring full
windows with the same choice are a *run*; it travels as one row with the hash
of its words. A run that stands earlier as a whole is settled: all its windows
repeat. Runs with the same chosen window but different words around it are the
candidates of the next level. The last level hashes each full window that is
left (128 bits), and the first one of its kind stays.

Hot keys: each worker sends at most one row per key and chunk of words (about
4 MB of text) to be compared; equal runs or windows met again in a chunk are
settled on the spot, others with the same key go on under keys of their own.

Defined results. Null or empty text: no words. Fewer words than a window:
nothing is removed. Repeated rows (same id and text) are one document and get
the same result; rows that share an id must share their text. A row without
an id is neither compared nor changed. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import U64, Rolling, WordHashes, binary, columns_as, hash_words, mix, signed

BASE_A, BASE_B = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
ASIDE = 0xA24BAED4963EE407

#: Words hashed at a time by one worker.
CHUNK_WORDS = 600_000

#: The shortest level: halving the wanted length ends at this many words or fewer.
SHORTEST = 7

WITNESS, WITNESS_MIXED, SURVIVOR, REMOVED = 0, 1, 2, 3
#: ``place`` packs start, number of windows and state (two bits): fewer bytes to shuffle, and ordered by start.
_NAMES = ["key", "run_hash", "doc_id", "place"]
_RUN_ROWS = "key long, run_hash long, doc_id long, place long"
_FULL_ROWS = "key long, check long, doc_id long, place long"


def _pack(start: np.ndarray, n: np.ndarray, state: np.ndarray) -> np.ndarray:
    return start.astype(np.int64) << 22 | n.astype(np.int64) << 2 | state


def _unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 22, place >> 2 & 0xFFFFF, place & 3


def _doc_chunks(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[tuple]]:
    """Lists of (word hashes, other columns...) of about CHUNK_WORDS words together."""
    cache, rows, total = WordHashes(), [], 0
    for batch in batches:
        others = [batch.column(c).to_pylist() for c in columns]
        for text, *rest in zip(binary(batch.column("text")), *others, strict=True):
            if not text:
                continue
            words = hash_words(text.split(), cache)
            rows.append((words, *rest))
            total += len(words)
            if total >= CHUNK_WORDS:
                yield rows
                rows, total = [], 0
    if rows:
        yield rows


def _joined(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """All word hashes in one array, and where each document starts (and the end)."""
    starts = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(r[0]) for r in rows], out=starts[1:])
    return np.concatenate([r[0] for r in rows]), starts


def _leftmost_min(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values, the place of its smallest value."""
    at, value, have = np.arange(len(h)), h, 1
    while have < width:
        step = min(have, width - have)
        right = value[step:] < value[:-step]
        at = np.where(right, at[step:], at[:-step])
        value = np.where(right, value[step:], value[:-step])
        have += step
    return at


def _lone_key(doc: np.ndarray, start: np.ndarray, salt: int) -> np.ndarray:
    """Keys for rows that are settled already and need no company."""
    return mix(mix(doc.astype(np.uint64) ^ np.uint64(salt)) + start.astype(np.uint64))


def _same_as_before(*columns: np.ndarray) -> np.ndarray:
    out = np.zeros(len(columns[0]), bool)
    if len(out) > 1:
        out[1:] = np.logical_and.reduce([c[1:] == c[:-1] for c in columns])
    return out


def _group_first(same: np.ndarray) -> np.ndarray:
    """Index of the first row of each row's group, for rows in order."""
    return np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))


def levels(window_words: int) -> list[int]:
    """Window lengths of the levels, each at most twice the one before; the last is the wanted one."""
    out = [window_words]
    while out[0] > SHORTEST:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _windows(rows: list[tuple], starts: np.ndarray, window_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the full windows that are candidates: all of them, or those of the surviving runs; and the rows' settled runs."""
    if len(rows[0]) == 2:  # the first level: no runs yet
        doc_of = np.repeat(np.arange(len(rows)), np.diff(starts))
        at = np.arange(max(0, len(doc_of) - window_words + 1))
        return at[at + window_words <= starts[doc_of[at] + 1]], np.zeros(0, np.int64)
    runs = [np.array(r[2], np.int64) for r in rows]
    sizes = [len(r) for r in runs]
    run = np.concatenate(runs)
    base = np.repeat(starts[:-1], sizes)
    start, n, state = _unpack(run)
    live = state != REMOVED
    n, first = n[live], (base + start)[live]
    at = np.sort(np.repeat(first, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
    return at, np.flatnonzero(~live)


def _settled(rows: list[tuple], gone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, document and place of the runs that earlier levels settled, to be carried on."""
    if not len(gone):
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    run = np.concatenate([np.array(r[2], np.int64) for r in rows])[gone]
    doc = np.repeat(np.array([r[1] for r in rows], np.int64), [len(r[2]) for r in rows])[gone]
    return _lone_key(doc, run >> 22, ASIDE), doc, run


def run_level(window_words: int, length: int, first_level: bool):
    """Runs of candidate windows by the hash of their chosen window of ``length`` words."""

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _doc_chunks(batches, ["doc_id"] if first_level else ["doc_id", "runs"]):
            words, starts = _joined(rows)
            window, gone = _windows(rows, starts, window_words)
            old_key, old_doc, old_place = _settled(rows, gone)
            if not len(window):
                if len(gone):
                    columns = (signed(old_key), np.zeros(len(gone), np.int64), old_doc, old_place)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=_NAMES)
                continue
            doc_of = np.repeat(np.arange(len(rows)), np.diff(starts))
            ids = np.array([r[1] for r in rows], np.int64)
            rolling = Rolling(words, BASE_A)
            h = mix(rolling.windows(length))
            place = _leftmost_min(h, window_words - length + 1)[window]
            new = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(window, prepend=-2) != 1))
            first = window[new]
            count = np.diff(new, append=len(window))
            anchor = place[new]
            key = h[anchor]
            run = mix(rolling.runs(first, first + count + window_words - 1) ^ mix((count * 1024 + anchor - first).astype(np.uint64)))
            doc, start = ids[doc_of[first]], first - starts[doc_of[first]]
            order = np.lexsort((start, doc, run, key))
            key, run, doc, start, count = (x[order] for x in (key, run, doc, start, count))
            same_key = _same_as_before(key)
            same_run = same_key & _same_as_before(run)
            lead = _group_first(same_run)
            repeat = (doc != doc[lead]) | (start != start[lead])
            leader = ~same_run
            group = np.cumsum(~same_key) - 1
            mixed = (np.bincount(group, weights=leader) > 1)[group]
            state = np.where(leader, np.where(same_key, SURVIVOR, np.where(mixed, WITNESS_MIXED, WITNESS)), REMOVED)
            keep = leader | repeat
            alone = state >= SURVIVOR
            key = np.where(alone, _lone_key(doc, start, ASIDE), key)
            columns = (
                np.concatenate([signed(key)[keep], signed(old_key)]), np.concatenate([signed(run)[keep], np.zeros(len(gone), np.int64)]),
                np.concatenate([doc[keep], old_doc]), np.concatenate([_pack(start, count, state)[keep], old_place]),
            )
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=_NAMES)

    return rows_of


def full_level(window_words: int, first_level: bool):
    """Each candidate window by the hash of all its words."""

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _doc_chunks(batches, ["doc_id"] if first_level else ["doc_id", "runs"]):
            words, starts = _joined(rows)
            whole, gone = _windows(rows, starts, window_words)
            old_key, old_doc, old_place = _settled(rows, gone)
            a, b = Rolling(words, BASE_A), Rolling(mix(words), BASE_B)
            key, check = mix(a.runs(whole, whole + window_words)), mix(b.runs(whole, whole + window_words))
            doc_of = np.repeat(np.arange(len(rows)), np.diff(starts))[whole]
            of, at = np.array([r[1] for r in rows], np.int64)[doc_of], whole - starts[doc_of]
            order = np.lexsort((at, of, check, key))
            key, check, of, at = key[order], check[order], of[order], at[order]
            same = _same_as_before(key) & _same_as_before(check)
            lead = _group_first(same)
            keep = ~same | (of != of[lead]) | (at != at[lead])
            key = np.where(same, _lone_key(of, at, ASIDE), key)
            settled = np.where(same, REMOVED, SURVIVOR)
            columns = (
                np.concatenate([signed(key)[keep], signed(old_key)]), np.concatenate([signed(check)[keep], np.zeros(len(gone), np.int64)]),
                np.concatenate([of[keep], old_doc]), np.concatenate([_pack(at, np.ones(len(at), np.int64), settled)[keep], old_place]),
            )
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "check", "doc_id", "place"])

    return rows_of


def remove_words(window_words: int, with_text: bool):
    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digest, texts = [], [], [], []
            for text, spans in zip(binary(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
                words = (text or b"").split()
                kept = words
                if spans:
                    span = np.array(spans, np.int64)
                    start, n, _ = _unpack(span)
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + n + window_words - 1, -1)
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                body = b" ".join(kept)
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                digest.append(hashlib.sha256(body).hexdigest())
                if with_text:
                    texts.append(body)
            columns = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest)]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns.append(pa.array(texts, pa.binary()).cast(pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows_of


def _texts(docs: DataFrame) -> DataFrame:
    return columns_as(docs, doc_id="bigint", text="string")


def _state() -> Column:
    return F.col("place").bitwiseAND(3)


def _at() -> Column:
    return F.struct(F.col("doc_id"), F.shiftright("place", 22).alias("start"))


def judged_runs(runs: DataFrame) -> DataFrame:
    """doc_id, run: the runs of a level that are settled or survive it."""
    by_key = Window.partitionBy("key")
    ordered = by_key.orderBy("run_hash", "doc_id", "place")
    open_run = F.when(_state() <= WITNESS_MIXED, F.col("run_hash"))
    judged = runs.withColumns({
        "lead": F.first(_at()).over(Window.partitionBy("key", "run_hash").orderBy("doc_id", "place")),
        "repeat": F.coalesce(F.lag("run_hash").over(ordered) == F.col("run_hash"), F.lit(False)),
        "mixed": (F.min(open_run).over(by_key) < F.max(open_run).over(by_key)) | (F.max(F.when(_state() == WITNESS_MIXED, 1).otherwise(0)).over(by_key) == 1),
    })
    settled = (
        F.when(_state() >= SURVIVOR, _state())
        .when(F.col("repeat"), F.when(F.col("lead") < _at(), REMOVED))
        .when(F.col("mixed"), SURVIVOR)
    )
    return judged.select("doc_id", (F.shiftleft(F.shiftright("place", 2), 2) + settled).alias("run")).filter("run is not null")


def repeated_spans(docs: DataFrame, window_words: int = 20) -> DataFrame:
    """doc_id, place: packed runs of windows whose words also start earlier."""
    if window_words < 1:
        raise ValueError("window_words must be at least 1")
    known = _texts(docs).filter("doc_id is not null")
    candidates = known  # then: the texts with runs that survived
    for length in levels(window_words)[:-1]:
        # dealt out before the window's inputs are computed, so that four longs a row are shuffled
        runs = candidates.mapInArrow(run_level(window_words, length, candidates is known), _RUN_ROWS).repartition("key")
        survivors = judged_runs(runs).groupBy("doc_id").agg(F.collect_list("run").alias("runs"))  # one document's runs
        candidates = known.join(survivors, "doc_id").select("doc_id", "text", "runs")  # the texts' shuffle is reused by each level
    full = candidates.mapInArrow(full_level(window_words, candidates is known), _FULL_ROWS).repartition("key")
    lead = F.first(_at()).over(Window.partitionBy("key", "check").orderBy("doc_id", "place"))
    return full.withColumn("lead", lead).filter((_state() == REMOVED) | (F.col("lead") < _at())).select("doc_id", "place")


def drop_repeats(docs: DataFrame, window_words: int = 20, with_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and (``with_text``) kept_text.

    Each word covered by a window of ``window_words`` words whose sequence also
    starts earlier (smaller doc_id, or same document and earlier start) goes;
    windows are judged on the input, not on what is left.
    """
    packed = repeated_spans(docs, window_words).groupBy("doc_id").agg(F.collect_list("place").alias("spans"))
    texts = _texts(docs)
    # the filtered texts are those of repeated_spans, so their shuffle is reused
    judged = texts.filter("doc_id is not null").join(packed, "doc_id", "left")
    unnamed = texts.filter("doc_id is null").withColumn("spans", F.lit(None).cast("array<long>"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return judged.unionByName(unnamed).mapInArrow(remove_words(window_words, with_text), schema)


#: DuckDB SQL for the rows of ``drop_repeats(documents, 20, with_text=False)``.
SQL = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS a FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(a) - 18)) AS i, unnest(list_transform(range(1, len(a) - 18), lambda i: md5(array_to_string(a[i:i + 19], ' ')))) AS g FROM d WHERE len(a) >= 20),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1 AS again FROM s),
w AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS word FROM d),
c AS (SELECT w.doc_id, w.i, word, coalesce(bool_or(again) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone
  FROM w LEFT JOIN r ON r.doc_id = w.doc_id AND r.i = w.i)
SELECT d.doc_id, count(word)::BIGINT AS n_words, coalesce(sum(gone::INT), 0)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id) GROUP BY d.doc_id"""
