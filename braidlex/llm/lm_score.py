"""Language-model scores by stupid backoff, computed relationally.

Count tables. Documents are dealt by a hash of id and text into chunks of about
``CHUNK_BYTES``; rows that are equal in both are one document with a number of
copies, so that no row, however often it is repeated, fills a chunk. Each chunk explodes its n-grams of all orders, counts them,
and sends the distinct ones, sorted by 64-bit hash, to the hash ranges
(buckets) that hold the count table. A bucket adds up the counts of all chunks
and answers each chunk with the totals of the n-grams that it asked for: the
join of the exploded n-grams with the count table, one row for each chunk and
bucket. The chunk then sums the scores of its documents.

Score of a word after its context: (c(context word) - own) / (c(context) - own)
where another document has the n-gram, else ``ALPHA`` times the score one order
down; ``own`` are the document's own occurrences, so a text does not vouch for
itself. At the lowest order, the word's count elsewhere (half an occurrence if
it has none) over all words.

Size. Chunks and buckets grow in number with the input, never in size (a chunk
or bucket is one group in memory): a hot n-gram is one entry of each chunk,
whatever the number of its occurrences.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Defined results. Null or empty
text: no words, score 0, mean null. Repeated rows count as documents of their
own, each leaving out its own occurrences only. A null doc_id is a document
like any other. Extra columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import U64, Rolling, WordHashes, binary, columns_as, cut, hash_words, mix, repeated

ALPHA = 0.4
#: Bytes of text in a chunk, and those whose n-grams share a bucket.
CHUNK_BYTES, BUCKET_BYTES = 8_000_000, 12_000_000
#: Chunks or buckets in one partition.
GROUPS = 8
BASE = 0x9E3779B97F4A7C15


def _chunk_ngrams(table: pa.Table, order: int) -> tuple:
    """Document lengths; for each order the n-gram hashes, where they end, and their documents."""
    cache = WordHashes()
    arrays = [hash_words((t or b"").split(), cache) for c in table.column("text").chunks for t in binary(c)]
    lengths = np.array([len(a) for a in arrays], np.int64)
    words = np.concatenate(arrays) if arrays else np.zeros(0, U64)
    doc = np.repeat(np.arange(len(arrays)), lengths)
    left = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)  # words before, in the document
    rolling = Rolling(words, BASE)
    grams = []
    for n in range(1, order + 1):
        end = np.flatnonzero(left >= n - 1)
        h = mix(rolling.windows(n) ^ U64(n * 0x632BE59BD9B4E019 % (1 << 64)))[end - (n - 1)] if len(end) else np.zeros(0, U64)
        grams.append((h, end, doc[end]))
    return lengths, len(words), grams


def _bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def pack(h: np.ndarray) -> bytes:
    """Sorted hashes as differences, in the fewest bytes that hold the largest one."""
    gaps = np.diff(h, prepend=U64(0))
    gaps[0] = 0
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    body = gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + int(h[0]).to_bytes(8, "little") + body.tobytes()


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    body = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    gaps = np.zeros((len(body), 8), np.uint8)
    gaps[:, :width] = body
    out = gaps.view("<u8").ravel().astype(U64)
    out[0] = int.from_bytes(data[1:9], "little")
    return np.cumsum(out, dtype=U64)


def _small(counts: np.ndarray) -> bytes:
    """Counts in the narrowest unsigned type that holds them."""
    kind = "<u1" if not len(counts) or counts.max() < 256 else "<u4" if counts.max() < 1 << 32 else "<u8"
    return bytes([int(kind[2])]) + counts.astype(kind).tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct values, where each starts in the sorted array, and the order that sorts (numpy's ``unique`` takes 64-bit values by a far slower hash table)."""
    order_of = np.argsort(h)
    ordered = h[order_of]
    new = np.ones(len(h), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    starts = np.flatnonzero(new)
    return ordered[starts], starts, order_of


def _requests(order: int, buckets: int):
    def of_chunk(key: tuple, table: pa.Table) -> pa.Table:
        _, _, grams = _chunk_ngrams(table, order)
        copies = table.column("copies").to_numpy()
        h, starts, order_of = _distinct(np.concatenate([g[0] for g in grams]))
        n = np.add.reduceat(np.concatenate([copies[g[2]] for g in grams])[order_of], starts) if len(h) else np.zeros(0, np.int64)
        bucket = _bucket_of(h, buckets)
        edges = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(h))
        out = [(int(bucket[a]), pack(h[a:b]), _small(n[a:b])) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        columns = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table({
            "chunk": pa.array([key[0].as_py()] * len(out), pa.int64()), "bucket": pa.array(columns[0], pa.int64()),
            "grams": pa.array(columns[1], pa.binary()), "counts": pa.array(columns[2], pa.binary()),
        })

    return of_chunk


def _answers(table: pa.Table) -> pa.Table:
    """Total counts of one bucket, for each chunk in the order of its request."""
    hashes = [unpack(x) for x in table.column("grams").to_pylist()]
    counts = [_wide(x) for x in table.column("counts").to_pylist()]
    h, starts, order_of = _distinct(np.concatenate(hashes))
    sums = np.add.reduceat(np.concatenate(counts)[order_of], starts)
    totals = np.empty(len(order_of), np.int64)
    totals[order_of] = np.repeat(sums, np.diff(starts, append=len(order_of)))
    edges = np.cumsum([0, *map(len, hashes)])
    return pa.table({
        "chunk": table.column("chunk"), "bucket": table.column("bucket"),
        "totals": pa.array([_small(totals[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary()),
    })


def _places(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each n-gram among the sorted distinct ones, and its occurrences in its own document.

    Within an order, ``doc`` rises with the position. n-grams are sorted once; then
    place and position in one number are, so that those of a document stand together.
    """
    _, starts, order_of = _distinct(h)
    at = np.empty(len(h), np.int64)
    at[order_of] = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(h)))
    bits = max(1, len(h).bit_length())
    both = np.sort(at << bits | np.arange(len(h)))
    position = both & ((1 << bits) - 1)
    new = np.ones(len(h), bool)
    new[1:] = (np.diff(both >> bits) != 0) | (np.diff(doc[position]) != 0)
    first = np.flatnonzero(new)
    own = np.empty(len(h), np.int64)
    own[position] = np.repeat(np.diff(first, append=len(h)), np.diff(first, append=len(h)))
    return at, own


def _scores(order: int, total_words: int):
    def of_chunk(docs: pa.Table, answers: pa.Table) -> pa.Table:
        lengths, n_words, grams = _chunk_ngrams(docs, order)
        score = np.zeros(n_words)
        backed = np.zeros(n_words, np.int64)
        if n_words:
            by_bucket = answers.sort_by("bucket").column("totals").to_pylist()
            totals = np.concatenate([_wide(x) for x in by_bucket])
            h, doc = (np.concatenate([g[k] for g in grams]) for k in (0, 2))
            at, own = _places(h, doc)
            left = np.split(totals[at] - own, np.cumsum([len(g[0]) for g in grams])[:-1])
            elsewhere = []
            for (_, end, _), counts in zip(grams, left, strict=True):
                full = np.zeros(n_words, np.int64)
                full[end] = counts
                elsewhere.append(full)
            score = np.log(np.maximum(elsewhere[0], 0.5) / total_words)
            for n in range(2, order + 1):
                _, end, _ = grams[n - 1]
                seen = elsewhere[n - 1][end]
                context = elsewhere[n - 2][end - 1]
                hit = seen > 0
                lower = score[end] + math.log(ALPHA)
                score[end] = np.where(hit, np.log(np.maximum(seen, 1) / np.maximum(context, 1)), lower)
                backed[end] += ~hit
        edges = np.cumsum(lengths) - lengths
        filled = np.flatnonzero(lengths)
        sums, backs = np.zeros(len(lengths)), np.zeros(len(lengths), np.int64)
        if len(filled):
            sums[filled] = np.add.reduceat(score, edges[filled])
            backs[filled] = np.add.reduceat(backed, edges[filled])
        mean = [s / n if n else None for s, n in zip(sums.tolist(), lengths.tolist(), strict=True)]
        return pa.table({
            "doc_id": docs.column("doc_id").cast(pa.int64()), "copies": docs.column("copies"), "n_words": pa.array(lengths), "n_backoff": pa.array(backs),
            "log_score": pa.array(sums), "mean_log_score": pa.array(mean, pa.float64()),
        })

    return of_chunk


def _documents(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """doc_id, text, digest and copies of the distinct rows; bytes and words of all rows."""
    key = ["named", "id", "length", "digest"]
    texts = columns_as(docs, doc_id="bigint", text="string").withColumns({
        "named": F.col("doc_id").isNotNull(), "id": F.coalesce("doc_id", F.lit(0)), "length": F.coalesce(F.octet_length("text"), F.lit(-1)), "digest": F.xxhash64("text"),
    })
    light = cut(texts.select(*key, F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).alias("n_words")), "lengths")
    size = light.agg(F.sum(F.greatest("length", F.lit(0))).alias("n_bytes"), F.sum("n_words").alias("n_words")).first()
    again = cut(light.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"), "repeated")
    columns = ["doc_id", "text", "digest"]
    if again.isEmpty():
        once = texts.select(*columns, F.lit(1).cast("long").alias("copies"))
    else:
        single = texts.join(again, key, "left_anti").select(*columns, F.lit(1).cast("long").alias("copies"))
        many = texts.join(again, key, "left_semi").groupBy(*key).agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text"), F.count(F.lit(1)).alias("copies"))
        once = single.unionByName(many.select(*columns, "copies"))
    return once, size.n_bytes or 0, size.n_words or 0


def score(docs: DataFrame, order: int = 2) -> DataFrame:
    """doc_id, n_words, n_backoff (steps down), log_score (natural logarithms, summed), mean_log_score."""
    texts, n_bytes, n_words = _documents(docs)
    chunks, buckets = (max(1, math.ceil(n_bytes / size)) for size in (CHUNK_BYTES, BUCKET_BYTES))
    usual = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(usual, math.ceil(chunks / GROUPS))
    dealt = texts.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(chunks)).cast("long")).drop("digest").repartition(parts, "chunk")
    asked = dealt.groupBy("chunk").applyInArrow(_requests(order, buckets), "chunk long, bucket long, grams binary, counts binary")
    answered = asked.repartition(max(usual, math.ceil(buckets / GROUPS)), "bucket").groupBy("bucket").applyInArrow(_answers, "chunk long, bucket long, totals binary")
    scored = (
        dealt.groupBy("chunk")
        .cogroup(answered.repartition(parts, "chunk").groupBy("chunk"))
        .applyInArrow(_scores(order, max(1, n_words)), "doc_id long, copies long, n_words long, n_backoff long, log_score double, mean_log_score double")
    )
    return repeated(scored, "copies").drop("copies", "__copy")


SQL = rf"""WITH w AS (
  SELECT doc_id, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS w
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS a FROM documents)),
g AS (SELECT doc_id, i, w, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM w),
own1 AS (SELECT doc_id, w, count(*) AS n FROM g GROUP BY ALL),
all1 AS (SELECT w, sum(n) AS n FROM own1 GROUP BY ALL),
own2 AS (SELECT doc_id, p, w, count(*) AS n FROM g WHERE p IS NOT NULL GROUP BY ALL),
all2 AS (SELECT p, w, sum(n) AS n FROM own2 GROUP BY ALL),
e1 AS (SELECT doc_id, w, all1.n - own1.n AS n FROM own1 JOIN all1 USING (w)),
e2 AS (SELECT doc_id, p, w, all2.n - own2.n AS n FROM own2 JOIN all2 USING (p, w)),
s AS (SELECT g.doc_id, CASE WHEN g.p IS NOT NULL AND e2.n = 0 THEN 1 ELSE 0 END AS back,
  CASE WHEN e2.n > 0 THEN ln(e2.n / greatest(c.n, 1))
       ELSE ln(greatest(u.n, 0.5) / (SELECT count(*) FROM w)) + CASE WHEN g.p IS NOT NULL THEN ln({ALPHA}) ELSE 0 END END AS s
  FROM g JOIN e1 u ON u.doc_id = g.doc_id AND u.w = g.w
  LEFT JOIN e1 c ON c.doc_id = g.doc_id AND c.w = g.p
  LEFT JOIN e2 ON e2.doc_id = g.doc_id AND e2.p = g.p AND e2.w = g.w)
SELECT d.doc_id, count(s.s)::BIGINT AS n_words, coalesce(sum(back), 0)::BIGINT AS n_backoff,
  round(coalesce(sum(s), 0.0), 5) AS log_score, round(avg(s), 7) AS mean_log_score
FROM documents d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id"""
