"""Exact top-k search by inner product with a uniform threshold in three phases.

The dimensions are cut into ``LISTS`` groups. A group's part of the inner
product ranks all candidates of a query in one list; a candidate's score is
the sum of its entries in all lists. Candidates lie in tiles (a list is the
union of its pieces in the tiles), queries in blocks, and each tile meets each
block once in each of two passes:

1. Each piece of a list gives its k best entries. The candidates behind them
   are summed up over the lists, and the k best sums of a tile are gathered.
   The k-th best of all is a score that k candidates reach: a safe cutoff.
2. The cutoff goes to all tiles with its query. A candidate at or above it has
   an entry of at least cutoff / LISTS in some list (were all below, so were
   the sum), so the entries that reach that share are sufficient.
3. Those candidates are bounded from above, an unseen entry counting as the
   share; where the bound reaches the cutoff, the exact sum decides, and the
   tile's k best sums at or above the cutoff are gathered into the answer.

Nothing is approximate. Tiles and blocks have bounded sizes, dealt by a hash of
row numbers, so the shares of ids or of equal vectors do not matter; equal
vectors tie and a tile keeps its k smallest ids of them. Sums are float32 or
float64 products where these hold all sums exactly, else Python integers.

Defined results. Vectors that are null or hold null or non-finite entries take
no part; a candidate of another length than the query has no score. A query is
a distinct (id, vector) whose id is divisible by ``every``; rows with a query's
id are its own and no candidates. Equal rows are one row. Candidates without an
id take part and come last among ties. A query without candidates has no rows.
An empty table gives an empty table. Extra columns are ignored. A score beyond
a long is the nearest long (their order is by the exact one within a tile).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import cut
from .vectors import LONG_MIN, largest, matrix, scaled, to_long

#: Groups of dimensions.
LISTS = 4
#: Most and least candidates of a tile, most queries of a block, sums held at a time.
TILE_ROWS, LEAST_TILE, BLOCK_QUERIES, CHUNK_SUMS = 65_536, 4096, 8192, 2_000_000
#: Sorts after every id.
_LAST = np.iinfo(np.int64).max


def edges(width: int) -> list[tuple[int, int]]:
    """The lists' groups of dimensions."""
    lists = max(1, min(LISTS, width))
    cuts = [round(i * width / lists) for i in range(lists + 1)]
    return list(zip(cuts, cuts[1:]))


def exact_type(bound: int) -> type:
    """The fastest number type that holds whole numbers up to ``bound`` exactly."""
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else object


def best(sums: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest sums, ties by smaller id."""
    if len(sums) > k and sums.dtype != object:
        kth = np.partition(sums, len(sums) - k)[len(sums) - k]
        near = np.flatnonzero(sums >= kth)
        return near[np.lexsort((ids[near], -sums[near]))[:k]]
    return np.array(sorted(range(len(sums)), key=lambda i: (-sums[i], ids[i]))[:k], np.int64)


def heads(entries: list[np.ndarray], k: int) -> Iterator[np.ndarray]:
    """Phase 1: for each query the candidates behind the k best entries of each list."""
    n = entries[0].shape[1]
    if n <= k:
        tops = [np.tile(np.arange(n), (len(entries[0]), 1))]
    elif entries[0].dtype == object:
        tops = [np.array([sorted(range(n), key=row.__getitem__)[-k:] for row in e]) for e in entries]
    else:
        tops = [np.argpartition(e, n - k, axis=1)[:, n - k :] for e in entries]
    for row in np.concatenate(tops, axis=1):
        yield np.unique(row)


def sufficient(entries: list[np.ndarray], cutoff: np.ndarray) -> Iterator[np.ndarray]:
    """Phases 2 and 3: for each query the candidates with a sufficient entry whose upper bound reaches the cutoff."""
    share = -(-cutoff // len(entries))[:, None]  # whole numbers: an entry below it is at most share - 1
    upper, seen = 0, False
    for e in entries:
        enough = e >= share
        seen = enough | seen
        upper = upper + np.where(enough, e, share - 1)
    for row in seen & (upper >= cutoff[:, None]):
        yield np.flatnonzero(row)


def answers(queries: pa.Table, candidates: pa.Table, k: int, width: int, final: bool) -> pa.Table:
    """The k best sums of one tile for each query of one block."""
    if not len(queries) or not len(candidates):  # of a length that only one side has
        return pa.table({name: pa.array([], pa.int64()) for name in ("no", "query_id", "vec_id", "score")})
    x, y = matrix(queries["x"].combine_chunks(), width), matrix(candidates["y"].combine_chunks(), width)
    nameless = np.asarray(candidates["candidate"].is_null())
    ids = np.asarray(candidates["candidate"].fill_null(_LAST), np.int64)
    own, number = np.asarray(queries["vec_id"], np.int64), np.asarray(queries["no"], np.int64)
    lists = edges(width)
    above = largest(x) * largest(y) * max(1, width) + 1  # than any sum of this tile
    kind = exact_type(above * len(lists))
    if final:
        lowest = -above * len(lists)  # below any bound: no cutoff
        given = [lowest if c is None or c == LONG_MIN else min(max(c, lowest), above) for c in queries["cutoff"].to_pylist()]
        cutoff = np.array(given, object).astype(kind)
    xs, ys = x.astype(kind), y.astype(kind)
    found = []
    step = max(1, CHUNK_SUMS // len(y))
    for at in range(0, len(x), step):
        entries = [xs[at : at + step, a:b] @ ys[:, a:b].T for a, b in lists]
        for q, places in enumerate(sufficient(entries, cutoff[at : at + step]) if final else heads(entries, k + 1)):
            places = places[(ids[places] != own[at + q]) | nameless[places]]
            sums = sum(e[q, places] for e in entries)
            if final:
                places, sums = places[sums >= cutoff[at + q]], sums[sums >= cutoff[at + q]]
            top = best(sums, ids[places], k)
            found.append((np.full(len(top), at + q), places[top], to_long(sums[top]) if kind is object else sums[top]))
    at, places, sums = (np.concatenate(part).astype(np.int64) for part in zip(*found))
    return pa.table({"no": number[at], "query_id": own[at], "vec_id": pa.array(ids[places], mask=nameless[places]), "score": sums})


def met(queries: DataFrame, candidates: DataFrame, tiles: int, blocks: int, k: int, final: bool) -> DataFrame:
    """The answers of each pair of a block of queries and a tile of candidates of one length."""

    def dealt(parts: int) -> Column:
        return F.pmod(F.xxhash64("no"), F.lit(parts)).cast("int")

    def to_each(parts: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    def work(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return answers(left, right, k, key[0].as_py(), final)

    width = F.size("x").alias("width")
    left = queries.select("*", width, dealt(blocks).alias("block")).withColumn("tile", to_each(tiles))
    # new names: a cogroup takes columns that both sides read from one table for the same
    right = candidates.select(F.col("vec_id").alias("candidate"), F.col("x").alias("y"), width, dealt(tiles).alias("tile")).withColumn("block", to_each(blocks))
    keys = ["width", "block", "tile"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(work, "no long, query_id long, vec_id long, score long")


def k_best(found: DataFrame, k: int) -> DataFrame:
    best_first = Window.partitionBy("no").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)


def search(table: DataFrame, k: int = 5, every: int = 50, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query."""
    rows = cut(scaled(table, vector, "vec_id", scale).distinct().withColumn("no", F.monotonically_increasing_id()), "vectors")
    queries = rows.filter(F.col("vec_id") % every == 0)
    n, n_queries = rows.count(), queries.count()
    cores = table.sparkSession.sparkContext.defaultParallelism
    tiles = max(1, -(-n // TILE_ROWS), min(2 * cores, -(-n // LEAST_TILE)))
    blocks = max(1, -(-n_queries // BLOCK_QUERIES))

    gathered = k_best(met(queries, rows, tiles, blocks, k, final=False), k)
    kth = gathered.groupBy("no").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("cutoff"))
    with_cutoff = cut(queries.join(kth, "no", "left"), "cutoffs")
    found = k_best(met(with_cutoff, rows, tiles, blocks, k, final=True), k)
    return found.select("query_id", "rank", "vec_id", "score")


def search_sql(k: int = 5, every: int = 50, scale: int = 256) -> str:
    """DuckDB SQL for the rows of ``search`` over ``embeddings``."""
    return f"""WITH v AS (SELECT DISTINCT vec_id, [floor({scale} * c::DOUBLE)::BIGINT for c in embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len([c for c in embedding if c IS NULL OR NOT isfinite(c)]) = 0),
s AS (SELECT q.vec_id AS query_id, q.x AS qx, c.vec_id, coalesce(list_sum([z[1] * z[2] for z in list_zip(q.x, c.x)]), 0)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id IS DISTINCT FROM q.vec_id AND len(c.x) = len(q.x) WHERE q.vec_id % {every} = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id, qx ORDER BY score DESC, vec_id NULLS LAST)::INT AS rank, vec_id, score FROM s
QUALIFY rank <= {k}"""
