"""Topic snippets: provider chain, de-duplication, limits, cache, rendering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def truncate(text: Column, limit: int = 300) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "<[^>]+>", ""), r"^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$", "")


def provider_chain(snippets: DataFrame, limit: int, chain: DataFrame, fallback: str = "web_search") -> DataFrame:
    """snippets(topic, provider, pos, title) by the providers of ``chain`` (topic, provider, priority), in its order.

    A provider is asked while those before it have fewer than ``limit`` rows;
    of the rows one a title stays, then the first ``limit``. A topic that the
    chain does not name has ``fallback`` alone; providers outside a topic's
    chain, and chain entries without snippets, are skipped. Rows with an error
    (where there is such a column) are no snippets.
    """
    if "error" in snippets.columns:
        snippets = snippets.filter("error is null")
    given = chain.select("topic", "provider", "priority")
    others = snippets.filter(F.col("provider") == fallback).join(given, "topic", "left_anti").withColumn("priority", F.lit(0))
    known = snippets.join(given, ["topic", "provider"]).unionByName(others)
    counts = known.groupBy("topic", "provider", "priority").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("topic").orderBy("priority", "provider").rowsBetween(Window.unboundedPreceding, -1)
    asked = counts.withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0))).filter(F.col("earlier") < limit).select("topic", "provider")
    rows = known.join(asked, ["topic", "provider"]).withColumn("key", F.lower(F.trim("title")))
    once = rows.withColumn("r", F.row_number().over(Window.partitionBy("topic", "key").orderBy("priority", "provider", "pos"))).filter("r = 1").drop("r", "key")
    rank = F.row_number().over(Window.partitionBy("topic").orderBy("priority", "provider", "pos"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= limit).drop("priority")


def ttl_cache(requests: DataFrame, keys: list[str], time: str, order: str, ttl_seconds: int, found: str | None = None, answered_by: str | None = None) -> DataFrame:
    """keys, ``order`` and ``hit``: a request misses where the last kept miss of its key is ``ttl_seconds`` old or more.

    A hit renews nothing. With ``found`` (a boolean column) a miss without a
    result is not kept. Times are those of ``time``, ties in ``order`` (a long).
    ``answered_by`` names a further column: the ``order`` of the request whose
    result answers this one, its own for a miss.

    This is a true recurrence: rows are dealt by key, sorted by Spark, and
    walked in order with the last kept miss as the only state, so a hot key
    takes a stream of rows, never a group in memory.
    """
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    kept = F.coalesce(F.col(found), F.lit(False)) if found else F.lit(True)
    rows = requests.select(*keys, F.col(order), F.xxhash64(*keys).alias("__key"), micros.alias("__t"), kept.alias("__kept"))
    walked = rows.repartition(*keys).sortWithinPartitions(*keys, "__t", order)
    columns = [*keys, order]
    kinds = dict(requests.dtypes)
    ttl = ttl_seconds * 1_000_000

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, source = None, None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            now = list(zip(*(batch.column(c).to_pylist() for c in keys), strict=True))
            hashed = batch.column("__key").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(hashed)) + 1).tolist(), n]
            times, stays = batch.column("__t").to_numpy(), batch.column("__kept").to_numpy(zero_copy_only=False)
            hit = np.zeros(n, bool)
            own = batch.column(order).to_pylist() if answered_by else [None] * n
            answer = list(own)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if now[a] != key:
                    key, last, source = now[a], None, None
                at = a
                while at < b:
                    if last is not None:
                        stop = a + int(np.searchsorted(times[a:b], last + ttl, "left"))
                        hit[at:stop] = True
                        answer[at : max(at, stop)] = [source] * (max(at, stop) - at)
                        at = max(at, stop)
                    misses = np.flatnonzero(stays[at:b])
                    if not len(misses):
                        break
                    at += int(misses[0])  # the first miss with a result is kept; those before it are misses too
                    last, source = int(times[at]), own[at]
                    at += 1
            more = {answered_by: pa.array(answer)} if answered_by else {}
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(hit), *more.values()], names=[*columns, "hit", *more])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", hit boolean" + (f", `{answered_by}` {kinds[order]}" if answered_by else "")
    return walked.mapInArrow(rows_of, schema)


def cached_values(requests: DataFrame, results: DataFrame, keys: list[str], time: str, order: str, ttl_seconds: int, found: str | None = None) -> DataFrame:
    """The requests of ``ttl_cache`` with the result that answers them.

    An as-of join: ``results`` has what was fetched (``order``, and any other
    columns) at misses; a hit gets the row of its key's last kept miss. The
    join is on the unique ``order``, so a hot key is spread over all tasks. A
    request whose fetch gave nothing has nulls.
    """
    walked = ttl_cache(requests, keys, time, order, ttl_seconds, found, "answered_by")
    told = results.withColumnRenamed(order, "answered_by")
    return walked.join(told, "answered_by", "left").select(*keys, order, "hit", "answered_by", *[c for c in results.columns if c != order])


#: Our own frames of a block of snippets, by language.
FRAMES = {
    "en": ("Facts that may help with this topic:\n\n", "\n\nUse what fits, said your own way."),
    "zh": ("与话题有关的资料：\n\n", "\n\n可选用其中合适的内容，换成自己的话。"),
}


def format_snippets(df: DataFrame, key: str, frame: tuple[str, str] = FRAMES["en"]) -> DataFrame:
    """df(key, rank, content, source) to one numbered block a key between the two texts of ``frame``."""
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), F.col("content"), F.when(F.coalesce("source", F.lit("")) != "", F.concat(F.lit("\n   ("), F.col("source"), F.lit(")"))).otherwise(""))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n\n")
    return df.groupBy(key).agg(F.concat(F.lit(frame[0]), body, F.lit(frame[1])).alias("block"))
