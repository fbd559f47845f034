"""The sequential state of the evaluator and the cache as Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def accommodation_stream(turns: DataFrame, time: str | None = None, delay: str = "1 hour", idle_ms: int = 86_400_000) -> DataFrame:
    """turns(conv_id, turn, speaker, cmi) as a stream to conv_id, turn, partner_mean: state is the last two values of each speaker.

    With ``time`` (a column of turns) a conversation is over, and its state
    goes, when the watermark is ``idle_ms`` past its last turn.
    """

    def of_group(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        names, first, second = (list(x) for x in state.get) if state.exists else ([], [], [])
        seen = {n: [v for v in (a, b) if v is not None] for n, a, b in zip(names, first, second, strict=True)}
        rows = []
        turns_of = pd.concat(list(frames)).sort_values("turn")
        last_ms = int(turns_of[time].max().timestamp() * 1000) if time else 0
        for row in turns_of.itertuples():
            others = [v for n, values in seen.items() if n != row.speaker for v in values][-2:]
            rows.append((key[0], row.turn, sum(others) / len(others) if others else None))
            seen[row.speaker] = [*seen.get(row.speaker, []), row.cmi][-2:]
        state.update((list(seen), [v[0] for v in seen.values()], [v[1] if len(v) > 1 else None for v in seen.values()]))
        if time:
            state.setTimeoutTimestamp(max(last_ms + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["conv_id", "turn", "partner_mean"])

    timed = turns.withWatermark(time, delay) if time else turns
    timeout = GroupStateTimeout.EventTimeTimeout if time else GroupStateTimeout.NoTimeout
    return timed.groupBy("conv_id").applyInPandasWithState(
        of_group, "conv_id long, turn long, partner_mean double", "names array<string>, a array<double>, b array<double>", "append", timeout
    )


def fresh_texts(docs: DataFrame, time: str, delay: str = "1 hour") -> DataFrame:
    """A stream of texts without those seen before: state is one hash a text, kept until the watermark passes."""
    text = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[\x09-\x0D\x20\p{Z}]+", "")
    return docs.withWatermark(time, delay).withColumn("text_hash", F.md5(text)).dropDuplicatesWithinWatermark(["text_hash"])


def cache_stream(requests: DataFrame, ttl_seconds: int, delay: str = "1 hour") -> DataFrame:
    """requests(key, t, o) as a stream to key, o, hit; state is the time of the key's last miss.

    The state goes when the watermark passes the end of its time to live: any
    later request is a miss with or without it.
    """

    def of_group(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = []
        for row in pd.concat(list(frames)).sort_values(["t", "o"]).itertuples():
            now = row.t.timestamp()
            hit = last is not None and now - last < ttl_seconds
            last = last if hit else now
            rows.append((key[0], row.o, hit))
        state.update((last,))
        state.setTimeoutTimestamp(max(int((last + ttl_seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["key", "o", "hit"])

    timed = requests.withWatermark("t", delay).groupBy("key")
    return timed.applyInPandasWithState(of_group, "key string, o long, hit boolean", "last double", "append", GroupStateTimeout.EventTimeTimeout)


def gram_novelty(grams: DataFrame) -> DataFrame:
    """grams(gram, doc_id) as a stream to gram, doc_id, seen: whether an earlier text had the shingle; state is one key a shingle, kept for good."""

    def of_group(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first = state.get[0] if state.exists else None
        rows = []
        for doc_id in sorted({int(x) for frame in frames for x in frame.doc_id}):
            rows.append((key[0], doc_id, first is not None and first != doc_id))
            first = doc_id if first is None else first
        state.update((first,))
        yield pd.DataFrame(rows, columns=["gram", "doc_id", "seen"])

    return grams.groupBy("gram").applyInPandasWithState(of_group, "gram long, doc_id long, seen boolean", "first long", "append", GroupStateTimeout.NoTimeout)
