"""Boundaries to the outside: snippet providers, language models, speech synthesis.

Each takes a client object; the fakes here need no network and serve the tests.
"""

from __future__ import annotations

import math
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import partial
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from braidlex.functions.audio import write_wav

Fetch = Callable[[str, int], list[tuple[str, str, str]]]


def fake_fetch(topic: str, limit: int) -> list[tuple[str, str, str]]:
    return [(f"{topic} {i}", f"About {topic}, part {i}.", "fake") for i in range(1, limit + 1)]


#: Names of the usual providers; without a client for them they are served by the fake.
PROVIDERS = ("hackernews", "arxiv", "wikipedia", "newsapi", "tmdb", "semantic_scholar", "web_search")


class SnippetSource(DataSource):
    """``spark.read.format("snippets")``: one partition a topic; options provider, topics (comma-separated), limit.

    A provider that fails gives one row with its error, so that the chain can
    go on to the next one; an unknown name is an error of the query.
    """

    providers: dict[str, Fetch] = dict.fromkeys(PROVIDERS, fake_fetch)

    @classmethod
    def name(cls) -> str:
        return "snippets"

    def schema(self) -> str:
        return "topic string, pos int, title string, content string, source string, error string"

    def reader(self, schema) -> DataSourceReader:
        return SnippetReader(self.options, self.providers)


class SnippetReader(DataSourceReader):
    def __init__(self, options, providers: dict[str, Fetch]) -> None:
        name = options.get("provider", "web_search")
        if name not in providers:
            raise ValueError(f"no provider {name!r}; there are {', '.join(sorted(providers))}")
        self.fetch, self.limit = providers[name], int(options.get("limit", "3"))
        self.topics = [t for t in options.get("topics", "").split(",") if t]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(t) for t in self.topics]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        try:
            found = self.fetch(partition.value, self.limit)
        except Exception as e:
            yield partition.value, None, None, None, None, f"{type(e).__name__}: {e}"
            return
        for pos, (title, content, source) in enumerate(found):
            yield partition.value, pos, title, content, source, None


def register_sources(spark: SparkSession, providers: dict[str, Fetch] | None = None) -> None:
    """Make the source known with these providers besides the fakes; the functions travel to the workers with it."""
    known = SnippetSource.providers | (providers or {})

    class Snippets(SnippetSource):  # a class of this call, so that its functions are sent by value
        providers = known

    spark.dataSource.register(Snippets)


def limited(call: Callable[[], str], seconds: float | None) -> str:
    """``call()`` in a thread of its own, given up after ``seconds`` (the thread ends with the worker)."""
    if seconds is None:
        return call()
    found: list = []

    def run() -> None:
        try:
            found.append((call(), None))
        except Exception as e:
            found.append((None, e))

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if not found:
        raise TimeoutError(f"no answer within {seconds:g} seconds")
    value, error = found[0]
    if error is not None:
        raise error
    return value


def chat(
    prompts: DataFrame, client: Callable[..., str], attempts: int = 3, keys: tuple[str, ...] = ("id",), parallel: int = 8, seconds: float | None = None, endpoints: int = 0
) -> DataFrame:
    """prompts(keys, prompt) to keys, reply, error: the client's answer, retried, the last error where none came.

    Keys are longs. Up to ``parallel`` calls of a worker are under way at a
    time; answers keep the order of the prompts. A call that takes longer than
    ``seconds`` counts as failed. With ``endpoints`` the client is called with
    the number of an endpoint besides the prompt: a worker goes round them by
    its count of calls, retries included, so their loads differ by one at most;
    the columns ``calls`` and ``endpoint`` (of the last call) say what was done.
    """
    extra = ["calls", "endpoint"] if endpoints else []

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        turns = count(context.partitionId() if context else 0)  # workers start at different endpoints

        def one(prompt: str) -> tuple:
            reply = error = endpoint = None
            for made in range(1, attempts + 1):
                endpoint = next(turns) % endpoints if endpoints else None
                try:
                    reply = limited(partial(client, prompt, endpoint) if endpoints else partial(client, prompt), seconds) or None
                    error = None if reply else "empty reply"
                except Exception as e:
                    error = str(e)
                if reply:
                    break
            return reply, error, made, endpoint

        with ThreadPoolExecutor(parallel) as pool:
            for batch in batches:
                columns = list(zip(*pool.map(one, batch.column("prompt").to_pylist()), strict=True)) or [()] * 4
                arrays = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int32()), strict=True)]
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], *arrays[: 2 + len(extra)]], names=[*keys, "reply", "error", *extra])

    schema = ", ".join(f"{k} long" for k in keys) + ", reply string, error string" + "".join(f", {name} int" for name in extra)
    return prompts.select(*[F.col(k).cast("long").alias(k) for k in keys], "prompt").mapInArrow(rows_of, schema)


def fake_voice(text: str, rate: int = 16000) -> np.ndarray:
    """A tone of 50 ms a character, in [-1, 1]."""
    return 0.3 * np.sin(np.arange(len(text) * rate // 20) * 2 * math.pi * 220 / rate)


def synthesize(
    pieces: DataFrame, voice: Callable[[str], np.ndarray] = fake_voice, rate: int = 16000, attempts: int = 3, backoff: float = 1.0, marker: str = "", batch_bytes: int = 16_000_000
) -> DataFrame:
    """pieces(conv_id, turn, pieces) to conv_id, turn, wav, seconds, error.

    Each piece is spoken by ``voice`` (called with the marker before the text);
    a call that fails is made again after ``backoff`` seconds, then twice that.
    A turn with a piece that fails every time has no sound but the last error;
    the others go on. Samples are clipped to [-1, 1] and joined. Batches of the
    result hold about ``batch_bytes`` of sound.
    """

    def spoken(text: str) -> np.ndarray:
        for attempt in range(attempts):
            try:
                return voice(marker + text)
            except Exception:
                if attempt == attempts - 1:
                    raise
                time.sleep(backoff * 2**attempt)
        raise ValueError("attempts must be at least 1")

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv_id", "turn", "wav", "seconds", "error"])

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for conv_id, turn, texts in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "pieces")), strict=True):
                try:
                    whole = np.concatenate([np.zeros(0), *map(spoken, texts or [])])
                    row = (conv_id, turn, write_wav((np.clip(whole, -1, 1) * 32767).astype(np.int64), rate), round(len(whole) / rate, 3), None)
                except Exception as e:
                    row = (conv_id, turn, None, None, f"{type(e).__name__}: {e}")
                held.append(row)
                size += len(row[2] or b"")
                if size >= batch_bytes:
                    yield batch_of(held)
                    held, size = [], 0
        if held:
            yield batch_of(held)

    return pieces.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "pieces").mapInArrow(rows_of, "conv_id long, turn long, wav binary, seconds double, error string")
