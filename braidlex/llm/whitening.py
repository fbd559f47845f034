"""Whitening of embeddings with moments merged by Chan's formula.

Vectors become whole numbers (``vectors.scaled``). The fit list holds each
distinct vector once. Every partition of it computes its count, its own mean
and the scatter centred on that mean; two of these are merged by Chan's
formula, scatter + scatter + outer(d, d) * n1 * n2 / (n1 + n2) with d the
difference of the means, in a treeReduce. So nothing is squared before it is
centred, whatever the offset of the data. The driver gets one matrix of
dimension x dimension and decomposes it. A second pass over the fit list
whitens it, merges the moments of the result in the same way, and compares its
covariance with the identity.

The distinct step combines equal vectors before its shuffle, so a vector that
stands in many rows costs one row a task. All else is partial sums: one small
matrix a partition.

Defined results. Vectors that are null or hold null or non-finite entries are
left out. So are vectors of another length than the one that most distinct
vectors have (ties: the longer), as they lie in another space; empty vectors
have no components and no rows. A null id is carried along; repeated rows are
rows of the result each. Directions without variance (all vectors equal, fewer
vectors than dimensions) cannot be whitened: their ``whitened`` is null and
they take no part in the check; ``explained`` is 0 then. An empty table gives
an empty table. Extra columns are ignored. A deviation beyond a long is the
nearest long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut
from .vectors import LONG_MAX, largest, matrix, scaled, to_long

#: Rows whose moments are taken at a time.
BLOCK_ROWS = 8192


@dataclass
class Moments:
    """Count, exact sums, mean and centred scatter of rows."""

    n: int
    sums: list[int]
    mean: np.ndarray
    scatter: np.ndarray

    @staticmethod
    def none(width: int) -> Moments:
        return Moments(0, [0] * width, np.zeros(width), np.zeros((width, width)))

    @staticmethod
    def of(rows: np.ndarray) -> Moments:
        """Moments of one block; ``sums`` are exact for whole numbers."""
        if rows.dtype.kind != "i":
            sums = [0] * rows.shape[1]
        else:
            safe = largest(rows) * len(rows) <= LONG_MAX
            sums = [int(s) for s in (rows if safe else rows.astype(object)).sum(axis=0)]
        wide = rows.astype(np.float64)
        mean = wide.mean(axis=0)
        wide -= mean
        return Moments(len(rows), sums, mean, wide.T @ wide)

    def merged(self, other: Moments) -> Moments:
        """Chan's formula for two disjoint sets of rows."""
        if not self.n or not other.n:
            return self if self.n else other
        n = self.n + other.n
        apart = other.mean - self.mean
        scatter = self.scatter + other.scatter + np.outer(apart, apart) * (self.n * other.n / n)
        return Moments(n, [a + b for a, b in zip(self.sums, other.sums)], self.mean + apart * (other.n / n), scatter)


@dataclass
class Whitening:
    """What ``fit`` found: bounded by the dimension, whatever the number of rows."""

    n: int
    sums: list[int]
    components: np.ndarray  # one unit vector a column, by falling eigenvalue
    eigenvalues: np.ndarray
    trace: float
    identity_error: float | None = None
    usable: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        top = self.eigenvalues.max(initial=0.0)
        self.usable = self.eigenvalues > top * len(self.sums) * np.finfo(float).eps

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def explained(self) -> np.ndarray:
        return np.where(self.usable, self.eigenvalues, 0.0) / (self.trace or 1.0)

    def project(self, x: np.ndarray, components: slice | np.ndarray) -> np.ndarray:
        """Whitened coordinates of the rows of ``x``; directions without variance give NaN."""
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(self.usable, 1 / np.sqrt(np.where(self.usable, self.eigenvalues, 1.0)), np.nan)
        return ((x - self.mean) @ self.components[:, components]) * scale[components]

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n * x - S) ^ 2 in whole numbers."""
        bound = self.n * largest(x) + max(map(abs, self.sums), default=0)
        if bound * bound * max(1, len(self.sums)) <= LONG_MAX:
            off = self.n * x - np.array(self.sums, np.int64)
            return np.einsum("ij,ij->i", off, off)
        off = self.n * x.astype(object) - np.array(self.sums, object)
        return to_long((off * off).sum(axis=1))


def moments(rows: DataFrame, width: int, change: Callable[[np.ndarray], np.ndarray] | None = None, out_width: int | None = None) -> Moments:
    """Moments of ``x`` (an array of ``width`` longs), or of what ``change`` makes of blocks of it, over all rows."""
    wide = out_width or width

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Moments.none(wide)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                block = matrix(batch.column("x").slice(at, BLOCK_ROWS), width)
                total = total.merged(Moments.of(change(block) if change else block))
        yield pa.RecordBatch.from_arrays(
            [pa.array([total.n]), pa.array([[str(s) for s in total.sums]]), pa.array([total.mean.tobytes()]), pa.array([total.scatter.tobytes()])],
            names=["n", "sums", "mean", "scatter"],
        )

    def read(row) -> Moments:
        return Moments(row.n, [int(s) for s in row.sums], np.frombuffer(row.mean), np.frombuffer(row.scatter).reshape(wide, wide))

    parts = rows.select("x").mapInArrow(of_partition, "n long, sums array<string>, mean binary, scatter binary").rdd
    if not parts.getNumPartitions():
        return Moments.none(wide)
    return parts.map(read).treeReduce(Moments.merged)


def fit(vectors: DataFrame, components: int | None = None) -> tuple[Whitening | None, int]:
    """The whitening of ``vectors`` (of ``vectors.scaled``), checked by a second pass, and their length; None without vectors."""
    listed = cut(vectors.select("x").distinct(), "fit_list")
    lengths = listed.groupBy(F.size("x").alias("width")).count()
    common = lengths.filter("width > 0").orderBy(F.desc("count"), F.desc("width")).first()  # one row
    if common is None:
        return None, 0
    width = common.width
    listed = listed.filter(F.size("x") == width)
    found = moments(listed, width)
    values, axes = np.linalg.eigh(found.scatter / found.n)
    values, axes = values[::-1].copy(), axes[:, ::-1].copy()
    axes *= np.where(axes[np.abs(axes).argmax(axis=0), np.arange(width)] < 0, -1.0, 1.0)
    model = Whitening(found.n, found.sums, axes, values, float(np.trace(found.scatter) / found.n))
    checked = np.flatnonzero(model.usable[:components])
    if len(checked):
        again = moments(listed, width, lambda x: model.project(x, checked), len(checked))
        model.identity_error = float(np.abs(again.scatter / again.n - np.eye(len(checked))).max())
    else:
        model.identity_error = 0.0
    return model, width


def whiten(table: DataFrame, components: int | None = None, vector: str = "embedding", key: str = "vec_id", scale: int = 256) -> DataFrame:
    """One row per usable vector and component: key, component, n, deviation, whitened, explained, identity_error."""
    vectors = scaled(table, vector, key, scale)
    model, width = fit(vectors, components)
    schema = f"`{key}` long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return table.sparkSession.createDataFrame([], schema)
    kept = min(components or width, width)
    explained = model.explained()[:kept]

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                x, n = matrix(part.column("x"), width), part.num_rows
                values = model.project(x, slice(0, kept)).ravel()
                columns = [
                    part.column(key).take(pa.array(np.repeat(np.arange(n), kept))),
                    pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), n)),
                    pa.array(np.full(n * kept, model.n, np.int64)),
                    pa.array(np.repeat(model.deviation(x), kept)),
                    pa.array(values, mask=np.isnan(values)),
                    pa.array(np.tile(explained, n)),
                    pa.array(np.full(n * kept, model.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.filter(F.size("x") == width).mapInArrow(rows_of, schema)
