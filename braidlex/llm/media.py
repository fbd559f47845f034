"""Media columns: progressive JPEG files in a binary column, and their tensors.

``to_media`` makes each text the coefficients of a progressive JPEG file (see
``jpeg``), ``stored`` writes these files as a table; ``from_media`` reads such
a column back: it accumulates the scans into coefficient arrays, recovers the
payload from them, transforms them to samples, repeats the chroma samples and
gives full-resolution RGB tensors, a column of the result.

Defined results. Null or empty text: 64 bytes 0. Any length is stored whole
(a file holds up to 6 GB). Repeated rows each get a row, equal texts equal
files. A null media value gives nulls; a file that is not progressive JPEG
raises. Extra columns are ignored. A null doc_id is carried through.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import jpeg
from .base import binary, columns_as, cut

#: Bytes of media in one Arrow batch.
BATCH_BYTES = 8_000_000

_MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])


def _in_batches(rows: Iterator[tuple], schema: pa.Schema, size_of) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += size_of(row)
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each text, padded with bytes 0 to whole blocks, as a progressive JPEG file."""

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (
            (doc_id, len(text or b""), jpeg.encode(jpeg.padded(text or b"")))
            for batch in batches
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), binary(batch.column("text")), strict=True)
        )
        yield from _in_batches(rows, _MEDIA, lambda r: len(r[2]))

    return columns_as(docs, doc_id="bigint", text="string").mapInArrow(rows_of, "doc_id long, n_bytes long, media binary")


def stored(docs: DataFrame) -> DataFrame:
    """The rows of ``to_media`` as a table in the shared folder (compressed: the codes of bytes that repeat do too)."""
    return cut(to_media(docs), "media", "zstd")


def feature(rgb: np.ndarray) -> str:
    """Size, mean of each channel in thousandths, and a checksum of the tensor."""
    flat = rgb.reshape(-1, 3)
    means = flat.sum(axis=0, dtype=np.int64) * 1000 // len(flat)
    return f"{rgb.shape[0]}x{rgb.shape[1]} rgb {means[0]} {means[1]} {means[2]} crc {zlib.crc32(rgb.tobytes()):08x}"


def from_media(media: DataFrame, with_tensor: bool = True) -> DataFrame:
    """doc_id, n_bytes, the payload's and the file's digests, a feature, and the tensor (height, width, rgb bytes)."""
    fields = [
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
        ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("height", pa.int32()), ("width", pa.int32()),
    ]
    schema = pa.schema(fields + [("rgb", pa.binary())] * with_tensor)

    def digest(doc_id: int, n_bytes: int, data: bytes | None) -> tuple:
        if data is None:
            return (doc_id, n_bytes, *[None] * (len(schema) - 2))
        image = jpeg.decode(data)
        payload, rgb = image.payload(), image.rgb()
        out = (doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(rgb), rgb.shape[0], rgb.shape[1])
        return (*out, rgb.tobytes()) if with_tensor else out

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (digest(*row) for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True))
        yield from _in_batches(rows, schema, lambda r: 400 + (len(r[-1] or b"") if with_tensor else 0))

    kinds = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, height int, width int"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(rows_of, kinds + ", rgb binary" * with_tensor)
