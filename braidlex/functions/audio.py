"""PCM and WAV bytes in numpy, for use in Arrow batches."""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def decode(pcm: bytes, width: int) -> np.ndarray:
    """Signed integers from little-endian samples of 1 (unsigned), 2, 3 or 4 bytes."""
    if width == 1:
        return np.frombuffer(pcm, np.uint8).astype(np.int64) - 128
    if width in (2, 4):
        return np.frombuffer(pcm[: len(pcm) // width * width], f"<i{width}").astype(np.int64)
    if width == 3:
        raw = np.frombuffer(pcm[: len(pcm) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int64)
        value = raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16
        return np.where(value >= 1 << 23, value - (1 << 24), value)
    raise ValueError(f"unsupported sample width: {width} bytes")


def to_mono(samples: np.ndarray, channels: int) -> np.ndarray:
    """Two channels are averaged (rounded down); of more, the first is taken."""
    if channels == 1:
        return samples
    frames = samples[: len(samples) // channels * channels].reshape(-1, channels)
    return frames.sum(axis=1) // 2 if channels == 2 else frames[:, 0]


def to_16_bit(samples: np.ndarray, width: int) -> np.ndarray:
    scaled = {1: lambda s: s * 256, 2: lambda s: s, 3: lambda s: s >> 8, 4: lambda s: s >> 16}[width](samples)
    return np.clip(scaled, -32768, 32767)


def resample(samples: np.ndarray, source: int, target: int) -> np.ndarray:
    """Linear interpolation, rounded half to even, clamped."""
    if source == target or not len(samples):
        return samples
    ratio = source / target
    place = np.arange(int(len(samples) / ratio)) * ratio
    low = place.astype(np.int64)
    part = place - low
    value = np.where(low + 1 < len(samples), samples[low] * (1 - part) + samples[np.minimum(low + 1, len(samples) - 1)] * part, samples[np.minimum(low, len(samples) - 1)])
    return np.clip(np.rint(value).astype(np.int64), -32768, 32767)


def read_wav(data: bytes) -> tuple[np.ndarray, int]:
    """Mono 16-bit samples and the rate of a WAV file."""
    with wave.open(io.BytesIO(data)) as f:
        pcm = f.readframes(f.getnframes())
        return to_16_bit(to_mono(decode(pcm, f.getsampwidth()), f.getnchannels()), f.getsampwidth()), f.getframerate()


def write_wav(samples: np.ndarray, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(samples.astype("<i2").tobytes())
    return out.getvalue()


def silence(ms: int, rate: int) -> np.ndarray:
    return np.zeros(int(rate * ms / 1000), np.int64)


def assemble(turns: DataFrame, rate: int = 16000) -> DataFrame:
    """turns(conv_id, turn, wav, pause_ms) to one WAV file a dialogue (conv_id, wav, seconds, error).

    A missing turn drops the dialogue; sound that cannot be read or joined keeps
    it, with null audio and the error. A dialogue's turns are one group, a few
    minutes of sound.
    """
    kinds = pa.schema({"conv_id": pa.int64(), "wav": pa.binary(), "seconds": pa.float64(), "error": pa.string()})

    def joined(rows: list[dict]) -> np.ndarray:
        parts = []
        for i, r in enumerate(rows):
            samples, source = read_wav(r["wav"])
            parts.append(resample(samples, source, rate))
            if i < len(rows) - 1:
                parts.append(silence(r["pause_ms"] or 0, rate))
        return np.concatenate(parts)

    def of_group(table: pa.Table) -> pa.Table:
        rows = table.sort_by("turn").to_pylist()
        if any(r["wav"] is None for r in rows):
            return kinds.empty_table()
        row = {"conv_id": rows[0]["conv_id"], "wav": None, "seconds": None, "error": None}
        try:
            whole = joined(rows)
            row |= {"wav": write_wav(whole, rate), "seconds": round(len(whole) / rate, 3)}
        except (wave.Error, EOFError, ValueError) as failure:
            row["error"] = f"{type(failure).__name__}: {failure}"
        return pa.Table.from_pylist([row], kinds)

    return turns.select("conv_id", "turn", "wav", "pause_ms").groupBy("conv_id").applyInArrow(of_group, "conv_id long, wav binary, seconds double, error string")
