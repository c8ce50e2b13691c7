"""WAV data and back: PCM of 16, 24 and 32 bits and float. ``ranged`` reads files by byte ranges."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scaled(body: bytes, code: int, bits: int) -> np.ndarray:
    """Samples in [-1, 1] of the data of a format."""
    if code == 3:
        return np.frombuffer(body, "<f4" if bits == 32 else "<f8").astype(np.float32)
    if code == 1 and bits == 16:
        return np.frombuffer(body, "<i2").astype(np.float32) / 32768
    if code == 1 and bits == 32:
        return (np.frombuffer(body, "<i4") / 2**31).astype(np.float32)
    if code == 1 and bits == 24:
        raw = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int32)
        v = raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16
        return (np.where(v >= 1 << 23, v - (1 << 24), v) / 2**23).astype(np.float32)
    raise ValueError(f"format {code} of {bits} bits is not supported")


def parse(data: bytes) -> tuple[int, int, np.ndarray]:
    """Sample rate, channels and frames x channels samples in [-1, 1]."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, form = 12, None
    while at + 8 <= len(data):
        kind, (size,) = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"fmt ":
            form = struct.unpack("<HHIIHH", body[:16])
            if form[0] == 0xFFFE and len(body) >= 26:
                form = (struct.unpack("<H", body[24:26])[0], *form[1:])
        elif kind == b"data":
            if form is None:
                raise ValueError("data before fmt")
            code, channels, rate, _, _, bits = form
            whole = len(body) - len(body) % (channels * bits // 8)
            x = scaled(body[:whole], code, bits)
            return rate, channels, x.reshape(-1, channels)
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def encode(samples: np.ndarray, rate: int, float32: bool = False) -> bytes:
    """A WAV file of (frames, channels) samples: 16 bits (clamped, scaled by 32767, truncated) or 32-bit float."""
    x = np.atleast_2d(np.asarray(samples, np.float32))
    x = x if x.shape[0] != 1 or np.ndim(samples) == 2 else x.T
    body = x.astype("<f4").tobytes() if float32 else np.trunc(np.clip(x, -1, 1) * 32767).astype("<i2").tobytes()
    width, channels = (4 if float32 else 2), x.shape[1]
    form = struct.pack("<HHIIHH", 3 if float32 else 1, channels, rate, rate * channels * width, channels * width, 8 * width)
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<I", 16) + form + b"data" + struct.pack("<I", len(body)) + body


def fold_to_stereo(x: np.ndarray) -> np.ndarray:
    """One channel is doubled; of more than two the even ones give left, the odd ones right, as means."""
    if x.shape[1] == 1:
        return np.repeat(x, 2, axis=1)
    return x if x.shape[1] == 2 else np.stack([x[:, ::2].mean(1), x[:, 1::2].mean(1)], axis=1)


def to_wav(tracks: DataFrame, rate: int, float32: bool = False) -> DataFrame:
    """(track_id, content BINARY) of (track_id, samples): a file per row, for a binary sink."""

    def run(batches):
        for b in batches:
            files = [encode(np.asarray(x, np.float32)[:, None], rate, float32) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(files, pa.binary())], ["track_id", "content"])

    return tracks.select(F.col("track_id").cast("bigint"), "samples").mapInArrow(run, "track_id bigint, content binary")
