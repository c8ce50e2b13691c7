"""Spectral operators: windows, STFT, HPSS, constant-Q kernels, a deterministic note detector."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hann(n: int) -> np.ndarray:
    return np.ones(max(n, 0)) if n <= 1 else 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1))


def midi_to_hz(m: Column) -> Column:
    return F.lit(440.0) * F.pow(F.lit(2.0), (m - 69) / 12.0)


def db_scale(m: Column, ref: float = 1.0) -> Column:
    return F.when(m > 0, F.log10(m * m / ref) * 10).otherwise(-80.0)


def mel_pool(x: Column, groups: int) -> Column:
    """Means over len / groups neighbours, the remainder dropped; a copy where there are more groups than values."""
    width = F.floor(F.size(x) / groups).cast("int")
    mean = lambda g: F.aggregate(F.slice(x, g * width + 1, width), F.lit(0.0), lambda a, v: a + v) / width
    return F.when(F.size(x) < groups, x).otherwise(F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), mean))


def stft(blocks: DataFrame, fft: int = 64, hop: int = 32) -> DataFrame:
    """(track_id, frame, magnitudes) of frames that a track's blocks and their successors hold.

    blocks: (track_id, block_no, samples), each of a multiple of hop. A block makes the frames that begin in it; it needs the
    next samples only, so a track is never brought together."""
    from pyspark.sql import Window

    order = Window.partitionBy("track_id").orderBy("block_no")
    rows = blocks.withColumn("after", F.slice(F.lead("samples").over(order), 1, fft)).withColumn("size", F.size("samples"))
    rows = rows.withColumn("first", F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    window = hann(fft)

    def run(batches):
        for b in batches:
            out = []
            for track, samples, after, first in zip(b["track_id"], b["samples"], b["after"], b["first"], strict=True):
                x = np.concatenate([np.asarray(samples, float), np.asarray(after if after is not None else [], float)])
                for s in range(0, len(samples), hop):
                    if s + fft <= len(x):
                        out.append((track, (first + s) // hop, np.abs(np.fft.rfft(window * x[s : s + fft]))))
            yield pd.DataFrame(out, columns=["track_id", "frame", "magnitudes"])

    return rows.select("track_id", "samples", "after", "first").mapInPandas(run, "track_id bigint, frame bigint, magnitudes array<double>")


def median_filter(x: np.ndarray, size: int, axis: int) -> np.ndarray:
    """Centred, cut at the edges, upper middle."""
    x = np.moveaxis(x, axis, 0)
    half, n = size // 2, len(x)
    out = np.empty_like(x)
    for i in range(n):
        part = np.sort(x[max(0, i - half) : i + half + 1], axis=0)
        out[i] = part[len(part) // 2]
    return np.moveaxis(out, 0, axis)


def hpss_masks(magnitudes: np.ndarray, harmonic: tuple[int, int] = (31, 31), percussive: tuple[int, int] = (7, 31), margin: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Harmonic and percussive magnitudes of (frames, bins): time and frequency medians of the log, soft masks."""
    log = np.maximum(np.log(magnitudes + 1e-7), -80)
    h = median_filter(median_filter(log, harmonic[0], 0), harmonic[1], 1)
    p = median_filter(median_filter(log, percussive[0], 0), percussive[1], 1)
    eh, ep = np.exp(h * margin), np.exp(p * margin)
    total = eh + ep + 1e-10
    return magnitudes * eh / total, magnitudes * ep / total


def hpss(frames: DataFrame, block: int = 1024, harmonic: tuple[int, int] = (31, 31), percussive: tuple[int, int] = (7, 31)) -> DataFrame:
    """(track_id, frame, harmonic, percussive) from (track_id, frame, magnitudes), frames numbered without gaps.

    A track is cut into blocks; each also gets the frames at its borders that its medians over time reach (15 on either side), so
    a block is what the whole track gives there."""
    halo = max(harmonic[0], percussive[0]) // 2
    near = F.sequence(F.floor((F.col("frame") - halo) / block).cast("long"), F.floor((F.col("frame") + halo) / block).cast("long"))
    dealt = frames.select("track_id", F.col("frame").cast("long").alias("frame"), "magnitudes", F.explode(near).alias("block"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("frame")
        own = (rows["frame"] // block == rows["block"].iloc[0]).to_numpy()
        if not own.any():  # a block of borders alone
            return rows[["track_id", "frame"]].iloc[:0].assign(harmonic=pd.Series(dtype=object), percussive=pd.Series(dtype=object))
        h, p = hpss_masks(np.stack(rows["magnitudes"].to_list()), harmonic, percussive)
        return pd.DataFrame({"track_id": rows["track_id"][own], "frame": rows["frame"][own], "harmonic": list(h[own]), "percussive": list(p[own])})

    return dealt.groupBy("track_id", "block").applyInPandas(run, "track_id bigint, frame bigint, harmonic array<double>, percussive array<double>")


def in_tiles(blocks: DataFrame, tile: int, before: int, after: int):
    """blocks (track_id, start_frame, samples) beside each tile that needs them: tile t is places t * tile on, and reaches before and
    after its own places. A block lies in few tiles, whatever its length."""
    end = F.col("start_frame") + F.size("samples")
    first = F.greatest(F.lit(0).cast("long"), F.floor((F.col("start_frame") - after) / tile).cast("long"))
    last = F.floor((end - 1 + before) / tile).cast("long")
    return blocks.where(F.size("samples") > 0).select("track_id", F.col("start_frame").cast("long").alias("start_frame"), "samples", F.explode(F.sequence(first, F.greatest(first, last))).alias("tile"))


def laid(rows: pd.DataFrame, low: int, high: int) -> tuple[np.ndarray, int]:
    """Places low to high - 1 of what blocks hold, zeros where there is none, and where the last block ends."""
    out, end = np.zeros(high - low), low
    for start, samples in zip(rows["start_frame"], rows["samples"], strict=True):
        a, b = max(int(start), low), min(int(start) + len(samples), high)
        if a < b:
            out[a - low : b - low] = np.asarray(samples, float)[a - int(start) : b - int(start)]
        end = max(end, b)
    return out, end


def cqt_all(blocks: DataFrame, rate: float, low: float = 27.5, high: float = 4186.0, hop: int = 1, tile: int = 16_384) -> DataFrame:
    """(track_id, frame, magnitudes): the correlation of a track with each kernel at every hop-th sample from which the longest
    kernel fits; a track shorter than that has no rows. blocks: (track_id, start_frame, samples), without gaps.

    Overlap-save: a tile and what the longest kernel reaches behind it are transformed once and multiplied with the kernels'
    spectra; what would wrap around is not used. Tiles are groups of their own."""
    longest = max(map(len, cqt_kernels(rate, low, high)), default=0)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        begin = int(rows["tile"].iloc[0]) * tile
        x, end = laid(rows, begin, begin + tile + longest - 1)
        places = np.arange(-(-begin // hop) * hop, min(begin + tile, end - longest + 1), hop)
        size = 1 << (tile + longest - 2).bit_length()
        kernels = _spectra(rate, low, high, size)
        found = np.abs(np.fft.ifft(np.fft.fft(x, size) * kernels, axis=1))[:, places - begin] if len(places) else np.zeros((len(kernels), 0))
        return pd.DataFrame({"track_id": np.full(len(places), rows["track_id"].iloc[0]), "frame": places // hop, "magnitudes": pd.Series(list(found.T), dtype=object)})

    dealt = in_tiles(blocks, tile, 0, tile + longest - 2)
    return dealt.groupBy("track_id", "tile").applyInPandas(run, "track_id bigint, frame bigint, magnitudes array<double>")


@lru_cache(maxsize=2)
def _spectra(rate: float, low: float, high: float, size: int) -> np.ndarray:
    """The spectra that correlate with the kernels: of each kernel, conjugated and turned around zero."""
    out = np.zeros((len(kernels := cqt_kernels(rate, low, high)), size), complex)
    for k, kernel in enumerate(kernels):
        out[k, : len(kernel)] = kernel
    return np.conj(np.fft.fft(out, axis=1))


def cqt_decibels(frames: DataFrame, ref: float = 1.0) -> DataFrame:
    """Constant-Q frames as decibels."""
    return frames.withColumn("magnitudes", F.transform("magnitudes", lambda m: db_scale(m, ref)))


def cqt_kernels(rate: float, low: float = 27.5, high: float = 4186.0, per_semitone: int = 1, most: int | None = None) -> list[np.ndarray]:
    """Complex kernels of ceil(log2(high / low) * 12 * per) bins, Gaussian over three periods, in unit length."""
    bins = int(np.ceil(np.log2(high / low) * 12 * per_semitone))
    out = []
    for k in range(bins):
        f = low * 2 ** (k / (12 * per_semitone))
        n = int(np.ceil(3 * rate / f))
        t = (np.arange(n) - (n - 1) / 2) / rate
        x = np.exp(-2 * np.pi * (f / 20) * t**2) * np.exp(2j * np.pi * f * t)
        out.append(x / (np.sqrt((np.abs(x) ** 2).sum()) + 1e-7))
        if most and len(out) == most:
            break
    return out


def cqt_frames(blocks: DataFrame, rate: float, low: float = 27.5, high: float = 4186.0) -> DataFrame:
    """(track_id, block_no, magnitudes): each block against each kernel that fits it, other bins 0."""

    def run(batches):
        kernels = cqt_kernels(rate, low, high)
        for b in batches:
            width = max((len(x) for x in b["samples"]), default=0)
            matrix = np.zeros((len(kernels), width), complex)
            for i, k in enumerate(kernels):
                if len(k) <= width:
                    matrix[i, : len(k)] = np.conj(k)
            rows = [np.abs(matrix[:, : len(x)] @ np.asarray(x, float)) for x in b["samples"]]
            yield pd.DataFrame({"track_id": b["track_id"], "block_no": b["block_no"], "magnitudes": rows})

    return blocks.select("track_id", "block_no", "samples").mapInPandas(run, "track_id bigint, block_no int, magnitudes array<double>")


def note_strengths(energy: np.ndarray) -> np.ndarray:
    """Note probabilities from constant-Q magnitudes by key: a flat spectrum gives none, peaks stand out, shoulders shrink."""
    e = np.asarray(energy, float)
    if not len(e) or e.max() <= 0:
        return np.zeros(len(e))
    flat = np.exp(np.mean(np.log(e + 1e-12))) / (e.mean() + 1e-12)
    tonal = max(0.0, 1 - flat) ** 1.2
    if tonal < 0.08:
        return np.zeros(len(e))
    x = (e / e.max()) ** 1.25
    floor = 0.78 * np.sort(x)[::-1][min(11, len(x) - 1)]
    x = np.clip((x - floor) / max(1e-9, 1 - floor), 0, 1) ** 1.7 * tonal
    x[x < 0.08] = 0
    neighbour = np.maximum(np.append(x[1:], 0), np.append(0, x[:-1]))
    x = np.where(x < 0.92 * neighbour, 0.45 * x, x)
    return x / x.max() if x.max() > 0 else x


def detect_notes(cqt: DataFrame) -> DataFrame:
    """(track_id, frame, probs) of 88 keys from constant-Q frames."""

    def run(batches):
        for b in batches:
            rows = []
            for m in b["magnitudes"]:
                p = note_strengths(np.asarray(m, float))[:88]
                rows.append(np.concatenate([p, np.zeros(88 - len(p))]))
            yield pd.DataFrame({"track_id": b["track_id"], "frame": b["block_no"], "probs": rows})

    return cqt.mapInPandas(run, "track_id bigint, frame int, probs array<double>")
