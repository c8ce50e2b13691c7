"""Model providers with deterministic stand-ins, and the window pipeline around a note model.

The stand-ins are no trained models: NoteModel is the constant-Q detector, StemModel the harmonic / percussive masks. A provider
is any picklable object with predict(); each Python worker loads it once."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spectral import cqt_kernels, hann, hpss_masks, note_strengths

WINDOW, FRAMES, KEYS = 43_844, 172, 88


class NoteModel(Protocol):
    def predict(self, window: np.ndarray) -> np.ndarray:
        """frames x 88 probabilities of a window of samples."""


class DetectorNoteModel:
    """Constant-Q note detector on frames equal parts of the window."""

    def __init__(self, rate: float, frames: int = FRAMES):
        self.rate, self.frames = rate, frames

    def predict(self, window: np.ndarray) -> np.ndarray:
        parts = np.array_split(window, self.frames)
        kernels = [k for k in cqt_kernels(self.rate, high=min(4186.0, self.rate / 2.1))]
        out = np.zeros((self.frames, KEYS))
        for t, x in enumerate(parts):
            energy = np.array([abs(np.vdot(k, x[: len(k)])) if len(k) <= len(x) else 0.0 for k in kernels])
            p = note_strengths(energy)[:KEYS]
            out[t, : len(p)] = p
        return np.clip(out, 0, 1)


def note_pipeline(tracks: DataFrame, model: NoteModel, window: int = WINDOW, frames: int = FRAMES) -> DataFrame:
    """(track_id, frame, probs): half-overlapping windows; the first keeps all frames, later ones skip the first half.

    tracks: (track_id, block_no, samples) with blocks of half a window, so that a window is a block and its successor."""
    order = Window.partitionBy("track_id").orderBy("block_no")
    wins = tracks.withColumn("after", F.lead("samples").over(order))

    def run(batches):
        for b in batches:
            rows = []
            for track, no, samples, after in zip(b["track_id"], b["block_no"], b["samples"], b["after"], strict=True):
                x = np.concatenate([np.asarray(samples, float), np.asarray(after if after is not None else [], float)])[:window]
                probs = model.predict(np.concatenate([x, np.zeros(window - len(x))]))
                skip = frames // 2 if no else 0
                rows += [(track, int(no) * (frames // 2) + i, probs[i]) for i in range(skip, frames)]
            yield pd.DataFrame(rows, columns=["track_id", "frame", "probs"])

    return wins.select("track_id", "block_no", "samples", "after").mapInPandas(run, "track_id bigint, frame int, probs array<double>")


class MaskStemModel:
    """Harmonic part as 'other', percussive part as 'drums', silence for the rest; the parts sum to the input."""

    def predict(self, x: np.ndarray, fft: int = 64) -> dict[str, np.ndarray]:
        hop, window = fft // 2, hann(fft)
        padded = np.concatenate([np.zeros(fft), x, np.zeros(2 * fft)])
        starts = range(0, len(padded) - fft + 1, hop)
        spectra = np.array([np.fft.rfft(window * padded[s : s + fft]) for s in starts])
        h, p = hpss_masks(np.abs(spectra), (31, 31), (7, 31))
        share = h / np.maximum(h + p, 1e-12)
        harmonic, norm = np.zeros(len(padded)), np.zeros(len(padded))
        for s, row in zip(starts, spectra * share, strict=True):
            harmonic[s : s + fft] += np.fft.irfft(row, fft) * window
            norm[s : s + fft] += window**2
        y = (harmonic / np.maximum(norm, 1e-8))[fft : fft + len(x)]
        return {"drums": x - y, "bass": np.zeros(len(x)), "other": y, "vocals": np.zeros(len(x)), "guitar": np.zeros(len(x)), "piano": np.zeros(len(x))}


class MaskStereoModel:
    """MaskStemModel on both channels: (2, n) samples to (6, 2, n)."""

    stems = ("drums", "bass", "other", "vocals", "guitar", "piano")

    def infer(self, x: np.ndarray) -> np.ndarray:
        parts = [MaskStemModel().predict(c) for c in x]
        return np.stack([np.stack([p[name] for p in parts]) for name in self.stems])


class IdentityStereoModel:
    """Gives back what it hears, once for each of its stems: what the plan around a model must not change."""

    def __init__(self, stems: tuple[str, ...] = ("drums", "bass", "other", "vocals", "guitar", "piano")):
        self.stems = stems

    def infer(self, x: np.ndarray) -> np.ndarray:
        return np.stack([x] * len(self.stems))


# Samples of a model's segment, and the share of it from one segment to the next.
SEGMENT, STRIDE = 343_980, 0.75


def triangle(n: int) -> np.ndarray:
    """Rising over the first half, falling over the rest, 1 at its peak."""
    half = n // 2
    w = np.concatenate([np.arange(1, half + 1), np.arange(n - half, 0, -1)]).astype(float)
    return w / max(w.max(initial=0.0), 1e-8)


def level_of(blocks: DataFrame) -> DataFrame:
    """(track_id, frames, mean, deviation) of the mean of both channels over whole tracks of stereo blocks.

    A block gives its count, mean and sum of squares about its own mean; blocks meet as those numbers alone."""

    def run(batches):
        for b in batches:
            out = []
            for track, samples in zip(b["track_id"], b["samples"], strict=True):
                mid = np.asarray(samples, float).reshape(-1, 2).mean(1)
                if len(mid):
                    out.append((track, len(mid), mid.mean(), ((mid - mid.mean()) ** 2).sum()))
            yield pd.DataFrame(out, columns=["track_id", "n", "m", "s"])

    parts = blocks.select("track_id", "samples").mapInPandas(run, "track_id bigint, n bigint, m double, s double")
    means = parts.groupBy("track_id").agg(F.sum("n").alias("frames"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"))
    spread = F.col("s") + F.col("n") * (F.col("m") - F.col("mean")) ** 2
    return parts.join(means, "track_id").groupBy("track_id", "frames", "mean").agg(F.sqrt(F.sum(spread) / F.col("frames")).alias("deviation"))


def separate(blocks: DataFrame, model=None, segment: int = SEGMENT, stride: int | None = None) -> DataFrame:
    """(track_id, stem, start_frame, samples, mono): the stems of stereo tracks, in stretches of stride frames.

    blocks: (track_id, start_frame, samples ARRAY interleaved left and right), of any lengths, without gaps. The track's mean is
    taken off and its deviation divided out, both over the whole track; segments of it, a stride apart and zeros behind its end, go
    through the model; the outputs are laid over each other by triangle weights, and deviation and mean restored. A segment is a
    group of its own, and so is each stem's stretch, of the two segments (or as many as overlap) that reach it.
    An empty track has no rows."""
    model, stride = model or MaskStereoModel(), stride or int(segment * STRIDE)
    size = F.floor(F.size("samples") / 2).cast("bigint")
    end = F.col("start_frame") + size
    first = F.greatest(F.lit(0).cast("bigint"), F.floor((F.col("start_frame") - segment) / stride).cast("bigint") + 1)
    level = level_of(blocks)
    pieces = blocks.where(size > 0).select("track_id", "start_frame", "samples", F.explode(F.sequence(first, F.floor((end - 1) / stride).cast("bigint"))).alias("chunk")).join(level, "track_id")
    weight = triangle(segment)

    def infer(rows: pd.DataFrame) -> pd.DataFrame:
        track, chunk, frames, mean, deviation = (rows[c].iloc[0] for c in ("track_id", "chunk", "frames", "mean", "deviation"))
        scale, offset = max(float(deviation), 1e-8), int(chunk) * stride
        x = np.zeros((segment, 2))
        for start, samples in zip(rows["start_frame"], rows["samples"], strict=True):
            y = np.asarray(samples, float).reshape(-1, 2)
            low, high = max(int(start), offset), min(int(start) + len(y), offset + segment)
            x[low - offset : high - offset] = (y[low - int(start) : high - int(start)] - mean) / scale
        held = min(segment, int(frames) - offset)
        heard = np.asarray(model.infer(x.T), float)
        out = []
        for tile in range(int(chunk), -(-(offset + held) // stride)):
            low, high = tile * stride - offset, min((tile + 1) * stride - offset, held)
            w = weight[low:high]
            out += [(track, stem, tile, (heard[n, :, low:high] * w).T.reshape(-1), w, mean, scale) for n, stem in enumerate(model.stems)]
        return pd.DataFrame(out, columns=["track_id", "stem", "tile", "weighted", "weights", "mean", "scale"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        n = max(map(len, rows["weights"]))
        total, weights = np.zeros((n, 2)), np.zeros(n)
        for y, w in zip(rows["weighted"], rows["weights"], strict=True):
            total[: len(w)] += np.asarray(y, float).reshape(-1, 2)
            weights[: len(w)] += w
        y = np.where(weights > 1e-8, 1 / np.maximum(weights, 1e-8), 0.0)[:, None] * total * rows["scale"].iloc[0] + rows["mean"].iloc[0]
        return pd.DataFrame({"track_id": rows["track_id"].iloc[:1], "stem": rows["stem"].iloc[:1], "start_frame": rows["tile"].iloc[:1] * stride, "samples": [y.reshape(-1)], "mono": [y.mean(1)]})

    laid = pieces.groupBy("track_id", "chunk").applyInPandas(infer, "track_id bigint, stem string, tile bigint, weighted array<double>, weights array<double>, mean double, scale double")
    return laid.groupBy("track_id", "stem", "tile").applyInPandas(add, "track_id bigint, stem string, start_frame bigint, samples array<double>, mono array<double>")
