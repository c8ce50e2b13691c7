"""Sample-level operators: long rows (track_id, i, x) for relational work, blocks of samples where a kernel needs arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def track():
    """Rows of a track; made when used, as Python workers import this module without a session."""
    return Window.partitionBy("track_id")


def pad_or_trim(x: Column, n: int) -> Column:
    """Exactly n elements, zeros to the right."""
    return F.slice(F.concat(x, F.array_repeat(F.lit(0.0), n)), 1, n)


def resampled(x: np.ndarray, src: float, dst: float) -> np.ndarray:
    """Linear interpolation upwards; the mean of ceil(1 / r) samples around each point downwards."""
    if not len(x) or src <= 0 or dst <= 0:
        return np.zeros(0)
    if src == dst:
        return x.copy()
    r = dst / src
    n = max(1, int(np.floor(len(x) * r + 0.5)))
    at = np.arange(n) / r
    low = np.minimum(at.astype(np.int64), len(x) - 1)
    if r >= 1:
        high = np.minimum(low + 1, len(x) - 1)
        return x[low] + (x[high] - x[low]) * (at - low)
    width = int(np.ceil(1 / r))
    total = np.concatenate([[0.0], np.cumsum(x)])
    start = np.clip(low - width // 2, 0, len(x))
    stop = np.clip(start + width, 0, len(x))
    return (total[stop] - total[start]) / np.maximum(stop - start, 1)


def resample(blocks: DataFrame, src: int, dst: int, margin: int = 64) -> DataFrame:
    """(track_id, i, x) at the new rate, without bringing a track together.

    Each block (track_id, block_no, samples of one length) is resampled with margin samples of both neighbours and keeps the
    output points that fall into it."""
    order = track().orderBy("block_no")
    rows = blocks.withColumn("left", F.slice(F.lag("samples").over(order), -margin, margin)).withColumn("right", F.slice(F.lead("samples").over(order), 1, margin))
    width = F.size("samples")
    rows = rows.withColumn("first", F.coalesce(F.sum(width).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum(width).over(track()))
    r = dst / src

    def run(batches):
        for b in batches:
            out = []
            for track, samples, left, right, first, n in zip(b["track_id"], b["samples"], b["left"], b["right"], b["first"], b["n"], strict=True):
                left = np.asarray(left if left is not None else [], float)
                x = np.concatenate([left, np.asarray(samples, float), np.asarray(right if right is not None else [], float)])
                base = first - len(left)
                total = max(1, int(np.floor(n * r + 0.5)))
                lo, hi = int(np.ceil(first * r - 1e-9)), min(total, int(np.ceil((first + len(samples)) * r - 1e-9)))
                at = np.arange(lo, hi) / r
                low = np.minimum(at.astype(np.int64), n - 1)
                if r >= 1:
                    high = np.minimum(low + 1, n - 1)
                    y = x[low - base] + (x[high - base] - x[low - base]) * (at - low)
                else:
                    k = int(np.ceil(1 / r))
                    start = np.clip(low - k // 2, 0, n)
                    stop = np.clip(start + k, 0, n)
                    cum = np.concatenate([[0.0], np.cumsum(x)])
                    y = (cum[np.clip(stop - base, 0, len(x))] - cum[np.clip(start - base, 0, len(x))]) / np.maximum(stop - start, 1)
                out.append(pd.DataFrame({"track_id": track, "i": np.arange(lo, hi), "x": y}))
            if out:
                yield pd.concat(out)

    if src == dst:
        return rows.select("track_id", "first", F.posexplode("samples").alias("pos", "x")).select("track_id", (F.col("first") + F.col("pos")).alias("i"), "x")
    return rows.select("track_id", "samples", "left", "right", "first", "n").mapInPandas(run, "track_id bigint, i bigint, x double")


def waveform(signal: DataFrame, rate: int, points: int) -> DataFrame:
    """Every step-th sample, step = n // points: (track_id, t, amp)."""
    n = F.count("*").over(track())
    step = F.greatest(F.lit(1), F.floor(n / points).cast("bigint"))
    return signal.withColumn("step", step).where(F.col("i") % F.col("step") == 0).select("track_id", "i", (F.col("i") / F.lit(float(rate))).alias("t"), F.col("x").alias("amp"))


def waveform_peak_norm(signal: DataFrame, rate: int, points: int, speed: float = 1.0) -> DataFrame:
    """The waveform with times scaled by the clamped speed and amplitudes over their peak."""
    s = min(4.0, max(0.25, speed))
    peak = F.max(F.abs("amp")).over(track())
    w = waveform(signal, rate, points).withColumn("peak", peak)
    return w.select("track_id", "i", (F.col("t") * s).alias("t"), F.when(F.col("peak") > 0, F.col("amp") / F.col("peak")).otherwise(0.0).alias("amp"))


def adaptive_budget(budget: Column, seconds: Column) -> Column:
    return F.when(seconds > 1800, F.least(budget, F.lit(3000))).when(seconds > 300, F.floor(budget / 2).cast("int")).otherwise(budget)


def stem_blend(stems: DataFrame) -> DataFrame:
    """The sum of a song's stems by sample, over the peak where that is above 1. stems: (song, stem_idx, i, x)."""
    total = stems.groupBy("song", "i").agg(F.sum("x").alias("x"))
    peak = total.groupBy("song").agg(F.max(F.abs("x")).alias("peak"))
    return total.join(peak, "song").select("song", "i", F.when(F.col("peak") > 1, F.col("x") / F.col("peak")).otherwise(F.col("x")).alias("x"))


def rms(signal: DataFrame, key: str = "track_id") -> DataFrame:
    return signal.groupBy(key).agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"))


def soft_limit(x: Column, theta: float = 0.9) -> Column:
    return F.when(F.abs(x) > theta, F.signum(x) * (theta + (1 - theta) * F.tanh((F.abs(x) - theta) / (1 - theta)))).otherwise(x)


def loudness_match(mix: DataFrame, source: DataFrame) -> DataFrame:
    """mix with the source's loudness: gain in [0.25, 32], left alone within 2 % or near silence; soft limited over peak 1."""
    facts = mix.groupBy("track_id").agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("m"), F.max(F.abs("x")).alias("peak")).join(rms(source).withColumnRenamed("rms", "s"), "track_id")
    gain = F.greatest(F.lit(0.25), F.least(F.lit(32.0), F.col("s") / F.col("m")))
    skip = (F.col("m") < 1e-6) | (F.col("s") < 1e-6)
    facts = facts.withColumn("gain", F.when(skip, 1.0).otherwise(F.when(F.abs(gain - 1) < 0.02, 1.0).otherwise(gain)))
    y = F.col("x") * F.col("gain")
    return mix.join(facts, "track_id").select("track_id", "i", F.when(F.col("peak") * F.col("gain") > 1, soft_limit(y)).otherwise(y).alias("x"))


def edge_fades(signal: DataFrame, rate: int, seconds: float = 0.005) -> DataFrame:
    """Linear fades at both ends of each track."""
    n, k = F.count("*").over(track()), max(1, int(rate * seconds))
    return signal.withColumn("n", n).select("track_id", "i", (F.col("x") * F.least(F.lit(1.0), F.col("i") / k, (F.col("n") - 1 - F.col("i")) / k)).alias("x"))


def stem_energy_share(stems: DataFrame) -> DataFrame:
    """Each stem's share of its song's mean-square energy."""
    e = stems.groupBy("song", "stem_idx").agg(F.avg(F.col("x") * F.col("x")).alias("e"))
    return e.select("song", "stem_idx", (F.col("e") / F.sum("e").over(Window.partitionBy("song"))).alias("confidence"))


def zero_crossing_variance(signal: DataFrame, window: int = 1024, hop: int = 512) -> DataFrame:
    """Variance of the change in crossings between windows, over 100 and clamped; 0.5 for less than a window.

    A sample belongs to window / hop windows; crossings are counted by hop and summed over neighbouring hops."""
    crossed = F.when(F.signum("x") * F.signum(F.lag("x").over(track().orderBy("i"))) < 0, 1).otherwise(0)
    by_hop = signal.withColumn("crossed", crossed).groupBy("track_id", F.floor(F.col("i") / hop).alias("h")).agg(F.sum("crossed").alias("c"), F.count("*").alias("n"))
    w = track().orderBy("h")
    wins = by_hop.withColumn("total", F.sum("c").over(w.rowsBetween(0, window // hop - 1))).withColumn("held", F.sum("n").over(w.rowsBetween(0, window // hop - 1))).where(F.col("held") == window)
    diffs = wins.withColumn("d", F.abs(F.col("total") - F.lag("total").over(w)))
    tracks = signal.select("track_id").distinct()
    var = diffs.groupBy("track_id").agg(F.var_pop("d").alias("v"))
    return tracks.join(var, "track_id", "left").select("track_id", F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("v") / 100)), F.lit(0.5)).alias("variance"))


def moving_median(signal: DataFrame, half: int) -> DataFrame:
    """Centred median, window cut at the edges, upper middle of an even number."""
    w = track().orderBy("i").rowsBetween(-half, half)
    ordered = F.array_sort(F.collect_list("x").over(w))
    return signal.withColumn("xs", ordered).select("track_id", "i", F.element_at("xs", (F.floor(F.size("xs") / 2) + 1).cast("int")).alias("x"))


def min_max_normalize(signal: DataFrame) -> DataFrame:
    """To [0, 1] over the track; unchanged where the range is under 1e-7."""
    ends = signal.groupBy("track_id").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    span = F.col("hi") - F.col("lo")
    return signal.join(ends, "track_id").select("track_id", "i", F.when(span < 1e-7, F.col("x")).otherwise((F.col("x") - F.col("lo")) / span).alias("x"))


def overlap_add(chunks: DataFrame, stride: int) -> DataFrame:
    """Weighted overlap-add: sum of w * x over sum of w for each position, 0 where no weight is.

    chunks: (track_id, chunk_no, pos, w, x), chunk_no * stride + pos being the place."""
    at = F.col("chunk_no") * stride + F.col("pos")
    sums = chunks.groupBy("track_id", at.alias("i")).agg(F.sum(F.col("w") * F.col("x")).alias("wx"), F.sum("w").alias("w"))
    return sums.select("track_id", "i", F.when(F.col("w") <= 1e-8, 0.0).otherwise(F.col("wx") / F.col("w")).alias("x"))


def triangle_weight(pos: Column, n: int) -> Column:
    """Symmetric triangle with peak 1."""
    half = (n + 1) // 2
    up, down = (pos + 1) / half, (F.lit(n) - pos) / half
    return F.least(up, down)


def cut_chunks(signal: DataFrame, size: int, stride: int) -> DataFrame:
    """Overlapping chunks of size samples, every stride, weighted by a triangle; a sample is laid into each that holds it."""
    last = F.floor(F.col("i") / stride)
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - size + 1) / stride))
    rows = signal.select("track_id", "i", "x", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))).alias("chunk_no"))
    pos = F.col("i") - F.col("chunk_no") * stride
    return rows.select("track_id", "chunk_no", pos.alias("pos"), triangle_weight(pos, size).alias("w"), "x")


def stretch(signal_arrays: DataFrame, speed: float, semitones: float = 0.0, frame: int = 1024) -> DataFrame:
    """Time stretch by a phase vocoder, pitch by resampling after it: (track_id, samples) to max(1, round(n / speed)) samples.

    Identity within 1e-4. One group per track: the phase runs through it."""
    speed = min(4.0, max(0.25, speed))
    if abs(speed - 1) < 1e-4 and abs(semitones) < 1e-4:
        return signal_arrays
    factor = 2 ** (semitones / 12)

    def one(x: np.ndarray) -> np.ndarray:
        n = max(1, int(np.floor(len(x) / speed + 0.5)))
        rate, hop = speed / factor, frame // 4
        window = np.hanning(frame)
        padded = np.concatenate([np.zeros(frame // 2), x, np.zeros(frame + frame // 2)])
        steps = np.arange(0, max(1.0, len(x)), hop * rate)
        phase, out, last = None, np.zeros(len(steps) * hop + 2 * frame), None
        norm = np.zeros_like(out)
        expected = 2 * np.pi * hop * np.arange(frame // 2 + 1) / frame
        for k, s in enumerate(steps.astype(int)):
            spectrum = np.fft.rfft(window * padded[s : s + frame])
            ahead = np.fft.rfft(window * padded[s + hop : s + hop + frame]) if s + hop + frame <= len(padded) else spectrum
            if phase is None:
                phase = np.angle(spectrum)
            else:
                turn = np.angle(last[1]) - np.angle(last[0]) - expected
                phase = phase + expected + turn - 2 * np.pi * np.round(turn / (2 * np.pi))
            last = (spectrum, ahead)
            y = window * np.fft.irfft(np.abs(spectrum) * np.exp(1j * phase), frame)
            out[k * hop : k * hop + frame] += y
            norm[k * hop : k * hop + frame] += window**2
        out = (out / np.maximum(norm, 1e-6))[frame // 2 :]
        if abs(factor - 1) > 1e-9:
            out = resampled(out, factor, 1.0)
        return np.concatenate([out, np.zeros(max(0, n - len(out)))])[:n]

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"track_id": b["track_id"], "samples": [one(np.asarray(x, float)) for x in b["samples"]]})

    return signal_arrays.select("track_id", "samples").mapInPandas(run, "track_id bigint, samples array<double>")
