"""Channels and stems: stereo at another rate, stereo blends, what is heard and what is analysed, spectra's peaks and floors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timejoin import asof_fill, by_sort, spread_out

# Weights of the five bins around a peak.
PEAK_WEIGHTS = (0.15, 0.6, 1.0, 0.6, 0.15)


def stereo_frames(frames: DataFrame) -> DataFrame:
    """(track_id, i, l, r) of frames (track_id, i, samples by channel): one channel is doubled, of more than two the even ones give
    left and the odd ones right, as means."""
    pick = lambda odd: F.filter("samples", lambda _, k: k % 2 == odd)
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(xs), F.lit(1))
    return frames.select("track_id", "i", mean(pick(0)).alias("l"), F.when(F.size("samples") > 1, mean(pick(1))).otherwise(F.col("samples")[0]).alias("r"))


def stereo_at_rate(frames: DataFrame, rate: int, wanted: int = 44_100, bucket: int = 65_536) -> DataFrame:
    """Stereo frames at another rate by linear interpolation between neighbours; the last frame stands for what follows it.

    Each output frame meets the two input frames it lies between by their number, so no track is one group."""
    stereo = stereo_frames(frames)
    if rate == wanted:
        return stereo
    ratio = wanted / rate
    size = stereo.groupBy("track_id").agg((F.max("i") + 1).alias("n"))
    count = F.round(F.col("n") * ratio).cast("bigint")
    starts = size.select("track_id", "n", count.alias("out"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0).cast("bigint"), count - 1), F.lit(bucket).cast("bigint"))).alias("a"))
    out = spread_out(starts.where("out > 0")).select("track_id", "n", F.explode(F.sequence(F.col("a"), F.least(F.col("a") + bucket, F.col("out")) - 1)).alias("k"))
    placed = out.withColumn("at", F.col("k") / ratio).withColumn("i0", F.floor("at")).withColumn("frac", F.col("at") - F.col("i0")).withColumn("i1", F.least(F.col("i0") + 1, F.col("n") - 1))
    ends = placed.select("track_id", "k", F.explode(F.array(F.struct(F.col("i0").alias("i"), (1 - F.col("frac")).alias("w")), F.struct(F.col("i1").alias("i"), F.col("frac").alias("w")))).alias("e")).select("track_id", "k", "e.i", "e.w")
    return ends.join(by_sort(stereo), ["track_id", "i"]).groupBy("track_id", "k").agg(F.sum(F.col("w") * F.col("l")).alias("l"), F.sum(F.col("w") * F.col("r")).alias("r")).withColumnRenamed("k", "i")


def blend_channels(stems: DataFrame) -> DataFrame:
    """(song, i, channel, x): the stems' sum by frame and channel, over the peak where that is above 1.

    stems: (song, stem_idx, i, channel, x). Stems of fewer channels than the song's most give every channel the mean of their own."""
    width = stems.groupBy("song", "stem_idx").agg((F.max("channel") + 1).alias("own"))
    most = width.groupBy("song").agg(F.max("own").alias("most"))
    rows = stems.join(width, ["song", "stem_idx"]).join(most, "song")
    same = rows.where("own = most").select("song", "i", "channel", "x")
    mono = rows.where("own < most").groupBy("song", "stem_idx", "i", "most").agg(F.avg("x").alias("x"))
    spread = mono.select("song", "i", F.explode(F.sequence(F.lit(0), F.col("most") - 1)).alias("channel"), "x")
    total = same.unionByName(spread).groupBy("song", "i", "channel").agg(F.sum("x").alias("x"))
    peak = total.groupBy("song").agg(F.max(F.abs("x")).alias("peak"))
    return total.join(peak, "song").select("song", "i", "channel", F.when(F.col("peak") > 1, F.col("x") / F.col("peak")).otherwise(F.col("x")).alias("x"))


def analysis_mix(stems: DataFrame, enabled: DataFrame) -> DataFrame:
    """(song, i, x) of what is analysed: the enabled stems but drums, blended; silence of the longest stem's length without any.

    stems: (song, stem_idx, stem, i, x); enabled: (song, stem_idx)."""
    heard = stems.where(F.lower("stem") != "drums").join(enabled, ["song", "stem_idx"], "left_semi")
    total = heard.groupBy("song", "i").agg(F.sum("x").alias("x"))
    n = heard.select("song", "stem_idx").distinct().groupBy("song").agg(F.count("*").alias("n"))
    peak = total.groupBy("song").agg(F.max(F.abs("x")).alias("peak")).join(n, "song")
    mixed = total.join(peak, "song").select("song", "i", F.when((F.col("n") > 1) & (F.col("peak") > 1), F.col("x") / F.col("peak")).otherwise(F.col("x")).alias("x"))
    silent = stems.join(n.select("song"), "song", "left_anti").select("song", "i").distinct().withColumn("x", F.lit(0.0))
    return mixed.unionByName(silent)


def restored_stems(saved: DataFrame, stems: DataFrame) -> DataFrame:
    """(song, stem_idx): the saved choice where every index is one of the song's, else all stems that are on by default.

    saved: (song, stems ARRAY); stems: (song, stem_idx, on)."""
    have = stems.groupBy("song").agg(F.collect_list("stem_idx").alias("every"), F.filter(F.collect_list(F.when(F.col("on"), F.col("stem_idx"))), lambda x: x.isNotNull()).alias("defaults"))
    rows = have.join(saved, "song", "left")
    usable = F.col("stems").isNotNull() & (F.size("stems") > 0) & F.forall("stems", lambda s: F.array_contains("every", s))
    return rows.select("song", F.explode(F.array_sort(F.array_distinct(F.when(usable, F.col("stems")).otherwise(F.col("defaults"))))).alias("stem_idx"))


def output_seconds(t: Column, speed: Column) -> Column:
    """Source seconds in the played output, whose speed lies within 0.25 and 4."""
    return t / F.greatest(F.lit(0.25), F.least(F.lit(4.0), speed))


def frame_step(duration: Column, frames: Column) -> Column:
    """Seconds of a frame: the track's over its frames, a millisecond at least."""
    return F.greatest(F.lit(0.001), duration / frames)


def current_frame(frames: DataFrame, points: DataFrame, step: float) -> DataFrame:
    """(point columns, frame, probs) of the frame a time lies in, cut off and not rounded, the last at most.

    frames: (track_id, frame, probs); points: (track_id, t)."""
    last = frames.groupBy("track_id").agg(F.max("frame").alias("last"))
    at = F.least(F.col("last"), F.floor(F.greatest(F.lit(0.0), "t") / step).cast("int"))
    return points.join(last, "track_id").withColumn("frame", at).drop("last").join(frames.select("track_id", "frame", "probs"), ["track_id", "frame"])


def point_probabilities(frames: DataFrame, points: DataFrame, step: float) -> DataFrame:
    """(track_id, t, pitch_idx, prob): the mean of the three frames around a time; zeros where a track has none there.

    frames: (track_id, frame, probs)."""
    around = points.withColumn("centre", F.floor(F.col("t") / step).cast("int")).withColumn("frame", F.explode(F.sequence(F.col("centre") - 1, F.col("centre") + 1)))
    hit = around.join(frames.select("track_id", "frame", F.posexplode("probs").alias("pitch_idx", "p")), ["track_id", "frame"])
    found = hit.groupBy("track_id", "t", "pitch_idx").agg(F.avg("p").alias("prob"))
    width = frames.agg(F.max(F.size("probs")).alias("w"))
    every = points.crossJoin(F.broadcast(width)).select("track_id", "t", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("pitch_idx"))  # one row is broadcast
    return every.join(found, ["track_id", "t", "pitch_idx"], "left").select("track_id", "t", "pitch_idx", F.coalesce("prob", F.lit(0.0)).alias("prob"))


def pitch_track(frames: DataFrame, gate: float = 0.28, lowest: int = 21) -> DataFrame:
    """(track_id, frame, pitch): the most probable pitch, the lowest of equals, or NaN at the gate or below."""
    top = F.array_max("probs")
    return frames.select("track_id", "frame", F.when(top > gate, (F.array_position("probs", top) - 1 + lowest).cast("double")).otherwise(F.lit(float("nan"))).alias("pitch"))


def weighted_peak(power: Column, k: Column) -> Column:
    """The weighted mean of the five bins around bin k, of those that exist."""
    near = [(k + d, w) for d, w in zip(range(-2, 3), PEAK_WEIGHTS, strict=True)]
    inside = lambda b: (b >= 0) & (b < F.size(power))
    total = sum((F.when(inside(b), F.try_element_at(power, F.when(inside(b), b + 1).otherwise(1)) * w).otherwise(0.0) for b, w in near), F.lit(0.0))
    weight = sum((F.when(inside(b), w).otherwise(0.0) for b, w in near), F.lit(0.0))
    return F.when(weight > 0, total / weight).otherwise(0.0)


def noise_floor(power: Column, k: Column) -> Column:
    """The mean of the bins three to seven away from bin k, of those that exist."""
    bins = F.filter(F.array(*(k + d for d in (*range(-7, -2), *range(3, 8)))), lambda b: (b >= 0) & (b < F.size(power)))
    values = F.transform(bins, lambda b: F.element_at(power, (b + 1).cast("int")))
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)).otherwise(0.0)


def at_beat(points: DataFrame, segments: DataFrame, signatures: DataFrame) -> DataFrame:
    """points with bpm, numerator and denominator: the tempo of the last segment whose first beat is at or before the beat (else the
    first), and the signature that holds it (else the last). points: (track_id, beat)."""
    tempo = asof_fill(points, segments, "beat", "beat_offset", ["bpm"])
    first = segments.groupBy("track_id").agg(F.min_by("bpm", "beat_offset").alias("first_bpm"))
    meter = asof_fill(tempo.join(first, "track_id", "left"), signatures.withColumn("until", F.col("end_beat")), "beat", "start_beat", ["numerator", "denominator", "until"])
    last = signatures.groupBy("track_id").agg(F.max_by(F.struct("numerator", "denominator"), "start_beat").alias("last"))
    rows = meter.join(last, "track_id", "left")
    inside = F.col("beat") < F.col("until")
    pick = lambda c: F.when(inside, F.col(c)).otherwise(F.col(f"last.{c}")).alias(c)
    return rows.select(*points.columns, F.coalesce("bpm", "first_bpm").alias("bpm"), pick("numerator"), pick("denominator"))


