"""Note-probability frames to note events: masks, islands, merging, onsets, transposition, combination of stems.

Frames are long (track_id, frame, pitch, prob) or wide (track_id, frame, probs). A pitch's frames are dense; a missing frame
ends a run. Null probabilities count as silence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def threshold(probs: Column, t: float) -> Column:
    """p >= t for each element."""
    return F.transform(probs, lambda p: F.coalesce(p >= t, F.lit(False)))


def active_notes(probs: Column, t: float) -> Column:
    """(idx, conf) of the elements with p >= t."""
    pairs = F.transform(probs, lambda p, i: F.struct(i.alias("idx"), p.alias("conf")))
    return F.filter(pairs, lambda x: x["conf"] >= t)


def top_k_floor(probs: Column, k: int = 12) -> Column:
    """The k-th largest value; null with fewer."""
    return F.try_element_at(F.sort_array(probs, asc=False), F.lit(k))


def argmax_pitch(probs: Column, gate: float = 0.28, lowest: int = 21) -> Column:
    """The first largest element's pitch, null unless its probability is over the gate."""
    top = F.array_max(probs)
    return F.when(top > gate, (F.array_position(probs, top) - 1 + lowest).cast("int"))


def runs(active: DataFrame, keys: list[str], frame: str = "frame") -> DataFrame:
    """Maximal runs of consecutive frames: keys, first and last frame, and all other columns' rows through run_id."""
    w = Window.partitionBy(*keys).orderBy(frame)
    return active.withColumn("run_id", F.col(frame) - F.row_number().over(w))


def note_islands(frames: DataFrame, t: float, step: float, keys: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """One note per maximal run of a pitch at or over t; ids run over pitch, then start."""
    cols = [*keys, "pitch"]
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), "prob"))
    on = frames.withColumn("prob", clamped).where(F.col("prob") >= t)
    islands = runs(on, cols).groupBy(*cols, "run_id").agg(F.min("frame").alias("f0"), (F.max("frame") + 1).alias("f1"), F.max("prob").alias("peak"))
    return islands.select(
        *keys, F.row_number().over(Window.partitionBy(*keys).orderBy("pitch", "f0")).cast("int").alias("id"), "pitch",
        (F.col("f0") * F.lit(step)).alias("start_time"), (F.col("f1") * F.lit(step)).alias("end_time"),
        F.greatest(F.lit(1), F.least(F.lit(127), F.round(F.col("peak") * 127).cast("int"))).alias("velocity"),
    )


def merge_adjacent(notes: DataFrame, gap: float, keys: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """Notes of one pitch that begin less than gap after everything before them ended become one."""
    w = Window.partitionBy(*keys, "pitch").orderBy("start_time", "id")
    before = F.max("end_time").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col("start_time") - before >= gap), 1).otherwise(0)
    grouped = notes.withColumn("fresh", fresh).withColumn("grp", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, "pitch", "grp").agg(F.min_by("id", F.struct("start_time", "id")).alias("id"), F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.max("velocity").alias("velocity")).select(*keys, "id", "pitch", "start_time", "end_time", "velocity")


def extract_notes(frames: DataFrame, t: float = 0.12, step: float = 0.05, min_frames: int = 2, keys: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """Islands, merged over gaps under two frames (30 ms at least), at least two frames (50 ms) long."""
    merged = merge_adjacent(note_islands(frames, t, step, keys), max(2 * step, 0.03), keys)
    return merged.where(F.col("end_time") - F.col("start_time") >= max(min_frames * step, 0.05))


def sensitivity_threshold(sensitivity: float, base: float = 0.12) -> float:
    return min(0.95, max(0.05, base / max(sensitivity, 0.05)))


def lookahead_vote(frames: DataFrame, ahead: int = 5, share: float = 0.6) -> DataFrame:
    """On where the probabilities of this frame and the next ones sum to more than share of their number."""
    w = Window.partitionBy("track_id", "pitch").orderBy("frame").rowsBetween(0, ahead)
    return frames.withColumn("active", F.sum("prob").over(w) > F.count("prob").over(w) * F.lit(share))


def min_duration(active: DataFrame, least: int = 2) -> DataFrame:
    """Rows of runs of at least so many frames. active: (track_id, pitch, frame) of the frames that are on."""
    keyed = runs(active, ["track_id", "pitch"])
    return keyed.withColumn("n", F.count("*").over(Window.partitionBy("track_id", "pitch", "run_id"))).where(F.col("n") >= least).drop("n", "run_id")


def onsets(active: DataFrame) -> DataFrame:
    """Rising edges of (track_id, pitch, frame, active); frame 0 counts if it is on."""
    w = Window.partitionBy("track_id", "pitch").orderBy("frame")
    return active.withColumn("before", F.lag("active", 1, False).over(w)).where("active and not before").select("track_id", "pitch", "frame")


def offsets(active: DataFrame) -> DataFrame:
    """Falling edges; the end of the data is none."""
    w = Window.partitionBy("track_id", "pitch").orderBy("frame")
    return active.withColumn("before", F.lag("active", 1, False).over(w)).where("not active and before").select("track_id", "pitch", "frame")


def transpose(probs: Column, semitones: float) -> Column:
    """Element i is read at i - semitones, linearly between neighbours; 0 outside [0, n - 1)."""
    if semitones == 0:
        return probs
    n = F.size(probs)

    def at(_, i):
        src = i - F.lit(float(semitones))
        low = F.floor(src).cast("int")
        part = src - low
        a, b = F.try_element_at(probs, low + 1), F.try_element_at(probs, low + 2)
        return F.when((src >= 0) & (src < n - 1), a * (1 - part) + b * part).otherwise(F.lit(0.0))

    return F.transform(probs, at)


def nearest_frame(t: Column, step: float, n: Column) -> Column:
    return F.least(F.floor(t / F.lit(step) + F.lit(0.5)), n - 1).cast("int")


def combine_stems(frames: DataFrame) -> DataFrame:
    """The largest probability over stems for each frame and pitch, and the first stem that has it.

    frames: (song, stem_idx, frame, pitch, prob)"""
    best = F.max(F.struct("prob", (-F.col("stem_idx")).alias("m"))).alias("best")
    return frames.groupBy("song", "frame", "pitch").agg(best).select("song", "frame", "pitch", F.col("best.prob").alias("prob"), (-F.col("best.m")).alias("stem_idx"))


def union_stems(frames: DataFrame, t: float, step: float) -> DataFrame:
    """Notes of all stems of a song: extracted by stem, ids running on over the stems, ordered by start and pitch."""
    notes = extract_notes(frames, t, step, keys=("song", "stem_idx"))
    w = Window.partitionBy("song").orderBy("stem_idx", "id")
    return notes.withColumn("id", F.row_number().over(w).cast("int"))


def highlight_decay(frames: DataFrame, dt: float, tau: float = 0.05, hold: float = 0.0) -> DataFrame:
    """Exponential smoothing of each pitch's probability: level += alpha * (prob - level), one pass by pitch.

    With hold a level stays at its peak for so many seconds before it falls."""
    import math

    import pandas as pd

    alpha = min(1.0, max(0.02, 1 - math.exp(-dt / tau)))
    held = round(hold / dt)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("frame")
        level, left, out = 0.0, 0, []
        for p in rows["prob"].tolist():
            if p >= level:
                left = held
            elif left > 0:
                left -= 1
                out.append(level)
                continue
            level += alpha * (p - level)
            out.append(level)
        return rows[["track_id", "pitch", "frame"]].assign(level=out)

    return frames.groupBy("track_id", "pitch").applyInPandas(fold, "track_id bigint, pitch int, frame int, level double")
