"""Smaller operators around a score and a session: lookups at a time, cursor offset, clefs, settings, model and stem choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timejoin import beat_to_time, interval_join

MARKER = "struct<time: double, desc: string>"
STATE = f"struct<volume: double, speed: double, markers: map<string, array<{MARKER}>>, positions: map<string, double>>"


def note_at(points: DataFrame, notes: DataFrame, at: str = "t", bucket: float = 2.0) -> DataFrame:
    """For each point the sounding note that began first (the lower id of equals)."""
    hits = interval_join(points, notes.select("track_id", "id", "pitch", "start_time", "end_time"), at, "start_time", "end_time", bucket)
    best = hits.groupBy(*points.columns).agg(F.min(F.struct("start_time", "id", "pitch")).alias("n"))
    return best.select(*points.columns, F.col("n.id").alias("id"), F.col("n.pitch").alias("pitch"))


def cursor_offset(quantised: DataFrame, segments: DataFrame, events: DataFrame, most: float = 2.0, least: int = 4) -> DataFrame:
    """The median of start minus the quantised start's time on the tempo map, over notes at most 2 s apart; 0 under four of them."""
    placed = beat_to_time(quantised.select("track_id", "id", F.col("beat_start").alias("beat")), segments)
    apart = F.greatest(F.lit(0.0), F.col("start_time")) - F.col("t")
    joined = placed.join(events.select("track_id", "id", "start_time"), ["track_id", "id"]).withColumn("d", F.when(F.abs(apart) <= most, apart))
    found = joined.groupBy("track_id").agg(F.median("d").alias("offset"), F.count("d").alias("n"))
    return found.select("track_id", F.when(F.col("n") >= least, F.col("offset")).otherwise(0.0).alias("offset"), "n")


def mean_tempo(segments: DataFrame) -> DataFrame:
    """Tempo weighted by duration."""
    d = F.col("end_time_sec") - F.col("start_time_sec")
    return segments.groupBy("track_id").agg((F.sum(F.col("bpm") * d) / F.sum(d)).alias("bpm"))


def clefs(pieces: DataFrame, below: float = 46.0) -> DataFrame:
    """Clef of each measure and staff by mean pitch."""
    m = pieces.groupBy("track_id", "measure", "staff").agg(F.avg("pitch").alias("mean_pitch"))
    return m.withColumn("clef", F.when(F.col("mean_pitch") < below, "F").otherwise("G"))


def clefs_of_all(bars: DataFrame, pieces: DataFrame, below: float = 46.0) -> DataFrame:
    """(track_id, measure, clef, new_clef) of one staff: an empty measure repeats the clef before it, a track begins with G without
    notes; new where it differs from the measure before. bars: (track_id, measure)."""
    own = clefs(pieces.withColumn("staff", F.lit(1)), below).select("track_id", "measure", "clef")
    w = Window.partitionBy("track_id").orderBy("measure")
    rows = bars.select("track_id", "measure").join(own, ["track_id", "measure"], "left")
    held = rows.withColumn("clef", F.coalesce(F.last("clef", ignorenulls=True).over(w), F.lit("G")))
    return held.withColumn("new_clef", F.coalesce(F.lag("clef").over(w) != F.col("clef"), F.lit(False)))


def chord_debug(candidates: DataFrame) -> DataFrame:
    """One JSON text per track: the candidates of each half bar in order."""
    entry = F.struct("half", "found_at", "n_pcs", "symbol")
    return candidates.groupBy("track_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(entry)).alias("candidates"))).alias("json"), F.count("*").alias("n"))


def energy_notes(signal: DataFrame, beat_samples: int, rate: float, gate: float = 0.05, least_sec: float = 0.05) -> DataFrame:
    """Notes where the RMS of half-beat windows, a quarter beat apart, is over the gate; pitch 60, velocity from the loudest.

    Energy is summed by quarter beat and windows are two neighbours, so no sample is copied."""
    hop = max(1, beat_samples // 4)
    w = Window.partitionBy("track_id").orderBy("h")
    parts = signal.groupBy("track_id", F.floor(F.col("i") / hop).alias("h")).agg(F.sum(F.col("x") * F.col("x")).alias("e"), F.count("*").alias("n"))
    wins = parts.withColumn("rms", F.sqrt(F.sum("e").over(w.rowsBetween(0, 1)) / F.sum("n").over(w.rowsBetween(0, 1)))).where(F.round("rms", 9) > gate)
    runs = wins.withColumn("run", F.col("h") - F.row_number().over(w)).groupBy("track_id", "run").agg(F.min("h").alias("a"), (F.max("h") + 1).alias("z"), F.max("rms").alias("peak"))
    start, end = F.col("a") * F.lit(hop / rate), F.col("z") * F.lit(hop / rate)
    return runs.select("track_id", F.lit(60).alias("pitch"), start.alias("start_time"), end.alias("end_time"), F.greatest(F.lit(1), F.least(F.lit(127), F.round(F.col("peak") * 127).cast("int"))).alias("velocity")).where(F.col("end_time") - F.col("start_time") > least_sec)


def melodic_stem(stems: DataFrame) -> DataFrame:
    """The melodic stem (any, if none is) of best mean of variance and energy times confidence; the first of equals.

    stems: (song, stem_idx, melodic, variance, energy, confidence)."""
    any_melodic = F.max("melodic").over(Window.partitionBy("song"))
    pool = stems.withColumn("any", any_melodic).where(F.col("melodic") | ~F.col("any"))
    score = (F.col("variance") + F.col("energy")) / 2 * F.greatest("confidence", F.lit(0.1))
    return pool.groupBy("song").agg(F.max(F.struct(F.round(score, 9).alias("score"), (-F.col("stem_idx")).alias("s"))).alias("b")).select("song", (-F.col("b.s")).cast("int").alias("stem_idx"), F.col("b.score").alias("score"))


def choose_model(files: DataFrame, wanted: str | None = None) -> DataFrame:
    """The separation model of a listing (dir_rank, name): named, else htdemucs_6s, else half precision, else any demucs, else first.

    Of equal names the first folder's counts; pitch and beat models are left out."""
    low = F.lower("name")
    usable = files.where(low.endswith(".onnx") & ~F.contains(low, F.lit("pitch")) & ~F.contains(low, F.lit("beat")) & F.rlike(low, F.lit("demucs|inst|separat|stem")))
    once = usable.groupBy("name").agg(F.min("dir_rank").alias("dir_rank"))
    stem = F.regexp_replace(low, r"\.onnx$", "")
    rank = F.when(stem == F.lit((wanted or "").lower()), 0).when(stem == "htdemucs_6s", 1).when(F.contains(stem, F.lit("fp16")), 2).when(F.contains(stem, F.lit("demucs")), 3).otherwise(4)
    return once.agg(F.min_by(F.struct("name", "dir_rank"), F.struct(rank.alias("r"), "dir_rank", "name")).alias("m")).select("m.name", "m.dir_rank")


def first_nonblank(values: Column) -> Column:
    """The first value of an array that is not blank."""
    return F.try_element_at(F.filter(values, lambda v: v.isNotNull() & (F.trim(v) != "")), F.lit(1))


def parse_state(text: Column) -> Column:
    """Persisted settings; markers of the old form, bare times, are not objects and come back as null entries."""
    return F.from_json(text, STATE)


def add_marker(markers: Column, time: Column, desc: Column) -> Column:
    """The markers with one more, ordered by time."""
    return F.array_sort(F.concat(F.coalesce(markers, F.array().cast(f"array<{MARKER}>")), F.array(F.struct(time.cast("double").alias("time"), desc.alias("desc")))))


def recent(list_: Column, item: Column, most: int = 10) -> Column:
    """The item in front of the list, once, most entries at most."""
    return F.slice(F.concat(F.array(item), F.array_remove(list_, item)), 1, most)
