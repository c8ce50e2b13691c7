"""Beats, downbeats, bars and tempo: intervals, grids, tempo maps, repair, consensus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timejoin import by_sort, interval_join, spread_out, within_tolerance

def track():
    """Rows of a track; made when used, as Python workers import this module without a session."""
    return Window.partitionBy("track_id")


def upper_median(values: Column) -> Column:
    """sorted[n / 2]: of an even number the upper middle."""
    ordered = F.array_sort(F.collect_list(values))
    return F.element_at(ordered, (F.floor(F.size(ordered) / 2) + 1).cast("int"))


def chain_kept(values: list[float], tolerance: float) -> list[float]:
    """Of sorted values those that lie more than tolerance after the last one kept."""
    kept: list[float] = []
    for x in values:
        if not kept or x - kept[-1] > tolerance:
            kept.append(x)
    return kept


def chain_dedup(rows: DataFrame, column: str, tolerance: float, name: str) -> DataFrame:
    """(track_id, name): each track's sorted values, each more than tolerance after the last one kept: a fold, so one pass by track."""
    import pandas as pd

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"track_id": part["track_id"].iloc[:1], name: [chain_kept(sorted(part[column].tolist()), tolerance)]})

    return rows.select("track_id", column).groupBy("track_id").applyInPandas(fold, f"track_id bigint, {name} array<double>")


def beat_intervals(beats: DataFrame) -> DataFrame:
    """track_id, beat_idx, gap to the next beat."""
    gap = F.lead("t").over(track().orderBy("beat_idx")) - F.col("t")
    return beats.withColumn("gap", gap).where("gap is not null").select("track_id", "beat_idx", "gap")


def bar_counts(beats: DataFrame, downbeats: DataFrame, slack: float = 0.001) -> DataFrame:
    """Beats in each bar (downbeat to downbeat, slack seconds early) and their median interval."""
    bars = downbeats.withColumn("next_t", F.lead("t").over(track().orderBy("db_idx"))).where("next_t is not null").select("track_id", "db_idx", F.col("t").alias("bar_t"), "next_t")
    gaps = beats.withColumn("gap", F.lead("t").over(track().orderBy("beat_idx")) - F.col("t"))
    early = bars.withColumn("bar_s", F.col("bar_t") - slack).withColumn("bar_e", F.col("next_t") - slack)
    joined = interval_join(gaps.select("track_id", "t", "gap"), early, "t", "bar_s", "bar_e", 2.0)
    return joined.groupBy("track_id", "db_idx", "bar_t", "next_t").agg(F.count("*").alias("n_beats"), F.median("gap").alias("bar_gap"))


def beats_per_bar(beats: DataFrame, downbeats: DataFrame) -> DataFrame:
    """The upper median of beats between downbeats; 4 without any."""
    tracks = beats.select("track_id").distinct()
    found = bar_counts(beats, downbeats).groupBy("track_id").agg(upper_median(F.col("n_beats")).alias("bpb"))
    return tracks.join(found, "track_id", "left").select("track_id", F.coalesce(F.col("bpb"), F.lit(4)).cast("int").alias("beats_per_bar"))


def bar_tempo_map(beats: DataFrame, downbeats: DataFrame, bpb: int = 4) -> DataFrame:
    """A tempo segment per bar: its median beat (the track's where the bar has none), beats counted from the first."""
    whole = beat_intervals(beats).groupBy("track_id").agg(F.median("gap").alias("track_gap"), F.count("*").alias("n")).where("n >= 3")
    bars = bar_counts(beats, downbeats).join(whole, "track_id")
    gap = F.coalesce("bar_gap", "track_gap")
    order = track().orderBy("db_idx")
    return bars.select(
        "track_id", (F.row_number().over(order) - 1).cast("int").alias("seg_no"), F.col("bar_t").alias("start_time_sec"), F.col("next_t").alias("end_time_sec"),
        (F.lit(60.0) / gap).alias("bpm"), gap.alias("beat_duration_sec"), ((F.row_number().over(order) - 1) * F.lit(float(bpb))).alias("beat_offset"),
    )


def tempo_map_from_beats(beats: DataFrame) -> DataFrame:
    """Up to three segments for each track: before the first beat (negative offset), the beats, one beat after the last."""
    gaps = beat_intervals(beats).where("gap > 0.001").groupBy("track_id").agg(F.median("gap").alias("m"), F.avg("gap").alias("mean"), F.stddev_pop("gap").alias("sd"))
    ends = beats.groupBy("track_id").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("n"))
    base = ends.join(gaps, "track_id").where("n >= 2").select(
        "track_id", "first", "last", "n", F.greatest(F.lit(40.0), F.least(F.lit(260.0), F.lit(60.0) / F.col("m"))).alias("bpm"),
        F.greatest(F.lit(0.1), F.least(F.lit(0.99), F.lit(1.0) - F.col("sd") / F.col("mean"))).alias("confidence"),
    ).withColumn("beat", F.lit(60.0) / F.col("bpm"))
    seg = lambda no, start, end, offset: F.struct(F.lit(no).alias("seg_no"), start.alias("start_time_sec"), end.alias("end_time_sec"), offset.alias("beat_offset"))
    first, last, beat = F.col("first"), F.col("last"), F.col("beat")
    rows = base.withColumn("s", F.explode(F.array(
        seg(0, F.lit(0.0), first, -first / beat), seg(1, first, last, F.lit(0.0)), seg(2, last, last + beat, (F.col("n") - 1).cast("double")),
    ))).where("s.end_time_sec > s.start_time_sec")
    return rows.select("track_id", "s.seg_no", "s.start_time_sec", "s.end_time_sec", "bpm", F.col("beat").alias("beat_duration_sec"), "s.beat_offset", "confidence")


def grid_from_bpm(tracks: DataFrame, bpb: int = 4, least_sec: float = 10.0, tail_sec: float = 2.0) -> DataFrame:
    """Beats at i * 60 / bpm up to max(duration, least) + tail, each bpb-th a downbeat. tracks: (track_id, bpm, duration)."""
    beat = F.lit(60.0) / F.greatest(F.lit(30.0), F.least(F.lit(400.0), "bpm"))
    n = F.floor((F.greatest(F.lit(least_sec), "duration") + tail_sec) / beat).cast("int")
    i = F.col("beat_idx")
    return spread_out(tracks).select("track_id", beat.alias("beat"), F.explode(F.sequence(F.lit(0), n)).alias("beat_idx")).select("track_id", "beat_idx", (i * F.col("beat")).alias("t"), (i % bpb == 0).alias("downbeat"))


def grid_from_notes(notes: DataFrame, bpm: DataFrame) -> DataFrame:
    """Beats from the first note's beat to one past the last; none with fewer than four beats."""
    ends = notes.groupBy("track_id").agg(F.min("start_time").alias("first"), F.max("end_time").alias("last")).join(bpm, "track_id").withColumn("beat", F.lit(60.0) / F.col("bpm"))
    start = F.floor(F.col("first") / F.col("beat")) * F.col("beat")
    n = F.floor((F.col("last") + F.col("beat") - start) / F.col("beat")).cast("int") + 1
    rows = ends.withColumn("start", start).withColumn("n", n).where((F.col("n") >= 4) & (F.col("last") > 0))
    return spread_out(rows).select("track_id", "start", "beat", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("beat_idx")).select("track_id", "beat_idx", (F.col("start") + F.col("beat_idx") * F.col("beat")).alias("t"))


def double_beats(beats: DataFrame, keys: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """The beats and the midpoints between neighbours, numbered anew."""
    w = Window.partitionBy(*keys)
    mid = beats.withColumn("t", (F.col("t") + F.lead("t").over(w.orderBy("beat_idx"))) / 2).where("t is not null")
    return beats.select(*keys, "t").unionByName(mid.select(*keys, "t")).select(*keys, (F.row_number().over(w.orderBy("t")) - 1).cast("int").alias("beat_idx"), "t")


def halve_beats(beats: DataFrame, keys: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """Every second beat, from the first."""
    return beats.where("beat_idx % 2 = 0").select(*keys, F.floor(F.col("beat_idx") / 2).cast("int").alias("beat_idx"), "t")


def downbeat_consensus(primary: DataFrame, sources: DataFrame, tolerance: float = 0.070) -> DataFrame:
    """For each primary downbeat how many sources (track_id, source, t) have one within the tolerance."""
    near = sources.withColumn("b", F.explode(F.array(*(F.floor(F.col("t") / tolerance) + d for d in (-1, 0, 1))))).select("track_id", "source", F.col("t").alias("other"), "b")
    dealt = primary.withColumn("b", F.floor(F.col("t") / tolerance))
    hits = dealt.join(by_sort(near), ["track_id", "b"], "left").withColumn("hit", F.when(F.abs(F.col("t") - F.col("other")) < tolerance, F.col("source")))
    return hits.groupBy("track_id", "db_idx", "t").agg(F.count_distinct("hit").alias("hits"))


def fill_downbeat_gaps(downbeats: DataFrame, beat_sec: float, bpb: int = 4) -> DataFrame:
    """Downbeats, with evenly spaced ones inside gaps of more than one and a half bars; one at 0 if the first is late."""
    bar = beat_sec * bpb
    w = track().orderBy("t")
    gap = F.lead("t").over(w) - F.col("t")
    extra = F.when(gap > 1.5 * bar, F.round(gap / bar) - 1).otherwise(0).cast("int")
    rows = downbeats.select("track_id", "t", gap.alias("gap"), extra.alias("extra"), F.row_number().over(w).alias("rn"))
    filled = rows.select("track_id", F.explode(F.sequence(F.lit(0), F.col("extra"))).alias("k"), "t", "gap", "extra").select("track_id", (F.col("t") + F.when(F.col("k") > 0, F.col("k") * F.col("gap") / (F.col("extra") + 1)).otherwise(0.0)).alias("t"), (F.col("k") > 0).alias("added"))
    head = rows.where((F.col("rn") == 1) & (F.col("t") > bar / 2)).select("track_id", F.lit(0.0).alias("t"), F.lit(True).alias("added"))
    return filled.unionByName(head)


def missing_beats(downbeats: DataFrame, beats: DataFrame, beat_sec: float, share: float = 0.3) -> DataFrame:
    """Downbeats without a beat within share of a beat: they become beats."""
    return within_tolerance(downbeats, beats, "t", "t", share * beat_sec, exists=False)


def barlines(signatures: DataFrame, until: float, tail: float = 4.0) -> DataFrame:
    """Barline beats of signatures (track_id, start_beat, end_beat, numerator, denominator); every tail beats after the last."""
    width = F.col("numerator") * 4.0 / F.col("denominator")
    n = F.ceil((F.least("end_beat", F.lit(until)) - F.col("start_beat")) / width - 1e-9).cast("int")
    inside = signatures.withColumn("width", width).withColumn("n", n).where("n > 0").select("track_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"), "start_beat", "width").select("track_id", (F.col("start_beat") + F.col("k") * F.col("width")).alias("beat"))
    last = signatures.groupBy("track_id").agg(F.max("end_beat").alias("end_beat")).where(F.col("end_beat") < until)
    after = last.select("track_id", "end_beat", F.explode(F.sequence(F.lit(0), F.floor((F.lit(until) - F.col("end_beat")) / tail).cast("int"))).alias("k")).select("track_id", (F.col("end_beat") + F.col("k") * tail).alias("beat"))
    return inside.unionByName(after).distinct()
