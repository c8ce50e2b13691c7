"""Notes against beats: association, quantisation, swing, ties, grace notes, articulation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import meter_class
from .timejoin import asof_fill, by_sort, interval_join, time_to_beat

def track():
    """Rows of a track; made when used, as Python workers import this module without a session."""
    return Window.partitionBy("track_id")
# Default grids of starts and lengths, and what a compound meter has before them.
START_GRIDS = (1.0, 0.5, 0.25)
DURATIONS = (4.0, 3.0, 2.0, 1.5, 1.0, 0.75, 0.5, 0.25)

COMPOUND_STARTS, COMPOUND_DURATIONS = (1.0, 0.5, 1.0 / 3, 2.0 / 3), (1.5, 1.0, 0.5, 1.0 / 3)


def _nearest(value: Column, grids, margin: float) -> Column:
    """The grids' nearest points folded in order: a later one only if it is better by more than margin."""
    point = lambda g: F.round(value / g) * g
    points = F.array(*(F.struct(point(g).alias("p"), F.abs(value - point(g)).alias("e")) for g in grids))
    start = F.struct(F.lit(None).cast("double").alias("p"), F.lit(float("inf")).alias("e"))
    return F.aggregate(points, start, lambda best, x: F.when(x["e"] + margin < best["e"], x).otherwise(best))["p"]


def snap_start(value: Column, grids: tuple[float, ...] = START_GRIDS, margin: float = 0.03) -> Column:
    """The coarsest grid's nearest point; a finer grid's only if it is better by more than margin."""
    return _nearest(value, sorted(grids, reverse=True), margin)


def snap_duration(value: Column, candidates: tuple[float, ...] = DURATIONS, margin: float = 0.015, least: float = 0.25) -> Column:
    """The nearest multiple of a candidate, in the candidates' order; a later one only if better by more than margin."""
    return F.greatest(F.lit(least), F.coalesce(_nearest(value, candidates, margin), F.lit(least)))


def clean(notes: DataFrame) -> DataFrame:
    """Notes with finite times, start at 0 or later, end not before start."""
    ok = ~(F.isnan("start_time") | F.isnan("end_time")) & F.col("start_time").isNotNull() & F.col("end_time").isNotNull()
    start = F.greatest(F.lit(0.0), "start_time")
    return notes.where(ok).withColumn("start_time", start).withColumn("end_time", F.greatest("start_time", "end_time"))


def quantize_constant(notes: DataFrame, bpm: float) -> DataFrame:
    """Quantised notes at one tempo."""
    beat = 60.0 / bpm
    raw = clean(notes).withColumn("b0", F.col("start_time") / beat).withColumn("b1", F.col("end_time") / beat)
    return _quantised(raw)


def grids_of(compound: bool, starts: tuple[float, ...] = START_GRIDS, durations: tuple[float, ...] = DURATIONS) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """A meter's grids: a compound one's own, then those of the defaults that it lacks."""
    if not compound:
        return starts, durations
    return tuple(dict.fromkeys((*COMPOUND_STARTS, *starts))), tuple(dict.fromkeys((*COMPOUND_DURATIONS, *durations)))


def meter_at_beat(rows: DataFrame, signatures: DataFrame | None, at: str) -> DataFrame:
    """rows with meter: the class of the signature that holds the beat, or 4/4's where none does."""
    if signatures is None:
        return rows.withColumn("meter", F.lit("SimpleQuadruple"))
    marks = signatures.select("track_id", F.col("start_beat").alias("mark"), F.col("end_beat").alias("until"), meter_class(F.col("numerator"), F.col("denominator")).alias("kind"))
    found = asof_fill(rows, marks, at, "mark", ["until", "kind"])
    return found.withColumn("meter", F.when(F.col(at) < F.col("until"), F.col("kind")).otherwise("SimpleQuadruple")).drop("until", "kind")


def _by_meter(snap) -> Column:
    """snap(starts, durations) with the grids of the row's meter."""
    return F.when(F.col("meter").startswith("Compound"), snap(*grids_of(True))).otherwise(snap(*grids_of(False)))


def beat_ends(notes: DataFrame, segments: DataFrame, signatures: DataFrame | None) -> DataFrame:
    """Clean notes with b0 and b1, their ends in beats by the tempo map, and the meter where they begin."""
    begun = time_to_beat(clean(notes), segments, "start_time", "b0")
    return meter_at_beat(time_to_beat(begun, segments, "end_time", "b1"), signatures, "b0")


def quantize_tempo_map(notes: DataFrame, segments: DataFrame, signatures: DataFrame | None = None) -> DataFrame:
    """Quantised notes at the tempo of the segment in which each end lies, on the grids of the meter where they begin."""
    start = _by_meter(lambda starts, _: snap_start(F.col("b0"), starts))
    length = F.greatest(F.lit(0.25), F.col("b1") - F.col("b0"))
    return beat_ends(notes, segments, signatures).select("track_id", "id", "pitch", "velocity", start.alias("beat_start"), _by_meter(lambda _, durations: snap_duration(length, durations)).alias("beat_duration"))


def _quantised(raw: DataFrame) -> DataFrame:
    start = snap_start(F.col("b0"))
    return raw.select("track_id", "id", "pitch", "velocity", start.alias("beat_start"), snap_duration(F.greatest(F.lit(0.0), F.col("b1") - F.col("b0"))).alias("beat_duration"))


def barline_positions(signatures: DataFrame, most: float = 32768.0) -> DataFrame:
    """(track_id, beat): the barlines inside each signature's stretch, which ends where the next begins, or at its own end."""
    w = Window.partitionBy("track_id").orderBy("start_beat")
    end = F.least(F.max("end_beat").over(Window.partitionBy("track_id")), F.lit(most))
    bar = F.col("numerator") * 4.0 / F.col("denominator")
    rows = signatures.withColumn("until", F.coalesce(F.lead("start_beat").over(w), end)).withColumn("bar", bar).where("bar > 0 and until > start_beat + bar")
    k = F.explode(F.sequence(F.lit(1), F.ceil((F.col("until") - F.col("start_beat")) / F.col("bar")).cast("int")))
    return rows.withColumn("k", k).withColumn("beat", F.col("start_beat") + F.col("k") * F.col("bar")).where("beat < until").select("track_id", "beat").distinct()


def barline_crossings(quantised: DataFrame, barlines: DataFrame) -> DataFrame:
    """Barlines strictly inside a note: (track_id, id, beat). Beats are buckets of 4."""
    notes = quantised.select("track_id", "id", "beat_start", (F.col("beat_start") + F.col("beat_duration")).alias("beat_end"))
    return interval_join(barlines.select("track_id", "beat"), notes, "beat", "beat_start", "beat_end", 4.0).where("beat > beat_start").select("track_id", "id", "beat")


def tied_notes(notes: DataFrame, segments: DataFrame, signatures: DataFrame) -> DataFrame:
    """Notes with both ends on the start grid, cut at each barline strictly inside, every piece's length snapped.

    Tie flags: start on all pieces but the last, stop on all but the first."""
    snapped = beat_ends(notes, segments, signatures)
    for column in ("b0", "b1"):
        snapped = snapped.withColumn(f"s_{column}", _by_meter(lambda starts, _, c=column: snap_start(F.col(c), starts)))
    whole = snapped.select("track_id", "id", "pitch", "velocity", "meter", F.col("s_b0").alias("beat_start"), (F.col("s_b1") - F.col("s_b0")).alias("beat_duration"))
    cuts = barline_crossings(whole, barline_positions(signatures)).groupBy("track_id", "id").agg(F.array_sort(F.collect_set("beat")).alias("cuts"))
    rows = whole.join(cuts, ["track_id", "id"], "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<double>")))
    marks = rows.withColumn("marks", F.concat(F.array("beat_start"), F.col("cuts"), F.array(F.col("beat_start") + F.col("beat_duration"))))
    pieces = marks.select("track_id", "id", "pitch", "velocity", "meter", "marks", F.posexplode(F.slice("marks", F.lit(1), F.size("marks") - 1)).alias("seg_no", "piece_start"))
    n = F.size("marks") - 1
    length = F.greatest(F.lit(0.25), F.element_at("marks", F.col("seg_no") + 2) - F.col("piece_start"))
    return pieces.select(
        "track_id", "id", F.col("seg_no").cast("int").alias("seg_no"), "pitch", "velocity", F.col("piece_start").alias("beat_start"),
        _by_meter(lambda _, durations: snap_duration(length, durations)).alias("beat_duration"), (F.col("seg_no") < n - 1).alias("tie_start"), (F.col("seg_no") > 0).alias("tie_stop"),
    )


def associate(notes: DataFrame, beats: DataFrame, downbeats: DataFrame, bpb: int = 4) -> DataFrame:
    """Each note with its surrounding beats, beat and bar numbers and its position inside the beat.

    Before the first beat the first pair counts; from the last beat on the last beat and the gap before it. The last beat's
    own number is never given. A beat belongs to the last downbeat up to 1 ms after it."""
    order = track().orderBy("beat_idx")
    n = F.count("*").over(track())
    last = F.col("beat_idx") == n - 1
    before = F.col("t") - F.lag("t").over(order)
    spans = beats.withColumn("next_t", F.coalesce(F.lead("t").over(order), F.col("t") + before)).withColumn("n", n).withColumn("last", last)
    spans = spans.withColumn("idx", F.least(F.col("beat_idx"), F.col("n") - 2)).select("track_id", F.col("t").alias("prev_beat_time"), F.col("next_t").alias("next_beat_time"), F.col("idx").cast("int").alias("beat_index"))
    firsts = beats.groupBy("track_id").agg(F.min_by("t", "beat_idx").alias("first_t"), F.min(F.when(F.col("beat_idx") == 1, F.col("t"))).alias("second_t"))
    bars = asof_fill(
        spans.withColumn("late", F.col("prev_beat_time") + 0.001), downbeats.select("track_id", "t", "db_idx"), "late", "t", ["db_idx"]
    ).drop("late")
    anacrusis = beats.where("beat_idx = 0").select("track_id", F.col("t").alias("b0")).join(by_sort(downbeats.where("db_idx = 0").select("track_id", F.col("t").alias("d0"))), "track_id", "left").select("track_id", F.coalesce(F.col("d0") > F.col("b0") + 0.001, F.lit(False)).alias("pickup"))
    bar = F.when(F.col("db_idx").isNull(), F.lit(0)).otherwise(F.col("db_idx") + F.when(F.col("pickup"), 1).otherwise(0)).cast("int")
    spans = bars.join(by_sort(anacrusis), "track_id").withColumn("bar_index", bar).drop("db_idx", "pickup")
    head = firsts.join(spans.where("beat_index = 0").groupBy("track_id").agg(F.min_by("bar_index", "prev_beat_time").alias("bar0")), "track_id")
    early = notes.join(by_sort(head), "track_id").where("start_time < first_t").select(
        *(notes[c] for c in notes.columns), F.col("first_t").alias("prev_beat_time"), F.col("second_t").alias("next_beat_time"), F.lit(0).alias("beat_index"), F.col("bar0").alias("bar_index")
    )
    placed = asof_fill(notes, spans.withColumn("mark", F.col("prev_beat_time")), "start_time", "mark", ["prev_beat_time", "next_beat_time", "beat_index", "bar_index"]).where("prev_beat_time is not null")
    rows = placed.unionByName(early)
    gap = F.col("next_beat_time") - F.col("prev_beat_time")
    intra = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("start_time") - F.col("prev_beat_time")) / gap))
    return rows.withColumn("beat_duration_sec", gap).withColumn("intra_beat_pos", intra)


def swing_sections(aligned: DataFrame, bars: int = 4) -> DataFrame:
    """Straight or swing for each section of some bars, by where the notes lie inside the beat (20 bins)."""
    b = F.least(F.round(F.col("intra_beat_pos") * 20), F.lit(19)).cast("int")
    on, straight, swing = b.isin(0, 1, 19), b.between(9, 11), b.between(12, 14)
    facts = aligned.withColumn("section", F.floor(F.col("bar_index") / bars).cast("int")).groupBy("track_id", "section").agg(
        F.count("*").alias("n"), F.count_distinct("bar_index").alias("bars"), F.count_if(on).alias("on_beat"), F.count_if(straight).alias("straight"), F.count_if(swing).alias("swing")
    )
    total = F.col("n").cast("double")
    is_swing = (F.col("n") >= 4) & (F.col("bars") >= 2) & ((F.col("on_beat") + F.col("swing")) / total > 0.55) & (F.col("swing") > F.col("straight"))
    return facts.select("track_id", "section", (F.col("section") * bars).alias("bar_start"), (F.col("section") * bars + bars).alias("bar_end"), F.when(is_swing, "Swing").otherwise("Straight").alias("style"), "n", F.when(is_swing, F.lit(2.0) / 3).alias("swing_ratio"))


def swing_majority(sections: DataFrame) -> DataFrame:
    """The style of most bars for each track; a tie is straight."""
    bars = F.col("bar_end") - F.col("bar_start")
    votes = sections.groupBy("track_id").agg(F.sum(F.when(F.col("style") == "Swing", bars).otherwise(0)).alias("swing_bars"), F.sum(bars).alias("bars"))
    return votes.select("track_id", "swing_bars", "bars", F.when(F.col("swing_bars") * 2 > F.col("bars"), "Swing").otherwise("Straight").alias("style"))


# Where the notes of each style may lie inside a beat.
STYLES = {"Straight": (0.0, 0.5, 1.0), "Swing": (0.0, 2.0 / 3, 1.0), "Triplet": (0.0, 1.0 / 3, 2.0 / 3, 1.0)}


def style_of_bars(aligned: DataFrame, sections: DataFrame) -> DataFrame:
    """aligned with style: that of the section which holds the bar, else of the track's first section, else straight."""
    marks = sections.select("track_id", F.col("bar_start").cast("int").alias("mark"), F.col("bar_end").alias("until"), F.col("style").alias("kind"))
    first = marks.groupBy("track_id").agg(F.min_by("kind", "mark").alias("first_style"))
    found = asof_fill(aligned, marks, "bar_index", "mark", ["until", "kind"]).join(first, "track_id", "left")
    style = F.coalesce(F.when(F.col("bar_index") < F.col("until"), F.col("kind")), F.col("first_style"), F.lit("Straight"))
    return found.withColumn("style", style).drop("until", "kind", "first_style")


def majority_sections(sections: DataFrame) -> DataFrame:
    """One section for each track with several: the style of most of its bars throughout."""
    whole = sections.groupBy("track_id").agg(F.min("bar_start").alias("bar_start"), F.max("bar_end").alias("bar_end"), F.count("*").alias("n"), F.first("style").alias("own"))
    return whole.join(swing_majority(sections).select("track_id", F.col("style").alias("most")), "track_id").select("track_id", F.lit(0).alias("bar_start"), "bar_end", F.when(F.col("n") > 1, F.col("most")).otherwise(F.col("own")).alias("style"))


def quantize_aligned(aligned: DataFrame, sections: DataFrame | None = None, bpb: int = 4) -> DataFrame:
    """Positions inside the beat snapped to the grid of the bar's style; lengths to the next onset of another pitch or time.

    sections: (track_id, bar_start, bar_end, style) as of swing_sections(); without any all is straight.

    The next onset is, in the order of start and id, the earliest start that lies over 1 ms later or has another pitch; where
    that is no later than the note, its own length counts. Two ordered windows give it without looking at all pairs."""
    aligned = aligned.withColumn("style", F.lit("Straight")) if sections is None else style_of_bars(aligned, sections)
    order = track().orderBy("start_time", "id")
    us = F.round(F.col("start_time") * 1e6).cast("bigint")
    rows = aligned.withColumn("us", us).withColumn("changed", F.when(F.col("pitch") == F.lag("pitch").over(order), 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("changed").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    later = F.min("start_time").over(track().orderBy("us").rangeBetween(1001, Window.unboundedFollowing))
    heads = rows.where("changed = 1").select("track_id", F.col("run").alias("run"), F.lead("start_time").over(track().orderBy("run")).alias("other_pitch"))
    rows = rows.withColumn("later", later).join(heads, ["track_id", "run"])
    upcoming = F.least("later", "other_pitch")
    own = F.greatest(F.lit(0.05), F.col("end_time") - F.col("start_time"))
    raw = F.when(upcoming > F.col("start_time"), upcoming - F.col("start_time")).otherwise(own) / F.col("beat_duration_sec")
    places = F.when(F.col("style") == "Swing", F.array(*map(F.lit, STYLES["Swing"]))).when(F.col("style") == "Triplet", F.array(*map(F.lit, STYLES["Triplet"]))).otherwise(F.array(*map(F.lit, STYLES["Straight"])))
    off = F.transform(places, lambda p: F.struct(F.abs(F.col("intra_beat_pos") - p).alias("e"), p.alias("p")))  # the nearer, then the earlier
    rows = rows.withColumn("near", F.array_min(off)).withColumn("raw", raw)
    best, err = F.col("near.p"), F.col("near.e")
    grid = F.when(F.col("style") == "Triplet", F.lit(1.0 / 3)).otherwise(F.greatest(best, F.lit(0.25)))
    return rows.select(
        "track_id", "id", "pitch", "velocity", (F.col("beat_index") + best).alias("beat_start"), F.greatest(grid, F.round(F.col("raw") / grid) * grid).alias("beat_duration"),
        F.greatest(F.lit(0.3), F.least(F.lit(1.0), 1 - 2 * err)).alias("confidence"), "bar_index", (F.col("beat_index") % bpb).cast("int").alias("beat_in_bar"), F.col("style").alias("swing_style"),
    )


def grace_notes(notes: DataFrame, longest: float = 0.08, within: float = 0.6) -> DataFrame:
    """Notes under 80 ms before another pitch that starts within 0.6 s."""
    order = track().orderBy("start_time", "id")
    rows = notes.withColumn("next_start", F.lead("start_time").over(order)).withColumn("next_pitch", F.lead("pitch").over(order))
    grace = (F.col("end_time") - F.col("start_time") < longest) & (F.col("next_start") - F.col("start_time") < within) & (F.col("next_pitch") != F.col("pitch"))
    return rows.select("track_id", "id", "pitch", F.coalesce(grace, F.lit(False)).alias("is_grace"))


def articulation(quantised: DataFrame, notes: DataFrame, beat_sec: float) -> DataFrame:
    """Staccato, tenuto or normal, from the nearest played note of the same pitch: shorter id first on ties.

    The nearest is found by two ordered lookups, the last start before and the first after, not by all pairs of a pitch."""
    want = quantised.select("track_id", "id", "pitch", "beat_duration", (F.col("beat_start") * beat_sec).alias("want"))
    played = notes.select("track_id", "pitch", "start_time", (F.col("end_time") - F.col("start_time")).alias("length"), F.col("id").alias("note_id"))
    once = played.groupBy("track_id", "pitch", "start_time").agg(F.min_by("length", "note_id").alias("length"))
    mark = once.withColumn("hit", F.struct("start_time", "length"))
    both = want.select("track_id", "pitch", F.col("want").alias("t"), F.lit(1).alias("side"), "id", "beat_duration", F.lit(None).cast(mark.schema["hit"].dataType).alias("hit")).unionByName(
        mark.select("track_id", "pitch", F.col("start_time").alias("t"), F.lit(0).alias("side"), F.lit(None).cast("int").alias("id"), F.lit(None).cast("double").alias("beat_duration"), "hit")
    )
    w = Window.partitionBy("track_id", "pitch").orderBy("t", "side")
    near = both.withColumn("before", F.last("hit", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("after", F.first("hit", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))).where("side = 1")
    closer = F.when(F.col("before").isNull() | (F.col("after.start_time") - F.col("t") < F.col("t") - F.col("before.start_time")), F.col("after")).otherwise(F.col("before"))
    rows = near.withColumn("played", closer).withColumn("ratio", F.col("played.length") / (F.col("beat_duration") * beat_sec))
    kind = F.when((F.col("ratio") < 0.5) | (F.col("played.length") < 0.08), "Staccato").when(F.col("ratio") > 0.9, "Tenuto").otherwise("Normal")
    return rows.where("played is not null").select("track_id", "id", "pitch", kind.alias("articulation"))
