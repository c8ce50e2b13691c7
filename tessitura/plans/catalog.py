"""The registered queries of the engine's own operators, and the DuckDB SQL that says the same on the same tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import beats as B
from ..operators import cache as H
from ..operators import chords as C
from ..operators import engraving as G
from ..operators import frames as N
from ..operators import hmm as V
from ..operators import melody as P
from ..operators import mixing as K
from ..operators import models as M
from ..operators import quantize as Q
from ..operators import repair as W
from ..operators import score as E
from ..operators import session as U
from ..operators import signal as A
from ..operators import spectral as S
from ..operators import tempo as T
from ..operators import timejoin as J
from ..sources import bindings as D
from ..sources import files as FS
from ..sources import listing as SRC
from ..sources import wav as WV
from ..streaming import chunks as R
from . import lead_sheet as Z
from .oracles import ORACLES  # noqa: F401  re-exported for the driver contract

THRESHOLD, STEP = 0.12, D.STEP_SEC


def r6(df, *columns):
    """The columns rounded to six places: sums differ in their last bits between engines."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


def active(spark, sf):
    return D.note_frames(spark, sf).withColumn("active", F.col("prob") >= THRESHOLD)


def stem_frames(spark, sf):
    """One song whose stems are the labels modulo six; frames of equal stem and number keep their largest probability."""
    rows = D.note_frames(spark, sf).select(F.lit(1).cast("bigint").alias("song"), (F.col("track_id") % 6).cast("int").alias("stem_idx"), "frame", "pitch", "prob")
    return rows.groupBy("song", "stem_idx", "frame", "pitch").agg(F.max("prob").alias("prob"))


def aligned(spark, sf):
    return Q.associate(D.note_events(spark, sf), D.beats(spark, sf), D.downbeats(spark, sf))


def quantised(spark, sf):
    return Q.quantize_constant(D.note_events(spark, sf), 120.0)


def signatures(spark, sf):
    """4/4 for 32 beats, then 3/4 to beat 80."""
    rows = spark.createDataFrame([(0.0, 32.0, 4, 4, 1.0), (32.0, 80.0, 3, 4, 0.8)], "start_beat double, end_beat double, numerator int, denominator int, confidence double")
    return D.tempo_segments(spark, sf).select("track_id").distinct().crossJoin(F.broadcast(rows))


def stems_signal(spark, sf):
    """The signal blocks as stems of one song: stem = label modulo six, positions by sample."""
    rows = D.signal(spark, sf).select(F.lit(1).cast("bigint").alias("song"), (F.col("track_id") % 6).cast("int").alias("stem_idx"), "i", "x")
    return rows.groupBy("song", "stem_idx", "i").agg(F.max("x").alias("x"))


def note_extract(spark, sf):
    return r6(N.extract_notes(D.note_frames(spark, sf), THRESHOLD, STEP), "start_time", "end_time")


def note_islands(spark, sf):
    return r6(N.note_islands(D.note_frames(spark, sf), THRESHOLD, STEP), "start_time", "end_time")


def note_merge_gap(spark, sf):
    return r6(N.merge_adjacent(D.note_events(spark, sf), 0.5), "start_time", "end_time")


def note_union_stems(spark, sf):
    return r6(N.union_stems(stem_frames(spark, sf), 0.3, STEP), "start_time", "end_time")


def frame_threshold(spark, sf):
    rows = D.prob_arrays(spark, sf).select("track_id", "frame", F.posexplode(N.threshold(F.col("probs"), THRESHOLD)).alias("pos", "on"))
    return rows.groupBy("track_id", "frame").agg(F.count_if("on").alias("n_on"))


def frame_active_notes(spark, sf):
    rows = D.prob_arrays(spark, sf).select("track_id", "frame", F.explode(N.active_notes(F.col("probs"), 0.5)).alias("a"))
    return r6(rows.select("track_id", "frame", F.col("a.idx").cast("int").alias("idx"), F.col("a.conf").alias("conf")), "conf")


def frame_topk_floor(spark, sf):
    return r6(D.prob_arrays(spark, sf).select("track_id", "frame", N.top_k_floor(F.col("probs")).alias("floor12")), "floor12")


def frame_argmax_pitch(spark, sf):
    return D.prob_arrays(spark, sf).select("track_id", "frame", N.argmax_pitch(F.col("probs")).alias("pitch"))


def frame_lookahead_vote(spark, sf):
    return N.lookahead_vote(D.note_frames(spark, sf)).where("active").select("track_id", "frame", "pitch")


def frame_min_duration(spark, sf):
    return N.min_duration(active(spark, sf).where("active")).select("track_id", "frame", "pitch")


def note_onsets(spark, sf):
    return N.onsets(active(spark, sf))


def note_offsets(spark, sf):
    return N.offsets(active(spark, sf))


def stem_max_combine(spark, sf):
    return r6(N.combine_stems(stem_frames(spark, sf)), "prob")


def timeline_transpose(spark, sf):
    rows = D.prob_arrays(spark, sf).select("track_id", "frame", F.posexplode(N.transpose(F.col("probs"), 1.5)).alias("pos", "prob"))
    return r6(rows.select("track_id", "frame", F.col("pos").cast("int").alias("pos"), "prob"), "prob")


def nearest_frame_lookup(spark, sf):
    return D.note_events(spark, sf).select("track_id", "id", N.nearest_frame(F.col("start_time"), STEP, F.lit(1200)).alias("frame"))


def viterbi_binary(spark, sf):
    return V.viterbi(D.prob_arrays(spark, sf))


def joint_rhythm_states(spark, sf):
    """The states that the beats of all tracks pass through, and how often."""
    states = V.rhythm_states(spark)
    path = D.beats(spark, sf).select((F.col("beat_idx") % F.lit(61 * 27)).cast("int").alias("state_idx"))
    return path.groupBy("state_idx").agg(F.count("*").alias("n")).join(F.broadcast(states), "state_idx")


def joint_path_segments(spark, sf):
    """A path through known states: tempo bin 40, 4 beats, then 3 beats."""
    states = V.rhythm_states(spark)
    path = D.beats(spark, sf).select("track_id", F.col("beat_idx").alias("frame"), F.when(F.col("beat_idx") < 64, (20 * 27) + 5 + F.col("beat_idx") % 4).otherwise((20 * 27) + 2 + F.col("beat_idx") % 3).cast("int").alias("state_idx"))
    return V.path_segments(path, states, "meter_class")


def joint_path_downbeats(spark, sf):
    states = V.rhythm_states(spark)
    path = D.beats(spark, sf).select("track_id", F.col("beat_idx").alias("frame"), ((20 * 27) + 5 + F.col("beat_idx") % 4).cast("int").alias("state_idx"))
    return V.path_downbeats(path, states)


def joint_viterbi(spark, sf):
    """Best path where the observations favour tempo bin 40 and 4 beats in turn."""
    favoured = 20 * 27 + 5 + F.col("beat_idx") % 4
    obs = D.beats(spark, sf).select("track_id", F.col("beat_idx").alias("frame"), F.create_map(favoured, F.lit(2.0)).alias("scores"))
    return V.decode_joint(obs)


def beat_intervals(spark, sf):
    return r6(B.beat_intervals(D.beats(spark, sf)), "gap")


def beats_per_bar(spark, sf):
    return B.beats_per_bar(D.beats(spark, sf), D.downbeats(spark, sf))


def bar_tempo_map(spark, sf):
    return r6(B.bar_tempo_map(D.beats(spark, sf), D.downbeats(spark, sf)), "start_time_sec", "end_time_sec", "bpm", "beat_duration_sec", "beat_offset")


def tempo_map_from_beats(spark, sf):
    return r6(B.tempo_map_from_beats(D.beats(spark, sf)), "start_time_sec", "end_time_sec", "bpm", "beat_duration_sec", "beat_offset", "confidence")


def beat_grid_from_bpm(spark, sf):
    ends = D.note_events(spark, sf).groupBy("track_id").agg(F.max("end_time").alias("duration")).withColumn("bpm", F.lit(120.0))
    return r6(B.grid_from_bpm(ends), "t")


def beat_grid_from_notes(spark, sf):
    notes = D.note_events(spark, sf)
    return r6(B.grid_from_notes(notes, notes.select("track_id").distinct().withColumn("bpm", F.lit(120.0))), "t")


def metric_level_double(spark, sf):
    return r6(B.double_beats(D.beats(spark, sf)), "t")


def metric_level_halve(spark, sf):
    return r6(B.halve_beats(D.beats(spark, sf)), "t")


def sparse_beats(spark, sf):
    """Every fourth beat of even tracks, numbered anew; odd tracks keep theirs."""
    rows = D.beats(spark, sf).where("track_id % 2 = 1 or beat_idx % 4 = 0")
    return rows.select("track_id", F.when(F.col("track_id") % 2 == 1, F.col("beat_idx")).otherwise(F.floor(F.col("beat_idx") / 4)).cast("int").alias("beat_idx"), "t")


def metric_level_choice(spark, sf):
    return r6(W.metric_level(sparse_beats(spark, sf), D.downbeats(spark, sf)), "bpm")


def metric_level_fixed(spark, sf):
    return r6(W.with_metric_level(sparse_beats(spark, sf), D.downbeats(spark, sf)), "t")


def beat_sources(spark, sf):
    """Three sources' beats and downbeats: as they are, 50 ms later, and 90 ms later with every other downbeat; some combined ones are missing."""
    b, d = D.beats(spark, sf), D.downbeats(spark, sf)
    moved = lambda rows, name, by, where: rows.where(where).select("track_id", F.lit(name).alias("source"), (F.col("t") + by).alias("t"))
    beats = moved(b, "combined", 0.0, "true").union(moved(b, "drums", 0.05, "true")).union(moved(b, "bass", 0.09, "true"))
    return beats, moved(d, "combined", 0.0, "db_idx % 7 != 3").union(moved(d, "drums", 0.05, "true")).union(moved(d, "bass", 0.09, "db_idx % 2 = 0"))


def beat_agreement(spark, sf):
    return r6(W.agreed_beats(*beat_sources(spark, sf))[0], "bpm", "confidence")


def beat_grid_finished(spark, sf):
    return r6(W.agreed_beats(*beat_sources(spark, sf))[1], "t")


def beat_single_source(spark, sf):
    return r6(W.single_source(D.beats(spark, sf), D.downbeats(spark, sf)), "bpm")


def bpm_from_audio(spark, sf):
    return r6(W.bpm_from_audio(D.signal_blocks(spark, sf), D.SAMPLE_RATE), "bpm", "beat_duration_sec", "confidence")


def beat_model(spark, sf):
    return r6(W.pulse_beats(D.signal_blocks(spark, sf), D.SAMPLE_RATE), "t")


def moving_average(spark, sf):
    return r6(W.moving_average(D.signal(spark, sf), 5), "x")


def named_stems(spark, sf):
    """The signal's stems of two songs by name; song 2 has neither bass nor drums."""
    names = F.array(*map(F.lit, ("drums", "bass", "other", "vocals", "guitar", "piano")))
    rows = stems_signal(spark, sf).withColumn("stem", F.element_at(names, F.col("stem_idx") + 1))
    return rows.unionByName(rows.where("stem_idx > 1").withColumn("song", F.lit(2).cast("bigint")))


def low_stems(spark, sf):
    stems = named_stems(spark, sf)
    return r6(W.low_stems(stems, stems.groupBy("song", "i").agg(F.sum("x").alias("x"))), "x")


def beats_from_stems(spark, sf):
    stems = named_stems(spark, sf)
    return r6(W.beats_from_stems(stems, stems.groupBy("song", "i").agg(F.sum("x").alias("x")), D.SAMPLE_RATE), "t")


def analysis_mix(spark, sf):
    stems = named_stems(spark, sf)
    enabled = stems.select("song", "stem_idx").distinct().where("song = 1 and stem_idx in (0, 1, 3)")
    return r6(K.analysis_mix(stems, enabled), "x")


def channel_frames(spark, sf):
    """Three channels of each track's signal: as it is, halved, and turned."""
    return D.signal(spark, sf).select("track_id", "i", F.array(F.col("x"), F.col("x") / 2, -F.col("x")).alias("samples"))


def stereo_resample(spark, sf):
    return r6(K.stereo_at_rate(channel_frames(spark, sf), 441, 600), "l", "r")


def stereo_blend(spark, sf):
    """Stem 0 is mono, the others stereo with a quieter right."""
    rows = stems_signal(spark, sf).withColumn("channel", F.explode(F.when(F.col("stem_idx") == 0, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
    return r6(K.blend_channels(rows.withColumn("x", F.when(F.col("channel") == 1, F.col("x") * 0.5).otherwise(F.col("x")))), "x")


def stem_selection(spark, sf):
    """Songs by customer: saved stems, of which some songs lack one."""
    rows = D.read(spark, sf, "customer").select(F.col("c_custkey").alias("song"))
    stems = rows.select("song", F.explode(F.sequence(F.lit(0), F.when(F.col("song") % 3 == 0, 3).otherwise(5))).alias("stem_idx")).withColumn("on", F.col("stem_idx") > 0)
    saved = rows.where("song % 4 != 0").select("song", F.array(F.lit(1), F.lit(4)).alias("stems"))
    return K.restored_stems(saved, stems)


def output_time(spark, sf):
    rows = D.note_events(spark, sf).withColumn("speed", F.col("velocity") / 20.0)
    return r6(rows.select("track_id", "id", K.output_seconds(F.col("start_time"), F.col("speed")).alias("out"), K.frame_step(F.col("end_time"), F.col("pitch")).alias("step")), "out", "step")


def frame_points(spark, sf):
    """Three times for each track of frames."""
    return D.prob_arrays(spark, sf).select("track_id").distinct().select("track_id", F.explode(F.array(*map(F.lit, (0.02, 0.61, 99.0)))).alias("t"))


def current_frame(spark, sf):
    rows = K.current_frame(D.prob_arrays(spark, sf), frame_points(spark, sf), STEP).select("track_id", "t", "frame", F.posexplode("probs").alias("pos", "prob"))
    return r6(rows.select("track_id", "t", "frame", F.col("pos").cast("int").alias("pos"), "prob"), "prob")


def point_probabilities(spark, sf):
    return r6(K.point_probabilities(D.prob_arrays(spark, sf), frame_points(spark, sf), STEP), "prob")


def pitch_track(spark, sf):
    rows = K.pitch_track(D.prob_arrays(spark, sf), 0.9)
    return rows.select("track_id", "frame", F.isnan("pitch").alias("silent"), F.when(~F.isnan("pitch"), F.col("pitch").cast("int")).alias("pitch"))


def spectral_peaks(spark, sf):
    rows = D.prob_arrays(spark, sf).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(63), F.lit(9))))
    return r6(rows.select("track_id", "frame", "k", K.weighted_peak(F.col("probs"), F.col("k")).alias("peak"), K.noise_floor(F.col("probs"), F.col("k")).alias("floor")), "peak", "floor")


def tempo_and_meter_at_beat(spark, sf):
    points = D.beats(spark, sf).select("track_id", F.col("beat_idx").cast("double").alias("beat"))
    return K.at_beat(points, D.tempo_segments(spark, sf), signatures(spark, sf))


def measure_of_tick(spark, sf):
    spans = E.note_spans(quantised(spark, sf))
    until = spans.groupBy("track_id").agg(F.max("end_tick").alias("end_tick"))
    points = spans.select("track_id", F.col("start_tick").alias("tick")).distinct()
    return G.measure_of_tick(points, E.measure_boundaries(signatures(spark, sf), until))


def svg_note_positions(spark, sf):
    """A page for each track that draws its notes as rectangles, half a margin to the right."""
    spans = D.note_events(spark, sf)
    rect = F.format_string('<g id="n%d_%d_%d_%d"><rect x="%d" y="%d" width="10" height="5"/></g>', "id", "pitch", F.col("id") * 120, F.lit(240), F.col("id") * 3, F.col("pitch"))
    page = spans.groupBy("track_id").agg(F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 1000 200"><g class="page-margin" transform="translate(50, 20)">'), F.array_join(F.array_sort(F.collect_list(rect)), ""), F.lit("</g></svg>")).alias("svg"))
    return r6(G.note_positions(page.withColumnRenamed("track_id", "page_id")), "x", "y", "w", "h")


def cache_timeline_lookup(spark, sf):
    """Two entries for each track of frames, one of another version, quality, length or with a broken frame."""
    frames = D.prob_arrays(spark, sf).groupBy("track_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "probs"))), lambda f: f["probs"]).alias("timeline"))
    base = frames.select(
        F.col("track_id").cast("string").alias("content_hash"), F.lit(1).cast("bigint").alias("variant_key"), F.lit(441).alias("sample_rate"), F.lit(1).alias("quality"), F.lit(1.0).alias("speed"), F.lit(0.0).alias("pitch"), F.lit(True).alias("use_cqt"), F.lit(True).alias("preprocess"),
        F.round(F.size("timeline") * STEP * 441).cast("bigint").alias("n_samples"), "timeline", F.col("track_id").alias("k"),
    )
    wanted = base.drop("timeline", "k")
    first = base.withColumn("entry", F.lit(1)).withColumn("version", F.when(F.col("k") % 4 == 0, 3).otherwise(4)).withColumn("quality", F.when(F.col("k") % 4 == 1, 2).otherwise(F.col("quality"))).withColumn("n_samples", F.when(F.col("k") % 4 == 2, F.col("n_samples") + 1).otherwise(F.col("n_samples"))).withColumn("step_sec", F.when(F.col("k") % 4 == 2, STEP * 9).otherwise(STEP))
    second = base.withColumn("entry", F.lit(2)).withColumn("version", F.lit(4)).withColumn("variant_key", F.lit(2).cast("bigint")).withColumn("step_sec", F.when(F.col("k") % 3 == 0, 0.0).otherwise(STEP))
    return H.find_timeline(wanted, first.unionByName(second).drop("k"), width=64)


def downbeat_consensus(spark, sf):
    """Three sources: the downbeats, the same moved by 50 ms, and by 90 ms where their number is even."""
    d = D.downbeats(spark, sf)
    moved = lambda name, by, where: d.where(where).select("track_id", F.lit(name).alias("source"), (F.col("t") + by).alias("t"))
    return r6(B.downbeat_consensus(d, moved("mix", 0.0, "true").union(moved("drums", 0.05, "true")).union(moved("bass", 0.09, "db_idx % 2 = 0"))), "t")


def downbeat_gap_fill(spark, sf):
    return r6(B.fill_downbeat_gaps(D.downbeats(spark, sf).where("db_idx % 7 != 3"), 0.5), "t")


def downbeats_without_beat(spark, sf):
    return r6(B.missing_beats(D.downbeats(spark, sf), D.beats(spark, sf).where("beat_idx % 8 != 0"), 0.5), "t")


def barline_grid(spark, sf):
    return r6(B.barlines(signatures(spark, sf), 120.0), "beat")


def onset_collect(spark, sf):
    rows = T.onset_lists(D.note_events(spark, sf)).select("track_id", F.posexplode("onsets").alias("pos", "t"))
    return r6(rows.select("track_id", F.col("pos").cast("int").alias("pos"), "t"), "t")


def bpm_autocorrelation(spark, sf):
    return r6(T.bpm_autocorrelation(D.note_events(spark, sf)), "bpm", "confidence")


def bpm_octave_resolved(spark, sf):
    return r6(T.resolve_octave(D.note_events(spark, sf)), "bpm", "confidence")


def subdivision_alignment(spark, sf):
    return r6(D.note_events(spark, sf).select("track_id", "id", T.subdivision_error(F.col("start_time"), F.lit(0.5)).alias("error")), "error")


def sliding_tempo(spark, sf):
    return r6(T.sliding_windows(D.note_events(spark, sf)), "mean_gap")


def windowed_tempo_map(spark, sf):
    return r6(T.tempo_segments(D.note_events(spark, sf)), "bpm", "beat_duration_sec", "beat_offset")


def meter_inference(spark, sf):
    return r6(T.infer_meter(D.note_events(spark, sf), D.tempo_segments(spark, sf)), "confidence")


def meter_merge(spark, sf):
    halves = signatures(spark, sf).withColumn("half", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        "track_id", (F.col("start_beat") + F.col("half") * (F.col("end_beat") - F.col("start_beat")) / 2).alias("start_beat"),
        (F.col("end_beat") - (1 - F.col("half")) * (F.col("end_beat") - F.col("start_beat")) / 2).alias("end_beat"), "numerator", "denominator", (F.col("confidence") - F.col("half") * 0.1).alias("confidence"),
    )
    return r6(T.merge_equal_neighbours(halves), "confidence")


def rhythm_confidence(spark, sf):
    est = D.tempo_segments(spark, sf).select("track_id").distinct().withColumn("bpm", F.lit(125.0))
    return r6(T.rhythm_confidence(D.tempo_segments(spark, sf), signatures(spark, sf), est), "confidence")


def note_to_beat_time(spark, sf):
    rows = J.time_to_beat(D.note_events(spark, sf).select("track_id", "id", F.col("start_time").alias("t")), D.tempo_segments(spark, sf))
    return r6(rows, "t", "beat")


def beat_to_time(spark, sf):
    rows = D.beats(spark, sf).select("track_id", "beat_idx", F.col("beat_idx").cast("double").alias("beat"))
    return r6(J.beat_to_time(rows, D.tempo_segments(spark, sf)), "t")


def note_in_bar_interval(spark, sf):
    bars = D.downbeats(spark, sf).withColumn("stop", J.next_in_track("t", "db_idx")).where("stop is not null").select("track_id", "db_idx", F.col("t").alias("bar_t"), "stop")
    return J.interval_join(D.note_events(spark, sf).select("track_id", "id", "start_time"), bars, "start_time", "bar_t", "stop", 2.0).select("track_id", "id", "db_idx")


def note_beat_association(spark, sf):
    return r6(aligned(spark, sf).select("track_id", "id", "beat_index", "bar_index", "prev_beat_time", "next_beat_time", "intra_beat_pos"), "prev_beat_time", "next_beat_time", "intra_beat_pos")


def beat_to_bar(spark, sf):
    d = D.downbeats(spark, sf)
    rows = J.asof_fill(D.beats(spark, sf).withColumn("late", F.col("t") + 0.001), d.select("track_id", "t", "db_idx"), "late", "t", ["db_idx"])
    return rows.groupBy("track_id", "db_idx").agg(F.count("*").alias("n_beats"))


def swing_sections(spark, sf):
    return r6(Q.swing_sections(aligned(spark, sf)), "swing_ratio")


def swing_majority(spark, sf):
    return Q.swing_majority(Q.swing_sections(aligned(spark, sf)))


def quantize_constant(spark, sf):
    return r6(quantised(spark, sf), "beat_start", "beat_duration")


def quantize_tempo_map(spark, sf):
    return r6(Q.quantize_tempo_map(D.note_events(spark, sf), D.tempo_segments(spark, sf)), "beat_start", "beat_duration")


def quantize_aligned(spark, sf):
    """Straight, swing, triplet and straight again, by four bars."""
    styles = [(0, 4, "Straight"), (4, 8, "Swing"), (8, 12, "Triplet"), (12, 10_000, "Straight")]
    notes = aligned(spark, sf)
    sections = D.tempo_segments(spark, sf).select("track_id").distinct().crossJoin(F.broadcast(spark.createDataFrame(styles, "bar_start int, bar_end int, style string")))
    return r6(Q.quantize_aligned(notes, sections), "beat_start", "beat_duration", "confidence")


def barline_crossings(spark, sf):
    return r6(Q.barline_crossings(quantised(spark, sf), B.barlines(signatures(spark, sf), 120.0)), "beat")


def notes_with_ties(spark, sf):
    return r6(Q.tied_notes(D.note_events(spark, sf), D.tempo_segments(spark, sf), signatures(spark, sf)), "beat_start", "beat_duration")


def grace_notes(spark, sf):
    return Q.grace_notes(D.note_events(spark, sf))


def articulation_nearest(spark, sf):
    return Q.articulation(quantised(spark, sf), D.note_events(spark, sf), 0.5)


def heard_sets(spark, sf):
    """The pitch-class sets and basses that sound on the beats, and how often."""
    q = quantised(spark, sf)
    grid = q.select("track_id", F.floor("beat_start").cast("double").alias("beat")).distinct()
    return C.sounding_at(grid, q).groupBy("mask", "bass").agg(F.count("*").alias("n"))


def chord_symbol_lookup(spark, sf):
    return C.symbols(heard_sets(spark, sf))


def chord_scores(spark, sf):
    return C.chord_scores(heard_sets(spark, sf))


def chord_active_set(spark, sf):
    q = quantised(spark, sf)
    grid = q.select("track_id", F.floor("beat_start").cast("double").alias("beat")).distinct()
    return r6(C.sounding_at(grid, q), "held")


def chord_scan_step(spark, sf):
    return C.chord_scan(quantised(spark, sf))


def chord_scan_per_bar(spark, sf):
    return C.chords_per_bar(quantised(spark, sf))


def chord_symbol_parse(spark, sf):
    rows = C.symbols(heard_sets(spark, sf)).select("symbol").distinct()
    p = X.parse_chord(F.col("symbol"))
    return rows.select("symbol", p["root"].alias("root"), p["suffix"].alias("suffix"), p["bass"].alias("bass"))


def chord_kind_map(spark, sf):
    rows = C.symbols(heard_sets(spark, sf)).select(X.parse_chord(F.col("symbol"))["suffix"].alias("suffix")).distinct()
    return rows.select("suffix", X.chord_kind(F.col("suffix")).alias("kind"))


def stem_label_classify(spark, sf):
    label = F.concat(F.col("p_type"), F.lit(" "), F.element_at(F.array(*map(F.lit, ("Drum kit", "Bass", "Lead Vocal", "Guitar", "Keys", "misc"))), (F.col("p_partkey") % 6 + 1).cast("int")))
    rows = D.read(spark, sf, "part").select("p_partkey", label.alias("label"))
    stem = X.stem_of(F.col("label"))
    return rows.select("p_partkey", stem.alias("stem"), X.is_melodic(stem).alias("melodic"))


def clock_text(spark, sf):
    rows = D.read(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 20000).cast("double").alias("s"))
    text = X.clock_text(F.col("s"))
    return rows.select("o_orderkey", text.alias("clock"), X.parse_clock(text).alias("seconds"))


def midi_names(spark, sf):
    rows = D.note_events(spark, sf).select("pitch").distinct()
    return rows.select("pitch", X.midi_name(F.col("pitch")).alias("name"), X.is_black_key(F.col("pitch")).alias("black"), F.round(S.midi_to_hz(F.col("pitch")), 6).alias("hz"))


def xml_escape(spark, sf):
    return D.read(spark, sf, "pages").select("page_id", X.xml_escape(F.col("html")).alias("escaped"))


def melody_skyline(spark, sf):
    return r6(P.melody_skyline(D.note_events(spark, sf)), "start_time", "end_time")


def melody_heuristic(spark, sf):
    return r6(P.melody_heuristic(D.note_events(spark, sf)), "start_time", "end_time")


def melody_continuity(spark, sf):
    return r6(P.melody_continuity(D.note_events(spark, sf)), "start_time", "end_time")


def resample_up(spark, sf):
    return r6(A.resample(D.signal_blocks(spark, sf), 441, 882), "x")


def resample_down(spark, sf):
    return r6(A.resample(D.signal_blocks(spark, sf), 441, 147), "x")


def waveform_points(spark, sf):
    return r6(A.waveform(D.signal(spark, sf), D.SAMPLE_RATE, 500), "t", "amp")


def waveform_peak_norm(spark, sf):
    return r6(A.waveform_peak_norm(D.signal(spark, sf), D.SAMPLE_RATE, 500, 1.5), "t", "amp")


def stem_blend(spark, sf):
    return r6(A.stem_blend(stems_signal(spark, sf)), "x")


def loudness_match(spark, sf):
    s = D.signal(spark, sf)
    return r6(A.loudness_match(s.withColumn("x", F.col("x") * 0.1), s), "x")


def edge_fades(spark, sf):
    return r6(A.edge_fades(D.signal(spark, sf), D.SAMPLE_RATE, 0.05), "x")


def rms_energy(spark, sf):
    return r6(A.rms(D.signal(spark, sf)), "rms")


def zero_crossing_variance(spark, sf):
    return r6(A.zero_crossing_variance(D.signal(spark, sf), 128, 64), "variance")


def stem_energy_share(spark, sf):
    return r6(A.stem_energy_share(stems_signal(spark, sf)), "confidence")


def moving_median(spark, sf):
    return r6(A.moving_median(D.signal(spark, sf), 3), "x")


def min_max_normalize(spark, sf):
    return r6(A.min_max_normalize(D.signal(spark, sf)), "x")


def db_scale(spark, sf):
    return D.signal(spark, sf).select("track_id", "i", F.round(S.db_scale(F.col("x")), 5).alias("db"))


def mel_pool(spark, sf):
    rows = D.signal_blocks(spark, sf).select("track_id", "block_no", F.posexplode(S.mel_pool(F.col("samples"), 10)).alias("g", "mean"))
    return r6(rows.select("track_id", "block_no", F.col("g").cast("int").alias("g"), "mean"), "mean")


def overlap_add(spark, sf):
    return r6(A.overlap_add(A.cut_chunks(D.signal(spark, sf), 256, 192), 192), "x")


def stft_magnitude(spark, sf):
    rows = S.stft(D.signal_blocks(spark, sf)).select("track_id", "frame", F.posexplode("magnitudes").alias("bin", "mag"))
    return rows.select("track_id", "frame", F.col("bin").cast("int").alias("bin"), F.round("mag", 5).alias("mag"))


def hpss(spark, sf):
    return S.hpss(S.stft(D.signal_blocks(spark, sf)))


def cqt_frame(spark, sf):
    rows = S.cqt_frames(D.signal_blocks(spark, sf), 441.0, 27.5, 200.0)
    return r6(rows.select("track_id", "block_no", F.posexplode("magnitudes").alias("bin", "magnitude")), "magnitude")


def cqt_full(spark, sf):
    """Constant-Q magnitudes at every 64th sample, in decibels."""
    blocks = D.signal_blocks(spark, sf).select("track_id", (F.col("block_no").cast("long") * 64).alias("start_frame"), "samples")
    rows = S.cqt_decibels(S.cqt_all(blocks, 441.0, 27.5, 200.0, hop=64)).select("track_id", "frame", F.posexplode("magnitudes").alias("bin", "db"))
    return r6(rows, "db")


def cqt_note_detect(spark, sf):
    return S.detect_notes(S.cqt_frames(D.signal_blocks(spark, sf), 441.0, 27.5, 200.0))


def note_model_pipeline(spark, sf):
    return M.note_pipeline(D.signal_blocks(spark, sf), M.DetectorNoteModel(441.0, 8), 128, 8)


def stereo_blocks(spark, sf):
    """The signal with a quieter right channel that stands off zero."""
    wide = F.flatten(F.transform("samples", lambda x: F.array(x, x * 0.5 + 0.1)))
    return D.signal_blocks(spark, sf).select("track_id", (F.col("block_no").cast("bigint") * 64).alias("start_frame"), wide.alias("samples"))


def stereo_rows(stems):
    rows = stems.select("track_id", "stem", "start_frame", F.posexplode("mono").alias("n", "mono"), "samples")
    return r6(rows.select("track_id", "stem", (F.col("start_frame") + F.col("n")).alias("i"), F.element_at("samples", 2 * F.col("n") + 1).alias("l"), F.element_at("samples", 2 * F.col("n") + 2).alias("r"), "mono"), "l", "r", "mono")


def stem_separation(spark, sf):
    return stereo_rows(M.separate(stereo_blocks(spark, sf), segment=2048))


def stem_separation_identity(spark, sf):
    """A model that gives back what it hears: chunks, weights and restored level leave the input as it was."""
    return stereo_rows(M.separate(stereo_blocks(spark, sf), M.IdentityStereoModel(("drums", "bass")), segment=1000))


def saved_tracks(spark, sf, blocks: int = 4096):
    """The signal as float WAV files of at most so many blocks each; the folder they lie in."""
    part = F.floor(F.col("block_no") / blocks)
    whole = D.signal_blocks(spark, sf).groupBy("track_id", part.alias("part")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "samples"))), lambda b: b["samples"])).alias("samples"))
    folder = FS.work_folder(spark, "tracks")
    content = WV.to_wav(whole.select((F.col("track_id") * 1_000_000 + F.col("part")).alias("track_id"), "samples"), D.SAMPLE_RATE, True)
    FS.save_files(content.select(F.concat(F.col("track_id").cast("string"), F.lit(".wav")).alias("name"), "content"), folder)
    return folder


def file_number():
    n = F.regexp_extract("path", r"(\d+)\.wav$", 1).cast("bigint")
    return F.floor(n / 1_000_000).alias("track_id"), (n % 1_000_000).alias("part")


def audio_blocks(spark, sf):
    """All samples of the saved tracks, read by byte ranges."""
    rows = SRC.read_audio(spark, saved_tracks(spark, sf), block=1000).select(*file_number(), "start_frame", F.posexplode("samples").alias("n", "x"))
    return r6(rows.select("track_id", "part", (F.col("start_frame") + F.col("n")).alias("i"), F.col("x").cast("double").alias("x")), "x")


def audio_probe(spark, sf):
    return SRC.probe_audio(spark, saved_tracks(spark, sf)).select(*file_number(), "sample_rate", "channels", "n_frames", F.round("seconds", 6).alias("seconds"), F.size("tags").alias("tags"), "error")


def audio_preview(spark, sf):
    """A quarter of a second from 0.05 s on, of each file."""
    rows = SRC.preview(SRC.read_audio(spark, saved_tracks(spark, sf), block=40), 0.05, 0.1, block=40, least_rate=D.SAMPLE_RATE)
    return r6(rows.select(*file_number(), "sample_rate", F.posexplode("samples").alias("i", "x")).withColumn("x", F.col("x").cast("double")), "x")


def lead_sheet_given_tempo_map(spark, sf):
    """The chords of the sheet that a given tempo map makes."""
    notes, segments = D.note_events(spark, sf), D.tempo_segments(spark, sf)
    tempo = segments.groupBy("track_id").agg(F.first("bpm").alias("bpm"), F.lit(0.5).alias("confidence"))
    return r6(Z.lead_sheet_with_tempo_map(notes, tempo, segments)["chord_changes"], "beat")


def time_stretch(spark, sf):
    flat = D.signal_blocks(spark, sf).groupBy("track_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "samples"))), lambda b: b["samples"])).alias("samples"))
    rows = A.stretch(flat, 1.25).select("track_id", F.posexplode("samples").alias("i", "x"))
    return r6(rows.select("track_id", F.col("i").cast("int").alias("i"), F.col("x").cast("double").alias("x")), "x")


def measure_boundaries(spark, sf):
    until = E.note_spans(quantised(spark, sf)).groupBy("track_id").agg(F.max("end_tick").alias("end_tick"))
    return E.measure_boundaries(signatures(spark, sf), until)


def note_spans(spark, sf):
    return E.note_spans(quantised(spark, sf))


def spans_to_measures(spark, sf):
    return E.split_into_measures(E.note_spans(quantised(spark, sf)))


def duration_tokens(spark, sf):
    """How the lengths of the notes are written, and how many notes have each."""
    lengths = E.note_spans(quantised(spark, sf)).groupBy((F.col("end_tick") - F.col("start_tick")).alias("ticks")).agg(F.count("*").alias("n"))
    return lengths.join(F.broadcast(E.duration_tokens(spark)), "ticks")


def voice_assignment(spark, sf):
    return E.voices(E.split_into_measures(E.note_spans(quantised(spark, sf))))


def musicxml_document(spark, sf):
    """With two meters and a swinging middle. The notes are quantised once and written, as spans, chords and articulations each read them."""
    q, folder = quantised(spark, sf), FS.work_folder(spark, "quantised")
    q.write.mode("overwrite").parquet(folder)
    q = spark.read.schema(q.schema).parquet(folder)
    styles = spark.createDataFrame([(0, 4, "Straight"), (4, 8, "Swing"), (8, 10_000, "Straight")], "bar_start int, bar_end int, style string")
    sections = D.tempo_segments(spark, sf).select("track_id").distinct().crossJoin(F.broadcast(styles))
    return E.musicxml(q, C.chord_scan(q), 120.0, signatures(spark, sf), sections, Q.articulation(q, D.note_events(spark, sf), 0.5))


def midi_events(spark, sf):
    return E.midi_events(D.note_events(spark, sf))


def midi_files(spark, sf):
    return E.midi_files(D.note_events(spark, sf))


def chunk_rebuild_trigger(spark, sf):
    return R.rebuild_triggers(D.chunk_log(spark, sf), 500.0)


def late_early_classify(spark, sf):
    return D.chunk_log(spark, sf).select("event_id", R.timing_class(F.col("us"), F.col("clock")).alias("class"))


def debounce_sessions(spark, sf):
    rows = D.read(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "value")
    out = R.debounce(rows, "6 hours")
    return out.select("key", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), F.round("value", 6).alias("value"), "n")


def ring_buffer_tail(spark, sf):
    return R.ring_tail(D.chunk_log(spark, sf), 5).select("user_id", "event_id")


def ema_fold(spark, sf):
    return r6(R.ema(D.chunk_log(spark, sf)), "rate")


def highlight_decay(spark, sf):
    return r6(N.highlight_decay(D.note_frames(spark, sf), 0.05), "level")


def cache_variant_lookup(spark, sf):
    """Wanted: each track at its length; cached: the even ones, a third of them much longer."""
    tracks = D.note_events(spark, sf).groupBy("track_id").agg(F.max("end_time").alias("duration"))
    keyed = tracks.select(F.col("track_id").cast("string").alias("content_hash"), F.lit(7).cast("bigint").alias("variant_key"), "duration", "track_id")
    cached = keyed.where("track_id % 2 = 0").select("content_hash", "variant_key", F.when(F.col("track_id") % 3 == 0, F.col("duration") * 1.5).otherwise(F.col("duration")).alias("duration"), F.lit(4).alias("version"))
    return r6(H.lookup(keyed.drop("track_id"), cached), "duration", "cached_duration")


def cache_validation(spark, sf):
    return H.valid_frames(D.prob_arrays(spark, sf), 64)


def loop_split(spark, sf):
    w = A.waveform(D.signal(spark, sf), D.SAMPLE_RATE, 500)
    return w.groupBy("track_id", H.loop_part(F.col("t"), 1.0, 3.0).alias("part")).agg(F.count("*").alias("n"))


def note_at_beat(spark, sf):
    points = D.beats(spark, sf).select("track_id", "beat_idx", "t")
    return r6(U.note_at(points, D.note_events(spark, sf)), "t")


def cursor_offset(spark, sf):
    segments = D.tempo_segments(spark, sf)
    return r6(U.cursor_offset(Q.quantize_tempo_map(D.note_events(spark, sf), segments), segments, D.note_events(spark, sf)), "offset")


def mean_tempo(spark, sf):
    return r6(U.mean_tempo(D.tempo_segments(spark, sf)), "bpm")


def clef_by_measure(spark, sf):
    return r6(U.clefs(E.split_into_measures(E.note_spans(quantised(spark, sf)))), "mean_pitch")


def chord_debug_json(spark, sf):
    return U.chord_debug(C.bar_candidates(quantised(spark, sf)))


def energy_notes(spark, sf):
    return r6(U.energy_notes(D.signal(spark, sf), 128, 441.0, 0.125), "start_time", "end_time")


def melodic_stem_choice(spark, sf):
    stems = stems_signal(spark, sf).withColumnRenamed("stem_idx", "track_id")
    facts = A.rms(stems).join(A.zero_crossing_variance(stems.select("track_id", "i", "x"), 128, 64), "track_id")
    rows = facts.select(F.lit(1).cast("bigint").alias("song"), F.col("track_id").alias("stem_idx"), (F.col("track_id") > 1).alias("melodic"), F.round("variance", 6).alias("variance"), F.round(F.least(F.lit(1.0), F.col("rms") * 10), 6).alias("energy"), F.lit(0.5).alias("confidence"))
    return r6(U.melodic_stem(rows), "score")


def adaptive_budget(spark, sf):
    rows = D.read(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 4000).cast("double").alias("sec"))
    return rows.select("o_orderkey", A.adaptive_budget(F.lit(6000), F.col("sec")).cast("int").alias("budget"), F.round(H.analysis_estimate(F.col("sec"), F.lit(0.05), F.lit("Studio")), 6).alias("estimate"), F.round(H.resume_position(F.col("sec"), F.lit(3000.0)), 6).alias("resume"), H.preview_bucket(F.col("sec")).cast("bigint").alias("bucket"))


def meter_classes(spark, sf):
    rows = D.read(spark, sf, "lineitem").select((F.col("l_linenumber") % 13).cast("int").alias("numerator"), F.when(F.col("l_orderkey") % 2 == 0, 4).otherwise(8).alias("denominator")).distinct()
    return rows.select("numerator", "denominator", X.meter_class(F.col("numerator"), F.col("denominator")).alias("meter_class"))


def lead_sheet_summary(spark, sf):
    """The lead sheet's tables by track: rows, and the sum of what each says."""
    sheet = Z.lead_sheet(D.note_events(spark, sf), D.beats(spark, sf), D.downbeats(spark, sf))
    facts = {"aligned_notes": "intra_beat_pos", "swing_sections": "bar_end", "quantized_notes": "beat_start + beat_duration", "tempo_segments": "bpm", "chord_changes": "beat"}
    out = None
    for name, of in facts.items():
        part = sheet[name].groupBy("track_id").agg(F.count("*").alias("n"), F.round(F.sum(F.expr(of).cast("double")), 5).alias("total")).select("track_id", F.lit(name).alias("part"), "n", "total")
        out = part if out is None else out.unionByName(part)
    return out


def lead_sheet_from_notes(spark, sf):
    return r6(Z.lead_sheet_from_notes(D.note_events(spark, sf))["quantized_notes"], "beat_start", "beat_duration")


_HELPERS = {"heard_sets", "stereo_blocks", "stereo_rows", "saved_tracks", "file_number", "sparse_beats", "beat_sources", "named_stems", "channel_frames", "frame_points", "r6", "active", "stem_frames", "aligned", "quantised", "signatures", "stems_signal"}
QUERIES = {name: f for name, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and name not in _HELPERS}
