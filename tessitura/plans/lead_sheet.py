"""Composite plans: from frames to notes, and from notes and beats to a lead sheet, as named DataFrames over all tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import beats as B
from ..operators import chords as C
from ..operators import melody as P
from ..operators import quantize as Q
from ..operators import tempo as T
from ..operators.frames import extract_notes


def notes_of(frames: DataFrame, sensitivity: float = 1.0, step: float = 0.05) -> DataFrame:
    from ..operators.frames import sensitivity_threshold

    return extract_notes(frames, sensitivity_threshold(sensitivity), step)


def lead_sheet(notes: DataFrame, beats: DataFrame, downbeats: DataFrame, bpb: int = 4) -> dict[str, DataFrame]:
    """The enhanced path: association, swing, quantisation in the style of most bars, tempo map, chords; the melody is all notes."""
    aligned = Q.associate(notes, beats, downbeats, bpb)
    sections = Q.swing_sections(aligned)
    quantised = Q.quantize_aligned(aligned, Q.majority_sections(sections), bpb)
    return {
        "aligned_notes": aligned, "swing_sections": sections, "swing": Q.swing_majority(sections), "quantized_notes": quantised,
        "tempo_segments": B.bar_tempo_map(beats, downbeats, bpb), "chord_changes": C.chords_per_bar(quantised, bpb), "melody": notes,
    }


def lead_sheet_with_tempo_map(notes: DataFrame, tempo: DataFrame, segments: DataFrame) -> dict[str, DataFrame]:
    """The path with a given tempo (track_id, bpm, ...) and tempo map: meters by segment, quantisation against both, tied notes, the
    melody quantised as well, chords, and the rhythm's confidence. Tracks without a tempo map, or without a note that stays after
    quantisation, have no rows in any table."""
    mapped = notes.join(segments.select("track_id").distinct(), "track_id", "left_semi")
    meter = T.infer_meter(mapped, segments)
    quantised = Q.quantize_tempo_map(mapped, segments, meter)
    there = lambda df: df.join(quantised.select("track_id").distinct(), "track_id", "left_semi")
    return {
        "tempo": there(tempo), "tempo_segments": there(segments), "time_signatures": there(meter), "quantized_notes": quantised, "tied_notes": there(Q.tied_notes(mapped, segments, meter)),
        "melody": Q.quantize_tempo_map(P.melody_heuristic(mapped), segments, meter), "chord_changes": C.chord_scan(quantised), "confidence": there(T.rhythm_confidence(segments, meter, tempo)),
    }


def lead_sheet_from_notes(notes: DataFrame) -> dict[str, DataFrame]:
    """The path without beats: tempo by autocorrelation, a windowed tempo map, meters by segment, quantisation against both,
    tied notes, melody, chords, and the rhythm's confidence."""
    tempo = T.resolve_octave(notes)
    segments = T.tempo_segments(notes)
    meter = T.infer_meter(notes, segments)
    quantised = Q.quantize_tempo_map(notes, segments, meter)
    return {
        "tempo": tempo, "tempo_segments": segments, "time_signatures": meter, "quantized_notes": quantised, "tied_notes": Q.tied_notes(notes, segments, meter), "melody": P.melody_heuristic(notes),
        "chord_changes": C.chord_scan(quantised), "confidence": T.rhythm_confidence(segments, meter, tempo),
    }
