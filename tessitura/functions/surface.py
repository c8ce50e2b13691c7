"""What SQL users call: scalar functions as SQL expressions, which Catalyst inlines, and table functions for LATERAL.

    register_functions(spark)
    SELECT snap_beat(b), chord_symbol(mask, bass), parse_chord('D-7/C').root
    SELECT n.* FROM pages, LATERAL note_positions(svg) n
"""

from __future__ import annotations

import math

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators.chords import chord_symbols
from ..operators.engraving import read_positions
from ..operators.quantize import DURATIONS, START_GRIDS
from ..operators.repair import whole_bars
from .text import CHORD_KINDS, LETTERS

START_MARGIN, DURATION_MARGIN, LEAST = 0.03, 0.015, 0.25


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _nearest(grids: tuple[float, ...], margin: float) -> str:
    """The nearest point of the grids in order, a later one only if it is better by more than margin; of a value x."""
    points = ", ".join(f"named_struct('p', round(x / {g!r}D) * {g!r}D, 'e', abs(x - round(x / {g!r}D) * {g!r}D))" for g in grids)
    return f"aggregate(array({points}), named_struct('p', CAST(NULL AS DOUBLE), 'e', double('Infinity')), (b, y) -> CASE WHEN y.e + {margin!r}D < b.e THEN y ELSE b END).p"


def _pitch_class(name: str) -> str:
    letters = " ".join(f"WHEN {quoted(letter)} THEN {pc}" for letter, pc in LETTERS.items())
    return f"coalesce(pmod(CASE substring({name}, 1, 1) {letters} END + CASE substring({name}, 2, 1) WHEN 'b' THEN -1 WHEN '#' THEN 1 ELSE 0 END, 12), 0)"


def scalar_functions() -> dict[str, tuple[str, str, str]]:
    """Parameters, type and SQL expression of each scalar function by name."""
    head, bass = "split_part(symbol, '/', 1)", "split_part(symbol, '/', 2)"
    root, rest = (f"regexp_extract({head}, '^([A-G][#b]?)(.*)$', {n})" for n in (1, 2))
    parsed = f"""named_struct('root', CASE WHEN {root} <> '' THEN {_pitch_class(root)} ELSE 0 END,
      'suffix', CASE WHEN {root} <> '' THEN {rest} ELSE substring({head}, 2, 1000) END, 'bass', CASE WHEN {bass} <> '' THEN {_pitch_class(bass)} END)"""
    kinds = " ".join(f"WHEN {quoted(s)} THEN {quoted(k)}" for s, k in CHORD_KINDS.items())
    symbols = quoted("|".join(s or "" for s in chord_symbols()))
    # element_at of an array without nulls is taken for never null: for a null place it would give the last symbol
    place = "mask * 13 + bass + 1"
    symbol = f"CASE WHEN {place} BETWEEN 0 AND {len(chord_symbols()) - 1} THEN element_at(split({symbols}, '[|]'), {place} + 1) END"
    return {
        "snap_beat": ("x DOUBLE", "DOUBLE", _nearest(tuple(sorted(START_GRIDS, reverse=True)), START_MARGIN)),
        "snap_length": ("x DOUBLE", "DOUBLE", f"greatest({LEAST!r}D, coalesce({_nearest(DURATIONS, DURATION_MARGIN)}, {LEAST!r}D))"),
        "pitch_class": ("name STRING", "INT", _pitch_class("name")),
        "parse_chord": ("symbol STRING", "STRUCT<root: INT, suffix: STRING, bass: INT>", parsed),
        "chord_kind": ("suffix STRING", "STRING", f"CASE suffix {kinds} ELSE 'other' END"),
        "chord_symbol": ("mask INT, bass INT", "STRING", f"nullif({symbol}, '')"),
    }


@udtf(returnType="note_id bigint, pitch int, tick int, duration_ticks int, x double, y double, w double, h double")
class NotePositions:
    """note_positions(svg): the notes of a page and where they lie, as shares of its view box."""

    def eval(self, svg: str):
        yield from read_positions(svg or "")


def _snapped(value: float, grids: tuple[float, ...], margin: float) -> float:
    best, error = 0.0, math.inf
    for g in grids:
        point = math.floor(abs(value) / g + 0.5) * g
        if abs(abs(value) - point) + margin < error:
            best, error = math.copysign(point, value), abs(abs(value) - point)
    return best


@udtf(returnType="seg_no int, beat_start double, beat_duration double, tie_start boolean, tie_stop boolean")
class TiedPieces:
    """tied_pieces(beat_start, beat_end, barlines): a note with both ends on the grid, cut at each barline strictly inside."""

    def eval(self, beat_start: float, beat_end: float, barlines: list):
        if beat_start is None or beat_end is None:
            return
        a, z = (_snapped(v, tuple(sorted(START_GRIDS, reverse=True)), START_MARGIN) for v in (beat_start, beat_end))
        marks = [a, *sorted({b for b in barlines or () if a < b < z}), z]
        for n, (s, e) in enumerate(zip(marks, marks[1:])):
            yield n, s, max(LEAST, _snapped(max(LEAST, e - s), DURATIONS, DURATION_MARGIN)), n < len(marks) - 2, n > 0


@udtf(returnType="kind string, idx int, t double")
class WholeBars:
    """whole_bars(beats, downbeats, bpb): the grid of a track's beats and downbeats with its gaps filled."""

    def eval(self, beats: list, downbeats: list, bpb: int):
        for kind, times in zip(("beat", "downbeat"), whole_bars(sorted(beats or ()), sorted(downbeats or ()), max(1, bpb or 4))):
            for n, t in enumerate(times):
                yield kind, n, float(t)


TABLE_FUNCTIONS = {"note_positions": NotePositions, "tied_pieces": TiedPieces, "whole_bars": WholeBars}


def register_functions(spark: SparkSession) -> None:
    """Make all of them known to a session, under their names."""
    for name, (parameters, kind, body) in scalar_functions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    for name, function in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, function)
