"""Melody reduction: folds over a track's notes in time, one group of notes at a time.

The choice at each instant depends on the one before, so these are folds by nature. A fold sees the track's notes as tuples
(id, pitch, start, end, velocity); a very long track is one task's."""

from __future__ import annotations

from math import isfinite

import pandas as pd
from pyspark.sql import DataFrame

from .folds import fold_tracks

SCHEMA = "track_id bigint, id int, pitch int, start_time double, end_time double, velocity int"


def _rows(track, notes: list[list]) -> list[tuple]:
    return [(track, i + 1, p, a, b, v) for i, (p, a, b, v) in enumerate(notes) if b > a]


def _events(notes: list[tuple]) -> tuple[list[tuple], list[int], list[float], list[int]]:
    """(time, 1 for off and 0 for on, -pitch, note number): starts before ends at a tie; and the notes' pitches, ends and velocities.

    Notes without a finite length above nothing are left out."""
    ok = [n for n in notes if n[2] is not None and n[3] is not None and isfinite(n[2]) and isfinite(n[3]) and n[3] > n[2]]
    ok.sort(key=lambda n: (n[2], n[1], n[0]))
    on = [(n[2], 0, -n[1], i) for i, n in enumerate(ok)]
    off = [(n[3], 1, -n[1], i) for i, n in enumerate(ok)]
    return sorted(on + off), [n[1] for n in ok], [n[3] for n in ok], [n[4] for n in ok]


def continuity(track: int, notes: list[tuple], gap: float = 0.02) -> list[tuple]:
    """At each instant the sounding note of the best 0.7 pitch + 0.15 velocity + 8 nearness to the last choice."""
    events, pitch, _, velocity = _events(notes)
    active, out, last, at = set(), [], None, None
    for t, off, _, i in events:
        if active and at is not None and t > at:
            score = lambda k: (0.7 * pitch[k] + 0.15 * velocity[k] + (8 * max(0.0, 1 - abs(pitch[k] - last) / 24) if last is not None else 0), pitch[k], -k)
            k = max(active, key=score)
            last = pitch[k]
            if out and out[-1][0] == pitch[k] and at - out[-1][2] < gap:
                out[-1][2], out[-1][3] = t, max(out[-1][3], velocity[k])
            else:
                out.append([pitch[k], at, t, velocity[k]])
        at = t
        (active.discard if off else active.add)(i)
    return _rows(track, out)


def skyline(track: int, notes: list[tuple], batch: float = 0.15, outlier: int = 12, first_of_pitch: bool = False) -> list[tuple]:
    """Events in batches; offs, then ons; the highest sounding pitch unless it is far from the last eight accepted."""
    events, _, end_time, velocity = _events(notes)
    active: dict[int, tuple[int, int]] = {}
    out, history, at = [], [], 0
    while at < len(events):
        stop, head = at, events[at][0]
        while stop < len(events) and events[stop][0] - head <= batch:
            stop += 1
        group, at = events[at:stop], stop
        for t, off, p, i in group:
            if off and active.get(i):
                active.pop(i, None)
        seen = set()
        for t, off, p, i in group:
            if not off and not (first_of_pitch and -p in seen):
                seen.add(-p)
                if end_time[i] > group[-1][0]:
                    active[i] = (-p, velocity[i])
        if not active:
            continue
        top, loud = max(active.values())
        middle = sorted(history)[len(history) // 2] if len(history) >= 3 else None
        if out and out[-1][0] == top:
            out[-1][2] = max(out[-1][2], max(end_time[i] for i, (p, _) in active.items() if p == top))
            continue
        if middle is not None and abs(top - middle) > outlier:
            continue
        if out:
            out[-1][2] = max(out[-1][1], min(out[-1][2], head)) if out[-1][2] > head else out[-1][2]
        out.append([top, head, max(end_time[i] for i, (p, _) in active.items() if p == top), loud])
        history = [*history, top][-8:]
    return _rows(track, out)


def _of_frame(fold, notes: pd.DataFrame, **options) -> pd.DataFrame:
    rows = list(notes[["id", "pitch", "start_time", "end_time", "velocity"]].itertuples(index=False, name=None))
    return pd.DataFrame(fold(notes["track_id"].iloc[0], rows, **options), columns=[c.split()[0] for c in SCHEMA.split(", ")])


def continuity_fold(notes: pd.DataFrame, gap: float = 0.02) -> pd.DataFrame:
    """continuity() of one track's frame."""
    return _of_frame(continuity, notes, gap=gap)


def skyline_fold(notes: pd.DataFrame, batch: float = 0.15, outlier: int = 12, first_of_pitch: bool = False) -> pd.DataFrame:
    """skyline() of one track's frame."""
    return _of_frame(skyline, notes, batch=batch, outlier=outlier, first_of_pitch=first_of_pitch)


def _folded(notes: DataFrame, fold) -> DataFrame:
    return fold_tracks(notes.select("track_id", "id", "pitch", "start_time", "end_time", "velocity"), fold, SCHEMA)


def melody_continuity(notes: DataFrame) -> DataFrame:
    return _folded(notes, lambda track, rows: continuity(track, rows))


def melody_skyline(notes: DataFrame) -> DataFrame:
    return _folded(notes, lambda track, rows: skyline(track, rows))


def melody_heuristic(notes: DataFrame) -> DataFrame:
    return _folded(notes, lambda track, rows: skyline(track, rows, 0.12, 12, True))
